"""Windows event records as JSON lines."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweave.functions import jsontext
from logweave.functions.text import text_to_long
from logweave.model import OPEN_MAP, to_events
from logweave.sources.text import _lines

# Channels read unless others are named.
CHANNELS = ("Application", "System", "Security")
_RECORD = "_record"


def winlog(
    spark: SparkSession,
    path: str,
    mode: str = "file",
    channels: list[str] | tuple[str, ...] = CHANNELS,
    level: int | None = None,
    event_ids: list[int] | tuple[int, ...] = (),
    providers: list[str] | tuple[str, ...] = (),
    tail: bool = False,
    in_file_order: bool = False,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Events from a file or a directory of JSON lines, filtered as in ``winlog_events``."""
    if mode not in ("file", "directory"):
        raise ValueError(f"Invalid mode: {mode}")
    if not path:
        raise ValueError("Path is required for file or directory mode")
    lines = _lines(spark, path, stream=tail, max_files=max_files_per_trigger)
    if in_file_order and not tail:
        lines = lines.withColumn("_row", F.monotonically_increasing_id())
        lines = lines.orderBy("modified", "path", "block", "_row")
    return winlog_events(lines, "value", channels, level, event_ids, providers, mode)


def winlog_events(
    lines: DataFrame,
    column: str = "value",
    channels: list[str] | tuple[str, ...] = CHANNELS,
    level: int | None = None,
    event_ids: list[int] | tuple[int, ...] = (),
    providers: list[str] | tuple[str, ...] = (),
    mode: str = "file",
) -> DataFrame:
    """Events out of JSON texts with a ``winlog`` object; anything else is skipped.

    All given filters must hold and a value that is missing fails them. ``level`` keeps
    numbers from it upwards. An empty ``channels`` list reads every channel.
    """
    if level is not None and not 1 <= level <= 5:
        raise ValueError("Level must be between 1 and 5")
    # A plain search spares most other texts the parse.
    candidates = lines.where(F.contains(F.col(column), F.lit("winlog")))
    records = jsontext.with_parsed(candidates, F.col(column), _RECORD)
    # Each filter reads its value from the parsed record as a column of its own.
    records = records.withColumns(
        {
            "_channel": _text("winlog.channel"),
            "_level": _whole("winlog.level"),
            "_event_id": _whole("winlog.event_id"),
            "_provider": F.coalesce(_text("winlog.provider.name"), _text("winlog.provider_name")),
        }
    )
    keep = []
    if channels:
        keep.append(F.col("_channel").isin(list(channels)))
    if level is not None:
        keep.append(F.col("_level") >= level)
    if event_ids:
        keep.append(F.col("_event_id").isin([int(e) for e in event_ids]))
    if providers:
        keep.append(F.col("_provider").isin(list(providers)))
    # Any filter needs a member of the object; without filters its kind is looked at.
    records = records.where(reduce(and_, keep or [F.schema_of_variant(_value("winlog")).startswith("OBJECT")]))
    null = F.parse_json(F.lit("null"))
    values = {
        "event_id": _value("winlog.event_id"),
        "level": _value("winlog.level"),
        "provider": F.col("_provider").cast("variant"),
        "computer_name": _value("winlog.computer_name"),
        "record_id": _value("winlog.record_id"),
        "task": _value("winlog.task"),
        "keywords": _value("winlog.keywords"),
        "message": _value("message"),
        "host": F.coalesce(_value("host"), F.parse_json(F.lit("{}"))),
    }
    always = F.create_map(*[p for k, v in values.items() for p in (F.lit(k), F.coalesce(v, null))])
    nothing = F.create_map().cast(OPEN_MAP)
    extras = [
        F.when(_value(f"winlog.{k}").isNotNull(), F.create_map(F.lit(k), _value(f"winlog.{k}"))).otherwise(nothing)
        for k in ("event_data", "user")
    ]
    return to_events(
        records,
        timestamp=_text("@timestamp").try_cast("timestamp"),
        source_type=F.lit("winlog"),
        source_name=F.coalesce("_channel", F.lit("unknown")),
        raw_data=F.col(column),
        fields=F.map_concat(always, *extras),
        metadata=F.create_map(
            F.lit("winlog_source"), F.lit(mode).cast("variant"),
            F.lit("winlog_channel"), F.coalesce(F.col("_channel").cast("variant"), null),
        ),
    )


def _value(name: str) -> Column:
    return jsontext.member(_RECORD, name, "variant")


def _text(name: str) -> Column:
    return jsontext.member(_RECORD, name, "string")


def _whole(name: str) -> Column:
    """Whole number of a member: fractions are cut off, texts must be whole."""
    value = _value(name)
    return F.when(F.schema_of_variant(value) == "STRING", text_to_long(_text(name))).otherwise(
        F.try_variant_get(value, "$", "bigint")
    )
