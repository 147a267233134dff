"""Line sinks: JSON documents or templated text, as files or time-partitioned objects."""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logweave.files import Files
from logweave.functions import text as tx
from logweave.model import Fields, event_document
from logweave.session import shared_dir
from logweave.sinks.sizing import dealt_by_bytes

TEMPLATE = "{timestamp} {message}"
_OWN = ("id", "timestamp", "source_type", "source_name", "raw_data")


def render_template(df: DataFrame, template: str = TEMPLATE, message_field: str = "message") -> Column:
    """Text line of an event.

    Placeholders read the envelope, overridden by fields; ``{message}`` is the message
    field or the raw line. If any placeholder has no value the line is ``time raw_line``.
    """
    fields = Fields(df)
    parts: list[Column] = []
    needed: list[Column] = []
    for text, name, form, conversion in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is None:
            continue
        if form or conversion or not re.fullmatch(r"\w+", name):
            raise ValueError(f"Only plain {{name}} placeholders are supported: {template}")
        value = _message(df, fields, message_field) if name == "message" else _placeholder(df, fields, name)
        parts.append(F.coalesce(value, F.lit("None")) if name in _OWN or name == "message" else value)
        if name not in _OWN and name != "message":
            needed.append(fields.present(name))
    line = F.concat(*parts) if parts else F.lit("")
    if not needed:
        return line
    complete = needed[0]
    for condition in needed[1:]:
        complete = complete & condition
    fallback = F.concat(_own(df, "timestamp"), F.lit(" "), F.coalesce(_own(df, "raw_data"), F.lit("None")))
    return F.when(complete, line).otherwise(fallback)


def _own(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("None")
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return tx.iso_text(F.col(name))
    return tx.value_text(F.col(name), kind)


def _placeholder(df: DataFrame, fields: Fields, name: str) -> Column:
    if name not in _OWN:
        return fields.text(name)
    return F.coalesce(fields.text(name), _own(df, name)) if fields.open else _own(df, name)


def _message(df: DataFrame, fields: Fields, message_field: str) -> Column:
    own = fields.text(message_field)
    return F.coalesce(own, _own(df, "raw_data"))


def event_lines(
    df: DataFrame, format: str = "json", template: str = TEMPLATE, message_field: str = "message"
) -> Column:
    """The line one event is written as."""
    if format not in ("json", "text"):
        raise ValueError(f"Invalid format: {format}")
    return event_document(df) if format == "json" else render_template(df, template, message_field)


def write_files(
    df: DataFrame,
    path: str,
    format: str = "json",
    append: bool = True,
    template: str = TEMPLATE,
    message_field: str = "message",
    max_records_per_file: int | None = None,
    batch_id: int | None = None,
) -> None:
    """Write one line per event into files under ``path``.

    A micro-batch has a folder of its own, ``batch_id=<id>``, so writing it again replaces its files.
    Without ``append`` the first batch of a stream clears ``path``.
    """
    if not path:
        raise ValueError("File path is required")
    path, append = batch_folder(df, path, append, batch_id)
    writer = df.select(event_lines(df, format, template, message_field).alias("value")).write
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.mode("append" if append else "overwrite").text(path)


def batch_folder(df: DataFrame, path: str, append: bool, batch_id: int | None) -> tuple[str, bool]:
    """Where a batch is written, and whether to what is there."""
    if batch_id is None:
        return path, append
    if not append and batch_id == 0:
        Files(df.sparkSession, path).remove("")
    return f"{path.rstrip('/')}/batch_id={batch_id}", False


def partition_columns(df: DataFrame, time: str = "event") -> dict[str, Column]:
    """Year, month, day and hour texts of the event time, or of now with ``processing``."""
    if time not in ("event", "processing"):
        raise ValueError(f"Invalid time: {time}")
    stamp = (F.col("timestamp") if time == "event" else F.current_timestamp()).cast("string")
    places = {"year": (1, 4), "month": (6, 2), "day": (9, 2), "hour": (12, 2)}
    return {name: F.substring(stamp, *place) for name, place in places.items()}


def write_objects(
    df: DataFrame,
    bucket: str,
    key_prefix: str = "",
    format: str = "json",
    template: str = TEMPLATE,
    message_field: str = "message",
    time: str = "event",
    buffer_size: int = 10 << 20,
    max_records_per_file: int | None = None,
    scheme: str = "s3a",
    append: bool = True,
    batch_id: int | None = None,
) -> None:
    """Write lines under ``prefix/year=/month=/day=/hour=``, those of a micro-batch in ``batch_id=<id>`` below.

    A micro-batch that is written again replaces its own files. The text of an hour is cut into files of ``buffer_size``
    bytes, the last one has the rest; rows keep their order (``sizing.py``).
    """
    if not bucket:
        raise ValueError("S3 bucket is required")
    hours = partition_columns(df, time)
    line = event_lines(df, format, template, message_field).alias("value")
    out = df.select(line, *(c.alias(n) for n, c in hours.items()))
    scratch = shared_dir(df.sparkSession, "sizing")
    out = dealt_by_bytes(out, list(hours), int(buffer_size), scratch)
    root = f"{scheme}://{bucket.rstrip('/')}" if scheme else bucket.rstrip("/")
    folders = list(hours)
    if batch_id is not None:
        if not append and batch_id == 0:
            Files(df.sparkSession, f"{root}/{key_prefix}").remove("")
        out, append = out.withColumn("batch_id", F.lit(batch_id)), False
        folders.append("batch_id")
    writer = out.write.partitionBy(*folders)
    if batch_id is not None:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    try:
        writer.mode("append" if append else "overwrite").text(f"{root}/{key_prefix}")
    finally:
        Files(df.sparkSession, scratch).remove("")
