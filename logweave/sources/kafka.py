"""Message topics."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweave.model import literal, to_events


def kafka(
    spark: SparkSession,
    brokers: list[str] | str,
    topics: list[str] | str,
    group_id: str | None = None,
    auto_offset_reset: str = "latest",
    max_poll_records: int | None = None,
    consumer_timeout_ms: int = 1000,
    metadata: dict[str, Any] | None = None,
    tail: bool = True,
) -> DataFrame:
    """Events from topics through Spark's Kafka connector (a package of its own).

    Offsets live in the checkpoint of the query instead of being committed while reading.
    ``max_poll_records`` bounds a micro-batch; without it one takes all there is.
    """
    if not brokers or not topics:
        raise ValueError("Kafka brokers and topics are required")
    reader = (spark.readStream if tail else spark.read).format("kafka")
    options = kafka_options(brokers, topics, group_id, auto_offset_reset, max_poll_records, consumer_timeout_ms, tail)
    return kafka_events(reader.options(**options).load(), metadata)


def kafka_options(
    brokers: list[str] | str,
    topics: list[str] | str,
    group_id: str | None = None,
    auto_offset_reset: str = "latest",
    max_poll_records: int | None = None,
    consumer_timeout_ms: int = 1000,
    tail: bool = True,
) -> dict[str, str]:
    """Connector options for the consumer settings.

    ``consumer_timeout_ms``, after which an idle consumer stops waiting, has no option: a batch ends at the newest
    offsets, and a stream waits for its trigger. The connector's poll timeout is a bound on failures and stays its own.
    """
    def joined(value: list[str] | str) -> str:
        return value if isinstance(value, str) else ",".join(value)

    options = {
        "kafka.bootstrap.servers": joined(brokers),
        "subscribe": joined(topics),
    }
    if group_id:
        options["kafka.group.id"] = group_id
    if tail:
        options["startingOffsets"] = auto_offset_reset
        if max_poll_records:
            options["maxOffsetsPerTrigger"] = str(max_poll_records)
    return options


def kafka_events(rows: DataFrame, metadata: dict[str, Any] | None = None) -> DataFrame:
    """Events out of connector rows; extra metadata is merged last and wins.

    Bytes that are no UTF-8 text become hex text and a ``decode_error`` entry.
    """
    null = F.parse_json(F.lit("null"))
    valid = F.is_valid_utf8(F.col("value").cast("string"))
    text = F.when(F.col("value").isNull(), F.lit("None")).when(valid, F.col("value").cast("string")).otherwise(
        F.lower(F.hex("value"))
    )
    entries = {
        "kafka_topic": F.col("topic").cast("variant"),
        "kafka_partition": F.col("partition").cast("variant"),
        "kafka_offset": F.col("offset").cast("variant"),
        "kafka_timestamp": F.unix_millis("timestamp").cast("variant"),
        # An empty key counts as none.
        "kafka_key": F.when(F.length("key") > 0, F.col("key").cast("string")).cast("variant"),
    }
    entries.update({k: literal(v).cast("variant") for k, v in (metadata or {}).items()})
    pairs = [part for k, v in entries.items() for part in (F.lit(k), F.coalesce(v, null))]
    base = F.create_map(*pairs)
    failed = F.create_map(F.lit("decode_error"), F.lit("not UTF-8, shown as hex").cast("variant"))
    return to_events(
        rows,
        # Topic, partition and offset identify a message: replays get the same id.
        id=F.sha2(F.concat_ws("|", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")), 256),
        source_type=F.lit("kafka"),
        source_name=F.col("topic"),
        raw_data=text,
        metadata=F.when(F.col("value").isNotNull() & ~valid, F.map_concat(base, failed)).otherwise(base),
    )
