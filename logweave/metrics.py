"""Counters per flow, the table they are kept in, and their rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

STATUS = "_status"

METRICS_SCHEMA = (
    "name string, running boolean, sources int, processors int, sinks int, "
    "events_processed bigint, events_dropped bigint, processing_errors bigint, uptime double"
)
COUNTERS = ("events_processed", "events_dropped", "processing_errors")


def counters(status: str = STATUS) -> list[Column]:
    """Processed, dropped and failed rows of an audited DataFrame; an error is also a drop."""
    state = F.col(status)["state"]
    return [
        F.count_if(state == "ok").alias("events_processed"),
        F.count_if(state != "ok").alias("events_dropped"),
        F.count_if(state == "error").alias("processing_errors"),
    ]


def status_row(spark: SparkSession, **values) -> DataFrame:
    """One status row of a flow."""
    order = [part.split()[0] for part in METRICS_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(values[n] for n in order)], METRICS_SCHEMA)


def rollup(metrics: DataFrame) -> DataFrame:
    """Counters per flow, and the grand total in the row whose name is NULL.

    ``flows`` counts the flows behind a row. One pass: the rows are combined per flow
    first, and only those few rows are doubled for the total.
    """
    per_flow = metrics.groupBy("name").agg(*(F.sum(c).alias(c) for c in COUNTERS))
    none = F.lit(None).cast("string").alias("name")
    levels = F.array(
        F.struct(F.col("name"), F.lit(False).alias("total")), F.struct(none, F.lit(True).alias("total"))
    )
    doubled = per_flow.select(F.explode(levels).alias("level"), *COUNTERS).select("level.*", *COUNTERS)
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    return doubled.groupBy("name", "total").agg(F.count(F.lit(1)).alias("flows"), *sums).drop("total")


def errors(audited: DataFrame, status: str = STATUS) -> DataFrame:
    """The rows of an audited DataFrame that an error dropped, with stage and message."""
    rows = audited.where(F.col(status)["state"] == "error")
    return rows.withColumns({"error_stage": F.col(status)["stage"], "error_message": F.col(status)["message"]}).drop(status)
