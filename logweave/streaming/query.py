"""Flows as Structured Streaming queries."""

from __future__ import annotations

import logging
import time
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave import metrics
from logweave.plans.flow import Flow
from logweave.session import configure, lasting_dir, shared_dir
from logweave.streaming.ledger import Ledger

_log = logging.getLogger(__name__)


def start(
    flow: Flow,
    spark: SparkSession,
    checkpoint: str | None = None,
    available_now: bool = False,
    count: bool = False,
    on_error: str = "record",
    rows: DataFrame | None = None,
) -> StreamingQuery:
    """Start a flow as a stream, in place of a running stream of the same name.

    Micro-batches start every ``batch_timeout`` seconds, or with ``available_now`` take
    what there is and end. Progress is kept in ``checkpoint``, by default a folder of the flow's name under
    ``spark.checkpoint.dir``; a restart goes on from there, and a ledger beside it (``ledger.py``) keeps what each sink has got: none gets a batch
    twice, and one that failed gets it later. With ``count`` the counters go to the ledger and appear in
    the query's progress. ``rows`` replaces the declared sources by a streaming DataFrame of events.
    """
    configure(spark)
    if flow.name in running(spark):
        stop(spark, flow.name)
    rows = flow.read(spark, stream=True) if rows is None else rows
    out = flow.audit(rows).observe(_label(flow), *metrics.counters()) if count else flow.transform(rows)

    checkpoint = checkpoint or lasting_dir(spark, f"checkpoint-{flow.name}")
    if checkpoint is None:
        checkpoint = shared_dir(spark, f"checkpoint-{flow.name}")
        _log.warning("flow %s has no lasting checkpoint and will begin anew when restarted: set spark.checkpoint.dir", flow.name)
    flow.ledger = ledger = Ledger(spark, f"{checkpoint.rstrip('/')}/delivery")

    def write(batch: DataFrame, number: int) -> None:
        if not count:
            flow.deliver(batch, number, ledger, on_error)
            return
        seen = Observation(f"{_label(flow)}-{number}")
        kept = batch.observe(seen, *metrics.counters()).where(F.col(metrics.STATUS)["state"] == "ok").drop(metrics.STATUS)
        flow.deliver(kept, number, ledger, on_error, seen)

    writer = out.writeStream.queryName(flow.name).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{float(flow.spec.get('batch_timeout', 5.0))} seconds")
    flow.sink_failures.clear()
    flow.started = time.time()
    flow.redeliver(ledger)
    return writer.foreachBatch(write).start()


def status(flow: Flow, query: StreamingQuery) -> dict[str, Any]:
    """Status row of a running or finished stream; counters of all its batches, and all failures of sinks."""
    tally = dict.fromkeys(metrics.COUNTERS, 0) | (flow.ledger.totals() if flow.ledger else {})
    tally["processing_errors"] += len(flow.sink_failures)
    uptime = time.time() - flow.started if query.isActive else 0.0
    return flow.status(tally, query.isActive, uptime) | {"failures": list(flow.sink_failures)}


def running(spark: SparkSession) -> dict[str, StreamingQuery]:
    """Running streams by flow name."""
    return {query.name: query for query in spark.streams.active if query.name}


def stop(spark: SparkSession, name: str) -> None:
    """Stop the stream of a flow."""
    queries = running(spark)
    if name not in queries:
        raise KeyError(f"Pipeline not found: {name}")
    queries[name].stop()


def _label(flow: Flow) -> str:
    return f"{flow.name}-counters"


def table_stream(spark: SparkSession, path: str, schema=None, max_files: int | None = None) -> DataFrame:
    """A Parquet table, single file or folder, as a stream of its files."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # Written as a glob, the path may name a file as well as a folder.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")
