"""Flows as streams; each must give what the same flow gives as a batch."""

import os

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from logweave import metrics
from logweave.checks.base import LEVEL, MICROS, field_text, log_lines, open_events, query
from logweave.model import OPEN_MAP, add_field, event_columns
from logweave.plans.flow import Flow
from logweave.plans.registry import default_registry
from logweave.session import shared_dir
from logweave.sinks.lines import write_files
from logweave.sources.follow import local_path
from logweave.streaming import query as streaming


def _registry():
    """The usual components plus a Parquet sink for chosen fields."""
    registry = default_registry()

    def table(df, path, fields):
        columns = [field_text(f).alias(f) for f in fields]
        df.select("id", *columns).write.mode("append").parquet(path)

    registry.register("sink", "table", table)
    return registry


def _events_stream(t):
    """The event table as a stream of open-layout events."""
    return _events_of(streaming.table_stream(t.spark, t.path("events")))


def _events_of(rows):
    pairs = [p for n in ("event_type", "user_id", "value") for p in (F.lit(n), F.col(n).cast("variant"))]
    return rows.select(
        *event_columns(
            rows, id=F.col("event_id").cast("string"), timestamp=F.col("ts").cast("timestamp"), source_name=F.lit("events"),
            raw_data=F.col("props"), fields=F.create_map(*pairs).cast(OPEN_MAP),
        )
    )


def _source():
    return [{"name": "events", "type": "file", "config": {"path": "given as rows"}}]


@query("stream_filter", "SELECT CAST(event_id AS VARCHAR) AS id, upper(event_type) AS event_type FROM events WHERE value > 12.5 AND event_type IN ('error', 'view')")
def stream_filter(t):
    folder = shared_dir(t.spark, "stream")
    flow = Flow(
        {
            "name": f"stream-filter-{folder[-8:]}", "sources": _source(),
            "processors": [
                {"name": "f", "type": "filter", "config": {"conditions": ["value > 12.5", "event_type in [error, view]"], "mode": "all"}},
                {"name": "m", "type": "mutate", "config": {"uppercase_fields": ["event_type"]}},
            ],
            "sinks": [{"name": "t", "type": "table", "config": {"path": f"{folder}/out", "fields": ["event_type"]}}],
        },
        _registry(),
    )
    streaming.start(flow, t.spark, f"{folder}/checkpoint", available_now=True, on_error="fail", rows=_events_stream(t)).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


@query(
    "stream_fan_out",
    """SELECT 'table' AS sink, CAST(event_id AS VARCHAR) AS id, event_type AS kind FROM events WHERE event_type <> 'click'
    UNION ALL SELECT 'lines', CAST(event_id AS VARCHAR), event_type FROM events WHERE event_type <> 'click'""",
)
def stream_fan_out(t):
    """Two good sinks get every row although a third one fails."""
    registry = _registry()

    def broken(df):
        raise RuntimeError("this sink always fails")

    registry.register("sink", "broken", broken)
    folder = shared_dir(t.spark, "fanout")
    flow = Flow(
        {
            "name": f"stream-fan-out-{folder[-8:]}", "sources": _source(),
            "processors": [{"name": "f", "type": "filter", "config": {"condition": "event_type != click"}}],
            "sinks": [
                {"name": "a", "type": "table", "config": {"path": f"{folder}/a", "fields": ["event_type"]}},
                {"name": "b", "type": "broken", "config": {}},
                {"name": "c", "type": "file", "config": {"path": f"{folder}/c", "format": "text", "template": "{id} {event_type}"}},
            ],
        },
        registry,
    )
    streaming.start(flow, t.spark, f"{folder}/checkpoint", available_now=True, rows=_events_stream(t)).awaitTermination()
    table = t.spark.read.parquet(f"{folder}/a").select(F.lit("table").alias("sink"), "id", F.col("event_type").alias("kind"))
    words = t.spark.read.text(f"{folder}/c").select(F.split("value", " ").alias("w"))
    lines = words.select(F.lit("lines").alias("sink"), F.get("w", F.lit(0)).alias("id"), F.get("w", F.lit(1)).alias("kind"))
    return table.unionByName(lines)


@query("stream_file_follow", f"SELECT {MICROS} AS time, {LEVEL} AS level, event_type AS kind FROM events")
def stream_file_follow(t):
    """Log files rolled into a folder in two steps; the second run sees the new files only."""
    folder = shared_dir(t.spark, "follow")
    lines = log_lines(t).select(F.col("raw_data").alias("value"), F.contains("raw_data", F.lit("(click)")).alias("click"))
    flow = Flow(
        {
            "name": f"follow-{folder[-8:]}",
            "sources": [{"name": "in", "type": "file", "config": {"path": f"{folder}/in", "read_from_start": True}}],
            "processors": [{"name": "g", "type": "grok", "config": {"patterns": ["%{TIMESTAMP_ISO8601:time} %{LOGLEVEL:level} .*\\(%{WORD:kind}\\)"]}}],
            "sinks": [{"name": "t", "type": "table", "config": {"path": f"{folder}/out", "fields": ["time", "level", "kind"]}}],
        },
        _registry(),
    )
    for part in ("click", "NOT click"):
        lines.where(part).select("value").write.mode("append").text(f"{folder}/in")
        streaming.start(flow, t.spark, f"{folder}/checkpoint", available_now=True, on_error="fail").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").drop("id")


def _grow(lines, folder):
    """Lines added to the live files of a folder, by the tasks that have them."""
    names = F.concat(F.lit(f"{folder}/"), F.spark_partition_id().cast("string"), F.lit(".log"))

    def add(rows):
        file = None
        for row in rows:
            file = file or open(row.name, "ab")  # noqa: SIM115
            file.write(row.value.encode() + b"\n")
        if file:
            file.close()

    lines.select("value", names.alias("name")).foreachPartition(add)


@query("stream_file_grow", f"SELECT {MICROS} AS time, {LEVEL} AS level, event_type AS kind FROM events")
def stream_file_grow(t):
    """Live files that are begun, grow, and are replaced by others: over four runs each line arrives once."""
    folder = shared_dir(t.spark, "grow")
    live = local_path(f"{folder}/in")
    os.makedirs(live)
    lines = log_lines(t).select(F.col("raw_data").alias("value")).repartition(5, F.hash("value"))
    flow = Flow(
        {
            "name": f"grow-{folder[-8:]}",
            "sources": [{"name": "in", "type": "file", "config": {"path": live, "growing": True, "read_from_start": True, "split_bytes": 20_000}}],
            "processors": [{"name": "g", "type": "grok", "config": {"patterns": ["%{TIMESTAMP_ISO8601:time} %{LOGLEVEL:level} .*\\(%{WORD:kind}\\)"]}}],
            "sinks": [{"name": "t", "type": "table", "config": {"path": f"{folder}/out", "fields": ["time", "level", "kind"]}}],
        },
        _registry(),
    )
    for part in ("value LIKE '%(click)'", "value LIKE '%(view)'", "value LIKE '%(error)'", "NOT value RLIKE '[(](click|view|error)[)]$'"):
        if "error" in part and "NOT" not in part:
            for name in os.listdir(live):
                os.remove(f"{live}/{name}")
        _grow(lines.where(part), live)
        streaming.start(flow, t.spark, f"{folder}/checkpoint", available_now=True, on_error="fail").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").drop("id")


@query(
    "stream_objects",
    "SELECT role, text AS raw_data FROM (SELECT role, unnest(str_split(text, e'\\n')) AS text FROM conversations) WHERE trim(text, e' \\t\\n\\r') <> ''",
)
def stream_objects(t):
    """Objects under a prefix, taken as they appear: each object is read once over two runs."""
    folder = shared_dir(t.spark, "objects")
    talks = t("conversations").select(F.col("text").alias("value"), "role")
    flow = Flow(
        {
            "name": f"objects-{folder[-8:]}",
            "sources": [{"name": "in", "type": "s3", "config": {"bucket": f"{folder}/in", "prefix": "role=", "scheme": None}}],
            "processors": [
                {"name": "key", "type": "regex", "config": {"pattern": "^(?P<line>.*)$"}},
                {"name": "role", "type": "source_role", "config": {}},
            ],
            "sinks": [{"name": "t", "type": "table", "config": {"path": f"{folder}/out", "fields": ["role", "line"]}}],
        },
        _with_role(_registry()),
    )
    for part in ("role = 'user'", "role <> 'user'"):
        talks.where(part).write.mode("append").partitionBy("role").text(f"{folder}/in")
        streaming.start(flow, t.spark, f"{folder}/checkpoint", available_now=True, on_error="fail").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("role", F.col("line").alias("raw_data"))


def _with_role(registry):
    """A custom processor: the role in the object key becomes a field."""
    key = "regexp_extract(source_name, 'role=([^/]+)/', 1)"
    registry.register("processor", "source_role", lambda: lambda df: add_field(df, "role", F.expr(key)))
    return registry


@query(
    "stream_counters",
    """SELECT CAST(count_if(event_type <> 'click' AND value > 5) AS BIGINT) AS events_processed,
    CAST(count_if(NOT (event_type <> 'click' AND value > 5)) AS BIGINT) AS events_dropped, CAST(0 AS BIGINT) AS processing_errors FROM events""",
)
def stream_counters(t):
    """Counters read from the progress of a finished stream."""
    folder = shared_dir(t.spark, "counters")
    flow = Flow(
        {
            "name": f"counters-{folder[-8:]}", "sources": _source(),
            "processors": [
                {"name": "a", "type": "filter", "config": {"condition": "event_type != click"}},
                {"name": "b", "type": "filter", "config": {"condition": "value > 5"}},
            ],
            "sinks": [{"name": "t", "type": "table", "config": {"path": f"{folder}/out", "fields": ["event_type"]}}],
        },
        _registry(),
    )
    query_ = streaming.start(flow, t.spark, f"{folder}/checkpoint", available_now=True, count=True, on_error="fail", rows=_events_stream(t))
    query_.awaitTermination()
    status = streaming.status(flow, query_)
    row = tuple(status[k] for k in ("events_processed", "events_dropped", "processing_errors"))
    return t.spark.createDataFrame([row], "events_processed bigint, events_dropped bigint, processing_errors bigint")


def _unreliable(failures: int):
    """Components with a sink that writes its rows and then fails, so many times before it works."""
    registry, left = _registry(), [failures]

    def lines(df, path, batch_id=None):
        write_files(df, path, "text", template="{id} {event_type}", batch_id=batch_id)
        if left[0]:
            left[0] -= 1
            raise RuntimeError("failed after the write")

    registry.register("sink", "unreliable", lines)
    return registry


def _two_sinks(folder, registry):
    return Flow(
        {
            "name": f"two-{folder[-8:]}", "sources": _source(),
            "processors": [{"name": "f", "type": "filter", "config": {"condition": "event_type != view"}}],
            "sinks": [
                {"name": "good", "type": "file", "config": {"path": f"{folder}/good", "format": "text", "template": "{id} {event_type}"}},
                {"name": "bad", "type": "unreliable", "config": {"path": f"{folder}/bad"}},
            ],
        },
        registry,
    )


def _delivered(t, folder):
    words = [t.spark.read.text(f"{folder}/{sink}").select(F.lit(sink).alias("sink"), F.split("value", " ").alias("w")) for sink in ("good", "bad")]
    return words[0].union(words[1]).select("sink", F.get("w", F.lit(0)).alias("id"), F.get("w", F.lit(1)).alias("kind"))


_BOTH = " UNION ALL ".join(f"SELECT '{sink}' AS sink, CAST(event_id AS VARCHAR) AS id, event_type AS kind FROM events WHERE event_type <> 'view'" for sink in ("good", "bad"))


@query("stream_replay", _BOTH)
def stream_replay(t):
    """A batch that ended in a failure is run again: the sink that has it is left out, the other replaces what it wrote."""
    folder = shared_dir(t.spark, "replay")
    flow = _two_sinks(folder, _unreliable(1))
    for turn in range(2):
        query_ = streaming.start(flow, t.spark, f"{folder}/checkpoint", available_now=True, on_error="fail", rows=_events_stream(t))
        try:
            query_.awaitTermination()
        except StreamingQueryException:
            if turn:
                raise
    return _delivered(t, folder)


@query("stream_sink_failure", _BOTH)
def stream_sink_failure(t):
    """A sink that fails for a while gets the rows of those batches later, each once."""
    folder = shared_dir(t.spark, "failure")
    t("events").repartition(3, "user_id").write.parquet(f"{folder}/in")
    rows = _events_of(streaming.table_stream(t.spark, f"{folder}/in", t("events").schema, max_files=1))
    streaming.start(_two_sinks(folder, _unreliable(2)), t.spark, f"{folder}/checkpoint", available_now=True, rows=rows).awaitTermination()
    return _delivered(t, folder)


@query(
    "flow_status",
    """SELECT 1 AS sources, 1 AS processors, 2 AS sinks, CAST(count_if(event_type <> 'view') AS BIGINT) AS events_processed,
    CAST(count_if(event_type = 'view') AS BIGINT) AS events_dropped, CAST(2 AS BIGINT) AS processing_errors, FALSE AS running FROM events""",
)
def flow_status(t):
    """The status row of a stream of several batches, two of which a sink failed in."""
    folder = shared_dir(t.spark, "status")
    t("events").repartition(5, "user_id").write.parquet(f"{folder}/in")
    rows = _events_of(streaming.table_stream(t.spark, f"{folder}/in", t("events").schema, max_files=1))
    flow = _two_sinks(folder, _unreliable(2))
    query_ = streaming.start(flow, t.spark, f"{folder}/checkpoint", available_now=True, count=True, rows=rows)
    query_.awaitTermination()
    status = streaming.status(flow, query_)
    del status["failures"]
    return metrics.status_row(t.spark, **status).drop("name", "uptime").selectExpr(
        "int(sources) AS sources", "int(processors) AS processors", "int(sinks) AS sinks", "events_processed", "events_dropped", "processing_errors", "running"
    )


@query("batch_flow", "SELECT CAST(event_id AS VARCHAR) AS id, CASE event_type WHEN 'view' THEN 'visit' ELSE 'other' END AS meaning FROM events WHERE event_type <> 'error'")
def batch_flow(t):
    """The chain of a declared flow over the whole table, as a batch."""
    flow = Flow(
        {
            "name": "batch", "sources": _source(), "sinks": [{"name": "o", "type": "file", "config": {"path": "unused"}}],
            "processors": [
                {"name": "f", "type": "FilterProcessor", "config": {"condition": "exists:value"}},
                {"name": "e", "type": "enrich", "config": {
                    "enrich_type": "lookup", "source_field": "event_type", "target_field": "meaning",
                    "lookup_table": {"view": "visit"}, "default_value": "other"}},
            ],
        }
    )
    return flow.transform(open_events(t)).select("id", field_text("meaning").alias("meaning"))


@query(
    "stream_two_flows",
    """SELECT 'a' AS flow, CAST(event_id AS VARCHAR) AS id FROM events WHERE event_type = 'click'
    UNION ALL SELECT 'b', CAST(event_id AS VARCHAR) FROM events WHERE event_type <> 'click'""",
)
def stream_two_flows(t):
    """Two flows of one session side by side, each with a checkpoint of its own."""
    folder = shared_dir(t.spark, "two-flows")
    queries = []
    for name, condition in (("a", "event_type == click"), ("b", "event_type != click")):
        flow = Flow(
            {
                "name": f"{name}-{folder[-8:]}", "sources": _source(),
                "processors": [{"name": "f", "type": "filter", "config": {"condition": condition}}],
                "sinks": [{"name": "t", "type": "table", "config": {"path": f"{folder}/{name}", "fields": ["event_type"]}}],
            },
            _registry(),
        )
        queries.append(streaming.start(flow, t.spark, f"{folder}/checkpoint-{name}", available_now=True, on_error="fail", rows=_events_stream(t)))
    for query_ in queries:
        query_.awaitTermination()
    parts = [t.spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("flow"), "id") for name in ("a", "b")]
    return parts[0].union(parts[1])


@query("custom_source", "SELECT CAST(event_id AS VARCHAR) AS id, event_type FROM events WHERE event_type <> 'view'")
def custom_source(t):
    """A source and a sink of one's own, named in a declaration; the flow reads, filters and writes as a batch."""
    folder, registry = shared_dir(t.spark, "custom-source"), _registry()
    registry.register("source", "pkg.EventTableSource", lambda spark, path: _events_of(spark.read.parquet(path)))
    spec = {
        "name": "custom", "sources": [{"name": "in", "type": "eventtable", "config": {"path": t.path("events")}}],
        "processors": [{"name": "f", "type": "filter", "config": {"condition": "event_type != view"}}],
        "sinks": [{"name": "t", "type": "table", "config": {"path": f"{folder}/out", "fields": ["event_type"]}}],
    }
    Flow(spec, registry).run_batch(t.spark, on_error="fail")
    return t.spark.read.parquet(f"{folder}/out")
