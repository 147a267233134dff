"""Declared flows as batch and as stream."""

import json

import pytest
from pyspark.sql import functions as F

from logweave import ConfigError, Flow, default_registry, filter_events, load_spec, metrics, python_step
from logweave.streaming import query as streaming


def _spec(src, dst, **more):
    return {
        "name": more.pop("name", "errors"),
        "sources": [{"name": "in", "type": "file", "config": {"path": src, "read_from_start": True, "poll_interval": 1.0}}],
        "processors": [
            {"name": "parse", "type": "json", "config": {"field": "raw_data", "target_field": ""}},
            {"name": "keep", "type": "FilterProcessor", "config": {"condition": "level in [ERROR, CRITICAL]", "mode": "all"}},
            {"name": "slow", "type": "filter", "config": {"condition": "ms > 10"}},
        ],
        "sinks": [
            {"name": "out", "type": "FileSink", "config": {"path": f"{dst}/text", "format": "text", "template": "[{level}] {service}: {message}"}},
            {"name": "doc", "type": "file", "config": {"path": f"{dst}/json"}},
        ],
        **more,
    }


LINES = [
    {"level": "ERROR", "service": "web", "message": "a", "ms": 20}, {"level": "INFO", "service": "web", "message": "b", "ms": 30},
    {"level": "CRITICAL", "service": "db", "message": "c", "ms": "11"}, {"level": "ERROR", "service": "db", "message": "d", "ms": "slow"},
    {"level": "ERROR", "message": "e", "ms": 11.5}, {"level": "ERROR", "ms": 1},
]
WANTED = ["[CRITICAL] db: c", "[ERROR] web: a"]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join([json.dumps(x) for x in LINES] + ["broken {", ""]))
    return tmp_path


def _texts(spark, path):
    # Rendered lines first, fallback lines (which start with a time) last.
    return sorted((r.value for r in spark.read.text(str(path)).collect()), key=lambda v: (v[0] != "[", v))


def test_batch_with_counters(spark, folder):
    status = Flow(_spec(str(folder / "in"), str(folder / "out"))).run_batch(spark, count=True)
    lines = _texts(spark, folder / "out" / "text")
    assert lines[:2] == WANTED and len(lines) == 3 and lines[2].endswith(json.dumps(LINES[4]))
    assert len(_texts(spark, folder / "out" / "json")) == 3
    assert {k: status[k] for k in metrics.COUNTERS} == {"events_processed": 3, "events_dropped": 4, "processing_errors": 1}
    assert (status["name"], status["sources"], status["processors"], status["sinks"], status["failures"]) == ("errors", 1, 3, 2, [])


def test_audit_names_the_stage(spark, folder):
    flow = Flow(_spec(str(folder / "in"), "x"))
    rows = flow.audit(flow.read(spark)).select("raw_data", "_status.*").collect()
    fate = {r.raw_data: (r.state, r.stage) for r in rows}
    assert fate["broken {"] == ("filtered", "json")
    assert fate[json.dumps(LINES[1])] == ("filtered", "filter")
    assert fate[json.dumps(LINES[3])] == ("error", "filter")
    assert sum(state == "ok" for state, _ in fate.values()) == 3


def test_stream_equals_batch_and_resumes(spark, folder):
    flow = Flow(_spec(str(folder / "in"), str(folder / "out"), name="follow"))
    checkpoint = str(folder / "cp")
    query = streaming.start(flow, spark, checkpoint, available_now=True, count=True)
    query.awaitTermination(60)
    first = _texts(spark, folder / "out" / "text")
    assert first[:2] == WANTED and len(first) == 3
    status = streaming.status(flow, query)
    assert (status["events_processed"], status["events_dropped"], status["processing_errors"]) == (3, 4, 1)
    (folder / "in" / "b.log").write_text(json.dumps(LINES[0]))
    streaming.start(flow, spark, checkpoint, available_now=True).awaitTermination(60)
    assert _texts(spark, folder / "out" / "text") == sorted(first + [WANTED[1]], key=lambda v: (v[0] != "[", v))


def test_same_name_replaces(spark, folder):
    flow = Flow(_spec(str(folder / "in"), str(folder / "out"), name="again", batch_timeout=0.2))
    one = streaming.start(flow, spark, str(folder / "c1"))
    two = streaming.start(flow, spark, str(folder / "c2"))
    try:
        assert not one.isActive and two.isActive
        assert list(streaming.running(spark)) == ["again"]
    finally:
        streaming.stop(spark, "again")
    with pytest.raises(KeyError):
        streaming.stop(spark, "again")


def test_failing_sink_is_isolated(spark, folder):
    registry = default_registry()

    def broken(df, **_):
        raise RuntimeError("disk full")

    registry.register("sink", "broken", broken)
    spec = _spec(str(folder / "in"), str(folder / "out"))
    spec["sinks"].insert(0, {"name": "bad", "type": "broken", "config": {}})
    status = Flow(spec, registry).run_batch(spark)
    assert status["failures"] == ["bad: disk full"]
    assert len(_texts(spark, folder / "out" / "text")) == 3
    with pytest.raises(RuntimeError, match="disk full"):
        Flow(spec, registry).run_batch(spark, on_error="fail")
    query = streaming.start(Flow(spec, registry), spark, str(folder / "c"), available_now=True, on_error="fail")
    with pytest.raises(Exception):
        query.awaitTermination(60)


def test_failures_are_counted(spark, folder):
    """A batch without a working sink ends, and a stream tells what its sinks lost."""
    registry = default_registry()

    def broken(df, **_):
        raise RuntimeError("disk full")

    registry.register("sink", "broken", broken)
    spec = _spec(str(folder / "in"), str(folder / "out"))
    spec["sinks"] = [{"name": "bad", "type": "broken", "config": {}}]
    status = Flow(spec, registry).run_batch(spark, count=True)
    assert status["failures"] == ["bad: disk full"] and status["processing_errors"] == 1
    flow = Flow(spec, registry)
    query = streaming.start(flow, spark, str(folder / "c"), available_now=True)
    query.awaitTermination()
    status = streaming.status(flow, query)
    assert status["processing_errors"] == len(status["failures"]) >= 1


def test_custom_components(spark, folder, read_events):
    registry = default_registry()
    registry.register("processor", "pkg.Tagger", lambda text: lambda df: df.withColumn("tags", F.array(F.lit(text))))

    def shout(event):
        if event["fields"]["level"] == "INFO":
            return None
        event["fields"]["level"] += "!"
        return event

    registry.register("processor", "shout", lambda: python_step(shout))
    spec = _spec(str(folder / "in"), "x")
    spec["processors"] = spec["processors"][:1] + [
        {"name": "t", "type": "Tagger", "config": {"text": "seen"}}, {"name": "s", "type": "shout", "config": {}},
    ]
    flow = Flow(spec, registry)
    got = read_events(flow.transform(flow.read(spark))).values()
    assert len(got) == 5 and all(e["tags"] == ["seen"] and e["fields"]["level"].endswith("!") for e in got)


@pytest.mark.parametrize(
    "change, message",
    [
        ({"name": None}, "Missing required configuration key: name"), ({"sources": None}, "Missing required configuration key: sources"),
        ({"sinks": None}, "Missing required configuration key: sinks"), ({"sources": []}, "At least one source must be configured"),
        ({"sinks": []}, "At least one sink must be configured"), ({"sources": ["x"]}, "Invalid source configuration at index 0"),
        ({"sources": [{"type": "file", "config": {}}]}, "Source at index 0 is missing a name"),
        ({"sinks": [{"name": "n", "config": {}}]}, "Sink at index 0 is missing a type"),
        ({"processors": [{"name": "n", "type": "json"}]}, "Processor at index 0 is missing a valid config"),
        ({"processors": {}}, "Processors must be a list"),
    ],
)
def test_bad_declarations(change, message):
    spec = _spec("a", "b")
    for key, value in change.items():
        if value is None:
            del spec[key]
        else:
            spec[key] = value
    with pytest.raises(ConfigError) as error:
        Flow(spec)
    assert str(error.value) == message


def test_unknown_type_and_spec_files(tmp_path):
    spec = _spec("a", "b")
    spec["sinks"][0]["type"] = "nowhere"
    with pytest.raises(ValueError, match="Unknown sink type: nowhere"):
        Flow(spec)
    (tmp_path / "f.yaml").write_text("name: x\nsources: []\n")
    assert load_spec(str(tmp_path / "f.yaml")) == {"name": "x", "sources": []}
    (tmp_path / "g.json").write_text("[]")
    with pytest.raises(ConfigError):
        load_spec(str(tmp_path / "g.json"))


def test_windows_flow(spark, tmp_path, read_events):
    """The whole chain on event records: parse, extract, change, enrich, filter."""
    records = [
        {"@timestamp": "2024-01-01T00:00:00Z", "message": f"Logon. User: {user}, Source: ws-{i}, Computer: c",
         "winlog": {"channel": "Security", "level": level, "event_id": event_id, "computer_name": "C1", "provider": {"name": "P"}}}
        for i, (user, level, event_id) in enumerate([("DOM\\bob", 3, "4625"), ("amy", 4, "9"), ("joe", 1, "4625")])
    ]
    (tmp_path / "w.json").write_text("\n".join(json.dumps(r) for r in records))
    spec = {
        "name": "win",
        "sources": [{"name": "w", "type": "winlog", "config": {"mode": "file", "path": str(tmp_path / "w.json"), "level": 3, "tail": True}}],
        "processors": [
            {"name": "j", "type": "json", "config": {"target_field": "", "ignore_errors": True}},
            {"name": "r", "type": "regex", "config": {"field": "message", "pattern": r"User: (?<username>[\w\\]+).*Source: (?<source>[\w-]+)"}},
            {"name": "g", "type": "grok", "config": {"field": "message", "patterns": ["%{TIMESTAMP_ISO8601:t} %{LOGLEVEL:l}"]}},
            {"name": "m", "type": "mutate", "config": {
                "add_fields": {"platform": "windows"}, "rename_fields": {"computer_name": "hostname"}, "convert_fields": {"event_id": "int"}}},
            {"name": "e", "type": "enrich", "config": {
                "enrich_type": "lookup", "source_field": "event_id", "target_field": "event_description",
                "lookup_table": {"4625": "Failed logon attempt"}, "default_value": "Unknown event"}},
            {"name": "f", "type": "filter", "config": {"conditions": ["event_id in [4625]", "level == 4"], "mode": "any"}},
        ],
        "sinks": [{"name": "o", "type": "file", "config": {"path": str(tmp_path / "o")}}],
    }
    flow = Flow(spec)
    got = sorted(read_events(flow.transform(flow.read(spark))).values(), key=lambda e: e["fields"]["source"])
    assert [e["fields"]["username"] for e in got] == ["DOM\\bob", "amy"]
    assert [e["fields"]["event_id"] for e in got] == [4625, 9]
    assert [e["fields"]["event_description"] for e in got] == ["Failed logon attempt", "Unknown event"]
    assert all(e["fields"]["hostname"] == "C1" and e["fields"]["winlog"]["channel"] == "Security" for e in got)


def test_rollup(spark):
    rows = [("a", True, 1, 1, 1, 100, 10, 5, 0.0), ("b", True, 1, 2, 1, 200, 20, 10, 0.0), ("a", False, 1, 1, 1, 1, 0, 0, 0.0)]
    got = {r.name: r for r in metrics.rollup(spark.createDataFrame(rows, metrics.METRICS_SCHEMA)).collect()}
    assert (got["a"].events_processed, got["a"].events_dropped, got["a"].flows) == (101, 10, 1)
    total = got[None]
    assert (total.events_processed, total.events_dropped, total.processing_errors, total.flows) == (301, 30, 15, 2)
    row = metrics.status_row(spark, name="a", running=False, sources=1, processors=0, sinks=1, events_processed=1,
                             events_dropped=0, processing_errors=0, uptime=0.5)
    assert row.count() == 1


def test_typed_rows_can_be_audited(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "n string")
    from logweave.operators.base import reason

    out = filter_events("n > 0").audited(df.withColumn("_status", reason("ok", "", F.lit(""))), "_status")
    assert [r._status.state for r in out.collect()] == ["ok", "error", "filtered"]
    failed = metrics.errors(out).collect()
    assert [(r.n, r.error_stage, r.error_message) for r in failed] == [("x", "filter", "not a number")]


def _flow_with(sink, folder, **change):
    registry = default_registry()
    registry.register("sink", "own", sink)
    spec = _spec(str(folder / "in"), str(folder / "out"), **change)
    spec["sinks"] = [{"name": "own", "type": "own", "config": {}}]
    return Flow(spec, registry)


def test_counted_batch_with_a_lazy_sink_ends(spark, folder):
    """A sink that runs no query leaves nothing observed; the batch must not wait for it."""
    status = _flow_with(lambda df: df.createOrReplaceTempView("lazy"), folder).run_batch(spark, count=True)
    assert status["failures"] == [] and status["events_processed"] == 0


def test_lone_sink_gets_what_it_failed_on(spark, folder):
    """The rows of a failed batch are kept and delivered by the next start, which has no new rows."""
    got, fails = [], [True]

    def sink(df):
        if fails:
            fails.pop()
            raise RuntimeError("down")
        got.extend(r.raw_data for r in df.collect())

    flow = _flow_with(sink, folder)
    for _ in range(3):
        streaming.start(flow, spark, str(folder / "c"), available_now=True, count=True).awaitTermination()
    assert len(got) == 3 and flow.ledger.totals() == {"events_processed": 3, "events_dropped": 4, "processing_errors": 1}
    assert not any("rows" in flow.ledger.files.names(f"batch={b}") for b in flow.ledger.batches())


def test_counters_of_many_batches(spark, tmp_path):
    """More batches than the progress of a query keeps."""
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        (tmp_path / "in").mkdir()
        for i in range(6):
            (tmp_path / "in" / f"{i}.log").write_text(json.dumps(LINES[0]))
        spec = _spec(str(tmp_path / "in"), str(tmp_path / "out"), name="many")
        spec["sources"][0]["config"]["max_files_per_trigger"] = 1
        spec["sources"][0]["config"]["read_from_start"] = True
        flow = Flow(spec)
        query = streaming.start(flow, spark, str(tmp_path / "c"), available_now=True, count=True)
        query.awaitTermination()
        assert len(query.recentProgress) < 6
        assert streaming.status(flow, query)["events_processed"] == 6
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
