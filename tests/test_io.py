"""Event model, sources and sinks."""

import random
import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from logweave import add_field, add_metadata, add_tag, from_documents, to_events
from logweave.model import event_document
from logweave.sinks import lines as out, search
from logweave.sources import kafka as mq, text as src, union, winlog as win


def test_event_defaults_and_changes(spark, read_events):
    df = to_events(spark.range(2), source_type=F.lit("test"), raw_data=F.lit("line"))
    df = add_tag(add_tag(add_tag(df, "a"), "b"), "a")
    df = add_metadata(add_field(add_field(df, "f", 1), "f", {"x": [True]}), "seconds", 0.5)
    got = read_events(df)
    assert len(got) == 2
    for event in got.values():
        assert event["fields"] == {"f": {"x": [True]}} and event["metadata"] == {"seconds": 0.5}
        assert event["tags"] == ["a", "b"] and event["timestamp"]


def test_document_round_trip(spark):
    document = {
        "id": "test-id", "timestamp": "2023-01-01T12:00:00.250000", "source_type": "t", "source_name": "n", "raw_data": "r",
        "fields": {"level": "INFO", "n": None, "deep": {"a": [1, {"b": False}]}}, "metadata": {"k": 1}, "tags": ["x"],
    }
    df = spark.createDataFrame([(json.dumps(document),), ('{"raw_data": "r"}',)], "value string")
    events = from_documents(df)
    first, second = (json.loads(r[0]) for r in events.select(event_document(events)).collect())
    assert first == document
    assert second["id"] and second["timestamp"] and second["fields"] == {} and second["tags"] == []


def test_file_source(spark, tmp_path):
    (tmp_path / "b.log").write_bytes("line 1\r\n  padded \n\n \t\nünï\n".encode())
    os.utime(tmp_path / "b.log", (1000, 1000))
    (tmp_path / "a.log").write_text("second file")
    rows = src.files(spark, str(tmp_path), with_position=True, in_file_order=True).collect()
    assert [r.raw_data for r in rows] == ["line 1", "padded", "ünï", "second file"]
    assert [r.source_type for r in rows] == ["file"] * 4
    places = [json.loads(r.metadata["file_position"].toJson()) for r in rows]
    assert places == [0, 7, 21, 0]
    assert rows[0].source_name.endswith("b.log")
    again = src.files(spark, str(tmp_path), with_position=True, in_file_order=True).collect()
    assert [r.id for r in again] == [r.id for r in rows]
    late = src.files(spark, str(tmp_path), read_from_start=False, started_at="2000-01-01 00:00:00")
    assert [r.raw_data for r in late.collect()] == ["second file"]


def test_file_position_over_many_splits(spark, tmp_path):
    lines = [("é" * (i % 13)) + str(i) for i in range(20000)]
    (tmp_path / "big.log").write_text("\n".join(lines) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = src.with_file_position(src._lines(spark, str(tmp_path))).select("position", "value", "block").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.block for r in got}) > 5
    want, at = set(), 0
    for line in lines:
        want.add((at, line))
        at += len(line) + 1
    assert {(r.position, r.value) for r in got} == want


def test_objects(spark, tmp_path):
    for key, text in {"logs/a/1.log": " x \n\n y\n", "logs/b+c d.log": "z", "other/2.log": "no"}.items():
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_text(text)
    rows = src.objects(spark, str(tmp_path), "logs/", scheme="file").collect()
    got = {(r.metadata["s3_key"].toPython(), r.raw_data) for r in rows}
    assert got == {("logs/a/1.log", " x "), ("logs/a/1.log", " y"), ("logs/b+c d.log", "z")}
    seen = spark.createDataFrame([("logs/a/1.log",)], "key string")
    left = src.objects(spark, str(tmp_path), "logs/", scheme="file", processed=seen).collect()
    assert [r.raw_data for r in left] == ["z"]


def test_kafka_rows(spark):
    when = dt.datetime(2024, 1, 1, 0, 0, 1)
    rows = spark.createDataFrame(
        [
            (b"k", "héllo".encode(), "t", 0, 5, when), (None, b"A\xff", "t", 1, 6, when), (b"", None, "t", 1, 7, when),
        ],
        "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp",
    )
    events = mq.kafka_events(rows, {"environment": "prod", "kafka_partition": "own"}).collect()
    assert [e.raw_data for e in events] == ["héllo", "41ff", "None"]
    meta = [{k: v.toPython() for k, v in e.metadata.items()} for e in events]
    assert meta[0] == {
        "kafka_topic": "t", "kafka_partition": "own", "kafka_offset": 5, "kafka_timestamp": 1704067201000,
        "kafka_key": "k", "environment": "prod",
    }
    assert "decode_error" in meta[1] and "decode_error" not in meta[2] and meta[1]["kafka_key"] is None
    assert len({e.id for e in events}) == 3
    options = mq.kafka_options(["a:1", "b:2"], ["x", "y"], "g", "earliest", 500)
    assert options["subscribe"] == "x,y" and options["startingOffsets"] == "earliest" and options["maxOffsetsPerTrigger"] == "500"


def _record(channel="Security", level=3, event_id="4625", provider=None, **extra):
    record = {"channel": channel, "level": level, "event_id": event_id, "record_id": 9, "computer_name": "C", **extra}
    record["provider" if provider is None else "provider_name"] = {"name": "P"} if provider is None else provider
    return {"@timestamp": "2024-01-01T00:00:00.5Z", "message": "m", "winlog": record}


def test_winlog(spark, read_events):
    records = [
        _record(), _record(channel="Setup"), _record(level="2"), _record(level="x"), _record(level=None), _record(event_id="1"),
        _record(provider="Q", user={"name": "u"}, event_data={"a": 1}), {"message": "no winlog"}, {"winlog": None}, "winlog",
    ]
    lines = [json.dumps(r) for r in records] + ["{broken winlog", ""]
    df = spark.createDataFrame([(line,) for line in lines], "value string")

    def kept(**kw):
        raw = win.winlog_events(df, **kw).select("raw_data").collect()
        return sorted(records.index(json.loads(r.raw_data)) for r in raw)

    assert kept() == [0, 2, 3, 4, 5, 6]
    assert kept(channels=[]) == [0, 1, 2, 3, 4, 5, 6]
    assert kept(level=3) == [0, 5, 6]
    assert kept(event_ids=[4625], level=2) == [0, 2, 6]
    assert kept(providers=["Q"]) == [6]
    event = next(e for e in read_events(win.winlog_events(df, providers=["Q"])).values())
    assert event["fields"] == {
        "event_id": "4625", "level": 3, "provider": "Q", "computer_name": "C", "record_id": 9, "task": None, "keywords": None,
        "message": "m", "host": {}, "event_data": {"a": 1}, "user": {"name": "u"},
    }
    assert event["timestamp"] == "2024-01-01T00:00:00.500000" and event["source_name"] == "Security"
    assert event["metadata"] == {"winlog_source": "file", "winlog_channel": "Security"}
    with pytest.raises(ValueError):
        win.winlog_events(df, level=9)


def test_fan_in(spark):
    a = spark.createDataFrame([(1,), (2,)], "id bigint")
    b = spark.createDataFrame([(3, "x")], "id bigint, x string")
    assert sorted(tuple(r) for r in union.fan_in(a, b).fillna("-").collect()) == [(1, "-"), (2, "-"), (3, "x")]


def _sink_events(make_events):
    rows = [{"level": "INFO", "message": "m1"}, {"level": "ERROR"}, {"message": "m3"}, {"level": None, "timestamp": "own"}]
    return make_events(rows, ["raw 1", "raw 2", "raw 3", "raw 4"])


def test_template(make_events, spark):
    df = _sink_events(make_events)

    def render(d, *args):
        return [r[0] for r in d.orderBy("id").select(out.render_template(d, *args)).collect()]

    assert render(df, "{timestamp} [{level}] {message}") == [
        "2023-01-01T12:00:00 [INFO] m1", "2023-01-01T12:00:00 [ERROR] raw 2", "2023-01-01T12:00:00 raw 3", "own [None] raw 4",
    ]
    assert render(df, "{{x}} {id} {message}", "level")[:2] == ["{x} e0 INFO", "{x} e1 ERROR"]
    typed = spark.createDataFrame([("a", "r", 1.0, True), ("b", "q", None, None)], "id string, raw_data string, x double, f boolean")
    typed = typed.withColumn("timestamp", F.lit("2023-01-01 12:00:00.5").cast("timestamp"))
    assert render(typed, "{x} {f}") == ["1.0 True", "2023-01-01T12:00:00.500000 q"]
    with pytest.raises(ValueError):
        out.render_template(df, "{level:>5}")


def test_write_files(make_events, spark, tmp_path):
    df = _sink_events(make_events)
    path = str(tmp_path / "o")
    out.write_files(df, path)
    out.write_files(df, path)
    assert spark.read.text(path).count() == 8
    out.write_files(df, path, append=False, format="text", template="{message}")
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["m1", "m3", "raw 2", "raw 4"]
    for bad in ({"path": ""}, {"path": path, "format": "xml"}):
        with pytest.raises(ValueError):
            out.write_files(df, **bad)


@pytest.mark.parametrize("prefix", ["log[1]/", "log[1]/x*", "log[1]/{a", "log[1]/b?"])
def test_objects_of_a_prefix_that_reads_like_a_pattern(spark, tmp_path, prefix):
    for folder, name in (("log[1]", "x*1"), ("log[1]", "{a}"), ("log[1]", "b?"), ("log[1]", "xy"), ("log[1]", "bc"), ("log1", "x*1")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(f"{folder}/{name}\n")
    want = {f"log[1]/{n}" for n in ("x*1", "{a}", "b?", "xy", "bc") if f"log[1]/{n}".startswith(prefix)}
    assert {r["raw_data"] for r in src.objects(spark, str(tmp_path), prefix, scheme="file").collect()} == want


def test_write_objects(make_events, spark, tmp_path):
    df = _sink_events(make_events)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    out.write_objects(df, str(tmp_path), "logs", scheme="file", buffer_size=1 << 20)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) == before
    found = spark.read.text(str(tmp_path / "logs" / "year=2023" / "month=01" / "day=01" / "hour=12"))
    assert {json.loads(r.value)["id"] for r in found.collect()} == {"e0", "e1", "e2", "e3"}


def test_bulk_files_hold_several_requests(make_events, tmp_path):
    df = make_events([{"n": i, "text": "two\nlines"} for i in range(25)]).coalesce(1)
    search.write_bulk_files(df, str(tmp_path / "bulk"), batch_size=3, requests_per_file=4)
    sizes = sorted(len(p.read_text().splitlines()) for p in (tmp_path / "bulk").glob("part-*"))
    assert sizes == [2, 24, 24]
    with pytest.raises(ValueError):
        search.write_bulk_files(df, str(tmp_path / "none"), batch_size=0)


def test_bulk(make_events, spark, tmp_path):
    df = _sink_events(make_events)
    actions = search.bulk_actions(df, "logs-{yyyy.MM.dd}-{HH}").orderBy("_id").collect()
    assert actions[0]._index == "logs-2023.01.01-12" and actions[0]._id == "e0"
    assert json.loads(actions[0]._source)["fields"]["message"] == "m1"
    names = spark.range(1).select(
        search.index_name("a-{yyyy}.{MM}.{dd}", F.lit("2024-02-03 04:05:06").cast("timestamp")).alias("n")
    )
    assert names.first().n == "a-2024.02.03"
    search.write_bulk_files(df, str(tmp_path / "bulk"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "bulk"), wholetext=True).collect())
    lines = [json.loads(x) for x in text.split("\n") if x]
    assert len(lines) == 8
    for action, document in zip(lines[::2], lines[1::2]):
        assert action["index"]["_id"] == document["id"]
    for bad in ("logs-{week}", "logs-{yyyy"):
        with pytest.raises(ValueError):
            search.index_name(bad)
    options = search.connector_options(["h:9"], username="u", password="p", api_key="k")
    assert options["es.net.http.auth.user"] == "u" and "es.net.http.header.Authorization" not in options


@pytest.mark.parametrize("prefix,want", [("", {"a", "b", "c", "d", "e"}), ("p/", {"a", "b", "c"}), ("_q", {"d"}), ("p/.h", {"c"}), ("nothing", set())])
def test_objects_that_readers_pass_over(spark, tmp_path, prefix, want):
    """Names that begin with _ or . are listed like any other; folders of such names are read, files of such names are told."""
    readable, names = want - {"b", "e"}, {"a": "p/x", "b": "p/_y", "c": "p/.h/z", "d": "_q/r/s", "e": ".t"}
    for name, text in (("p/x", "a"), ("p/_y", "b"), ("p/.h/z", "c"), ("_q/r/s", "d"), (".t", "e")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "p" / "_SUCCESS").write_text("")
    listed = src.listing(spark, str(tmp_path), prefix, scheme="file")
    assert {r["key"] for r in listed.collect()} - {"p/_SUCCESS"} == {names[w] for w in want}
    if want - readable:
        with pytest.raises(ValueError, match="begins with _ or ."):
            src.objects(spark, str(tmp_path), prefix, scheme="file")
    rows = src.objects(spark, str(tmp_path), prefix, scheme="file", skip_hidden=True).collect()
    assert {r["raw_data"] for r in rows} == readable and len(rows) == len(readable)
    seen = listed.where("key LIKE 'p/%'").select("key")
    left = src.objects(spark, str(tmp_path), prefix, scheme="file", processed=seen, skip_hidden=True).collect()
    assert {r["raw_data"] for r in left} == readable - {"a", "c"}


def test_offsets_over_batches_and_splits(spark, tmp_path):
    """Lines of several files in small splits and batches: no line moves, each has its place."""
    rng = random.Random(2)
    want = {}
    for name in ("a", "b", "c"):
        lines = ["é" * rng.randint(0, 60) for _ in range(400)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        at = 0
        for line in lines:
            want[name, at] = line
            at += len(line) + 1
    for key, value in (("spark.sql.files.maxPartitionBytes", "3000"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "7")):
        spark.conf.set(key, value)
    try:
        lines = src.with_file_position(src._lines(spark, str(tmp_path)))
        assert {(r["path"][-1], r["position"]): r["value"] for r in lines.collect()} == want
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(_split" not in plan and "BroadcastHashJoin" in plan
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(key)


def test_ordered_files_are_cut_and_positions_go_on(spark, tmp_path, monkeypatch):
    import random

    from logweave.checks import QUERIES, io

    draw = random.Random(5)
    rows = [(i, "\n".join("word " * draw.randint(0, 9) for _ in range(draw.randint(1, 5))), draw.choice(["en", "en", "de"])) for i in range(300)]
    draw.shuffle(rows)
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "é日", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(io, "ORDERED_BYTES", 2000)
    written = []
    monkeypatch.setattr(io, "shared_dir", lambda spark, label: written.append(f"{tmp_path}/{label}-{len(written)}") or written[-1])
    expected, at = [], {}
    for _, text, lang in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for line in text.split("\n"):
            expected.append((lang, line, at.get(lang, 0)))
            at[lang] = at.get(lang, 0) + len(line) + 1
    found = QUERIES["source_file_position"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.select("lang", "line", "position").collect()) == sorted(expected)
    sizes = [len(file.read_bytes()) for file in (tmp_path / "position-0").glob("lang=*/*.txt")]
    assert len(sizes) > 6 and max(sizes) < 8000 < sum(sizes)  # no task has a language to itself
    ids = QUERIES["stable_ids"](spark, str(tmp_path)).first().asDict()
    n = sum(line.strip(" \t\r") != "" for _, line, _ in expected)
    assert ids == {"n_lines": n, "n_ids": n, "changed": 0}
