"""Live files, custom per-event functions and sizes of written objects."""

import json
import os
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from logweave import Flow, default_registry, filter_events, metrics, parse_json, python_step
from logweave.operators.base import reason
from logweave.sinks.lines import write_objects
from logweave.sources.follow import GrowingReader, local_path
from logweave.streaming import query as streaming

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module


def _reader(path, **options):
    return GrowingReader({"path": str(path), **{k: str(v) for k, v in options.items()}})


def _lines(reader, start, end):
    found = []
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            found += zip(batch.column("value").to_pylist(), batch.column("position").to_pylist())
    return found


def test_appended_bytes_come_once_and_whole_lines_only(tmp_path):
    log = tmp_path / "app.log"
    log.write_bytes(b"one\ntw")
    reader = _reader(log, read_from_start=True)
    first = reader.latestOffset()
    assert reader.initialOffset() == {} and _lines(reader, {}, first) == [(b"one", 0)]
    with open(log, "ab") as file:
        file.write(b"o\n\xff\n\nlast")
    second = reader.latestOffset()
    assert _lines(reader, first, second) == [(b"two", 4), (b"\xff", 8), (b"", 10)]
    assert _lines(reader, second, reader.latestOffset()) == []
    # Again from the offsets alone, as after a crash, by another reader.
    assert _lines(_reader(log), json.loads(json.dumps(first)), json.loads(json.dumps(second))) == [(b"two", 4), (b"\xff", 8), (b"", 10)]


def test_replaced_and_cut_files_start_again(tmp_path):
    log = tmp_path / "app.log"
    log.write_bytes(b"a1\na2\n")
    reader = _reader(log)
    start = reader.initialOffset()
    (tmp_path / "new").write_bytes(b"b1\nb2\nb3\n")
    os.replace(tmp_path / "new", log)
    end = reader.latestOffset()
    assert [v for v, _ in _lines(reader, start, end)] == [b"b1", b"b2", b"b3"]
    log.write_bytes(b"c1\n")  # cut in place: the same inode, shorter
    cut = reader.latestOffset()
    assert [v for v, _ in _lines(reader, end, cut)] == [b"c1"]
    log.write_bytes(b"d1\nd2\nd3\nd4\n")  # longer than before, but another beginning
    assert [v for v, _ in _lines(reader, cut, reader.latestOffset())] == [b"d1", b"d2", b"d3", b"d4"]


def test_renamed_files_go_on(tmp_path):
    log = tmp_path / "app.log"
    log.write_bytes(b"a1\n")
    reader = _reader(tmp_path / "app.log*")
    start = reader.initialOffset()
    with open(log, "ab") as file:
        file.write(b"a2\n")
    os.rename(log, tmp_path / "app.log.1")
    log.write_bytes(b"b1\n")
    end = reader.latestOffset()
    assert sorted(v for v, _ in _lines(reader, start, end)) == [b"a2", b"b1"]
    # Renamed between planning and reading, and gone.
    parts = reader.partitions(start, end)
    os.rename(tmp_path / "app.log.1", tmp_path / "old")
    assert sorted(v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()) == [b"a2", b"b1"]
    os.remove(tmp_path / "old")
    with pytest.raises(FileNotFoundError, match="are lost"):
        [list(reader.read(p)) for p in parts]
    reader.strict = False
    assert [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()] == [b"b1"]


@pytest.mark.parametrize("split", [1, 2, 3, 7, 50, 1000])
def test_splits_cut_no_line(tmp_path, split):
    draw = random.Random(split)
    lines = [bytes(draw.choice(b"ab ") for _ in range(draw.choice([0, 1, 2, 5, 90]))) for _ in range(60)]
    (tmp_path / "x.log").write_bytes(b"".join(line + b"\n" for line in lines))
    reader = _reader(tmp_path, split_bytes=split)
    found = _lines(reader, {}, reader.latestOffset())
    assert [v for v, _ in found] == lines
    assert [p for _, p in found] == [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]


def test_tasks_read_several_splits_and_files(tmp_path):
    (tmp_path / "big.log").write_bytes(b"".join(b"%05d\n" % i for i in range(20_000)))  # 6,000 splits
    for i in range(300):
        (tmp_path / f"small-{i:03}.log").write_bytes(b"x%03d\n" % i)
    reader = _reader(tmp_path, read_from_start=True, split_bytes=20, tasks=10)
    end = reader.latestOffset()
    assert 10 <= len(reader.partitions({}, end)) <= 20
    found = _lines(reader, {}, end)
    assert [v for v, _ in found] == [b"%05d" % i for i in range(20_000)] + [b"x%03d" % i for i in range(300)]
    assert [p for _, p in found] == [6 * i for i in range(20_000)] + [0] * 300
    # No task reads more than 64 MiB, however few are wanted.
    with open(tmp_path / "wide.log", "wb") as file:
        file.truncate((200 << 20) - 1)
        file.seek(0, 2)
        file.write(b"\n")
    wide = _reader(tmp_path / "wide.log", read_from_start=True, split_bytes=1 << 20, tasks=1)
    assert 4 <= len(wide.partitions({}, wide.latestOffset())) <= 5


def test_last_line_end_far_back(tmp_path):
    (tmp_path / "x.log").write_bytes(b"short\n" + b"y" * 300_000)
    (tmp_path / "empty.log").write_bytes(b"")
    reader = _reader(tmp_path)
    assert _lines(reader, {}, reader.latestOffset()) == [(b"short", 0)]
    assert _reader(tmp_path / "none.log").latestOffset() == {}


def test_paths():
    assert local_path("file:///a/b") == local_path("file:/a/b") == local_path("/a/b") == "/a/b"
    with pytest.raises(ValueError, match="mounted"):
        local_path("s3a://bucket/x")


def test_flow_follows_one_live_file(spark, tmp_path):
    log, out = tmp_path / "app.log", tmp_path / "out"
    log.write_text("before\n")
    spec = {
        "name": "live", "sources": [{"name": "in", "type": "file", "config": {"path": str(log)}}],
        "sinks": [{"name": "out", "type": "file", "config": {"path": str(out), "append": True}}],
    }

    def run():
        streaming.start(Flow(spec), spark, str(tmp_path / "cp"), available_now=True, on_error="fail").awaitTermination(60)
        return sorted((json.loads(r.value) for r in spark.read.text(str(out)).collect()), key=lambda e: e["metadata"]["file_position"]) if out.exists() else []

    assert run() == []
    with open(log, "ab") as file:
        file.write(b"  first \n\n\xff\xfe\nhalf")
    events = run()
    assert [e["raw_data"] for e in events] == ["first", "fffe"]
    assert [e["metadata"]["file_position"] for e in events] == [7, 17] and "decode_error" in events[1]["metadata"]
    assert {e["source_name"] for e in events} == {str(log)} and len({e["id"] for e in events}) == 2


# Custom per-event functions


def _picky(event):
    level = event["fields"].get("level")
    event["fields"]["seen"] = True
    if level == "bad":
        raise KeyError("level")
    if level == "nan":
        event["fields"]["x"] = float("nan")
    if level == "text":
        return "no event"
    return None if level == "drop" else event


LEVELS = ["ok", "bad", "nan", "text", "drop", "out"]


def test_custom_step_keeps_the_others(make_events, read_events):
    rows = make_events([{"level": level} for level in LEVELS])
    got = read_events(rows.transform(python_step(_picky)))
    assert {e["fields"]["level"] for e in got.values()} == {"ok", "out"} and all(e["fields"]["seen"] for e in got.values())
    with pytest.raises(Exception, match="(Key|Value|Type)Error"):
        read_events(rows.transform(python_step(_picky, on_error="fail")))
    with pytest.raises(ValueError, match="Invalid on_error"):
        python_step(_picky, on_error="skip")


def test_custom_step_audited(make_events):
    rows = make_events([{"level": level} for level in LEVELS]).withColumn("_status", reason("ok", "", F.lit("")))
    rows = filter_events("level != out").audited(rows, "_status")
    rows = python_step(_picky, "picky").audited(rows, "_status")
    level, seen = F.expr("fields['level']::string").alias("level"), F.map_contains_key("fields", "seen").alias("seen")
    fate = {r.level: r for r in rows.select(level, seen, "_status.*").collect()}
    assert (fate["ok"].state, fate["ok"].seen) == ("ok", True)
    assert (fate["out"].state, fate["out"].stage, fate["out"].seen) == ("filtered", "filter", False)
    assert (fate["drop"].state, fate["drop"].stage) == ("filtered", "picky")
    assert {k: fate[k].message.split(":")[0] for k in ("bad", "nan", "text")} == {"bad": "KeyError", "nan": "ValueError", "text": "TypeError"}
    assert not any(fate[k].seen for k in ("bad", "nan", "text"))
    assert metrics.errors(rows).count() == 3


def test_custom_step_of_typed_and_empty_rows(spark, read_events):
    rows = spark.createDataFrame([("1", "a", 3), ("2", "b", None)], "id string, kind string, n int")
    got = read_events(rows.transform(python_step(lambda e: e)))
    assert got["1"]["fields"] == {"kind": "a", "n": 3} and got["2"]["fields"] == {"kind": "b"}
    assert rows.where("id = '3'").transform(python_step(lambda e: e)).count() == 0


def test_a_flow_counts_custom_errors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(json.dumps({"level": level}) for level in LEVELS))
    registry = default_registry()
    registry.register("processor", "picky", lambda: python_step(_picky))
    spec = {
        "name": "picky", "sources": [{"name": "in", "type": "file", "config": {"path": str(tmp_path / "in")}}],
        "processors": [{"name": "j", "type": "json", "config": {"target_field": ""}}, {"name": "p", "type": "picky", "config": {}}],
        "sinks": [{"name": "out", "type": "file", "config": {"path": str(tmp_path / "out")}}],
    }
    status = Flow(spec, registry).run_batch(spark, count=True, on_error="fail")
    assert [status[k] for k in metrics.COUNTERS] == [2, 4, 3]
    assert spark.read.text(str(tmp_path / "out")).count() == 2


# Sizes of written objects


def _objects(folder):
    return {str(p.relative_to(folder)): p.read_text().splitlines() for p in folder.rglob("part-*")}


def test_objects_have_the_size_and_keep_the_order(spark, tmp_path):
    rows = spark.range(0, 30_000, numPartitions=7).select(
        F.format_string("%06d", "id").alias("id"), F.lit("2024-05-06 07:08:09").cast("timestamp").alias("timestamp"), F.lit("x" * 33).alias("raw_data")
    )
    write_objects(rows, str(tmp_path / "out"), "logs", format="text", template="{id}{message}", buffer_size=100_000, scheme=None)
    files = _objects(tmp_path / "out")
    assert {os.path.dirname(f) for f in files} == {"logs/year=2024/month=05/day=06/hour=07"}
    sizes = sorted(40 * len(lines) for lines in files.values())
    assert len(sizes) == 12 and sizes == [100_000] * 12
    assert [x for f in sorted(files) for x in files[f]] == [f"{i:06d}" + "x" * 33 for i in range(30_000)]


def test_small_hours_share_a_task_and_odd_rows_are_kept(spark, tmp_path):
    hour = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n") * 3600)
    rows = spark.range(50).select(F.col("id").cast("string").alias("id"), (F.col("id") % 10).alias("n"))
    rows = rows.withColumn("timestamp", F.when(F.col("n") < 9, hour)).withColumn("raw_data", F.when(F.col("n") > 0, F.repeat(F.lit("z"), F.col("n").cast("int"))))
    rows = rows.drop("n").unionByName(spark.createDataFrame([("y" * 9_000, "")], "id string, raw_data string").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp")))
    write_objects(rows, str(tmp_path / "out"), format="text", template="{id}", buffer_size=4_000, scheme=None)
    files = _objects(tmp_path / "out")
    assert sorted(x for lines in files.values() for x in lines) == sorted([str(i) for i in range(50)] + ["y" * 9_000])
    assert len(files) == 11 and len({f.rsplit("part-", 1)[1][:5] for f in files}) == 2
    write_objects(rows.limit(0), str(tmp_path / "none"), scheme=None)
    assert _objects(tmp_path / "none") == {}


# Names, bounds and places


def test_json_names_with_quotes(spark):
    names = ["it's", 'a "b"', "both ' and \"", "dot.ted", "back\\slash"]
    text = json.dumps({n: i for i, n in enumerate(names)})
    fields = ", ".join(f"`{n}` int" for n in names)
    row = spark.createDataFrame([(text,)], "raw_data string").transform(parse_json(target_field="", schema=fields)).first()
    assert [row[n] for n in names] == [0, 1, 2, 3, 4]


def test_batch_size_bounds_sources_that_count_rows(spark):
    seen, registry = [], default_registry()

    def source(spark, max_poll_records=None, tail=True):
        seen.append(max_poll_records)
        return spark.createDataFrame([], "id string")

    registry.register("source", "queue", source)
    spec = {"name": "b", "batch_size": 250, "sources": [{"name": "q", "type": "queue", "config": {}}], "sinks": [{"name": "f", "type": "file", "config": {"path": "x"}}]}
    Flow(spec, registry).read(spark, stream=True)
    Flow(spec, registry).read(spark)
    spec["sources"][0]["config"]["max_poll_records"] = 7
    Flow(spec, registry).read(spark, stream=True)
    assert seen == [250, None, 7]


def test_default_checkpoint_lasts(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    spec = {
        "name": "lasting", "sources": [{"name": "in", "type": "file", "config": {"path": str(tmp_path / "in"), "read_from_start": True}}],
        "sinks": [{"name": "out", "type": "file", "config": {"path": str(tmp_path / "out"), "format": "text", "template": "{message}"}}],
    }
    monkeypatch.setattr(streaming, "lasting_dir", lambda _, label: str(tmp_path / label))
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.log").write_text(name)
        streaming.start(Flow(spec), spark, available_now=True, on_error="fail").awaitTermination(60)
    assert (tmp_path / "checkpoint-lasting").is_dir()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_tasks_write_files_of_several_keys(spark, tmp_path):
    from logweave.sinks.sizing import dealt_by_bytes

    def lines(n):
        return spark.range(12 * n).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"), F.format_string("%02d", F.col("id") % 12).alias("hour"))

    def files(n, size):
        dealt = dealt_by_bytes(lines(n), ["hour"], size, str(tmp_path / f"scratch-{n}-{size}"))
        rows = dealt.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "hour", "value").orderBy("part", "at").collect()
        found = {}
        for r in rows:
            found.setdefault((r["part"], r["hour"]), []).append(r["value"])
        return dealt.rdd.getNumPartitions(), found

    parts, found = files(500, 200)
    assert parts == max(sum(h == hour for _, h in found) for _, hour in found) < len(found) / 10
    sizes = {key: sum(len(v) + 1 for v in values) for key, values in found.items()}
    for hour in {h for _, h in found}:
        own = sorted(n for (_, h), n in sizes.items() if h == hour)
        assert all(185 <= n <= 215 for n in own[1:]) and own[0] <= 215  # but for one, the rest
        numbers = [int(v.split()[1]) for (_, h), values in found.items() if h == hour for v in values]
        assert sorted(numbers) == list(range(int(hour), 6000, 12))
    for values in found.values():
        numbers = [int(v.split()[1]) for v in values]
        assert numbers == list(range(numbers[0], numbers[-1] + 1, 12))  # a stretch of the hour, in order
    assert files(3, 10_000)[0] <= 12  # twelve small files need no more tasks
