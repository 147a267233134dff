"""Field changes in both layouts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweave import mutate
from logweave.functions import text as tx


def test_open_parts_in_fixed_order(make_events, read_events):
    df = make_events([{"a": " X ", "gone": 1, "old": "v", "n": "42", "l": "a, b ,c", "s": "1-2-3", "g": "aXbX"}, {"old": 5}])
    got = read_events(
        df.transform(
            mutate(
                strip_fields=["a"], split_fields={"s": ["-", 1]}, merge_fields={"m": ["new", "n", "nope"]},
                gsub_fields={"g": [r"([a-z])X", r"\1_$"]}, convert_fields={"n": "int", "l": "list"},
                lowercase_fields=["a"], rename_fields={"old": "new"}, remove_fields=["gone", "never"],
                add_fields={"env": "prod", "n2": 3, "d": {"k": [1]}}, uppercase_fields=["new"],
            )
        )
    )
    assert got["e0"]["fields"] == {
        "a": "x", "new": "V", "n": 42, "l": ["a", "b", "c"], "s": ["1", "2-3"], "g": "a_$b_$", "env": "prod",
        "n2": 3, "d": {"k": [1]}, "m": "V 42",
    }
    assert got["e1"]["fields"] == {"new": 5, "env": "prod", "n2": 3, "d": {"k": [1]}, "m": "5"}


def test_without_last_key_wins(spark, make_events, read_events):
    """The same result under Spark's default rule for repeated map keys."""
    df = make_events([{"a": "x", "b": 1}, {"b": "2"}])
    step = mutate(add_fields={"a": "y"}, rename_fields={"b": "a"}, convert_fields={"a": "int"})
    wanted = read_events(df.transform(step))
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    try:
        assert read_events(df.transform(step)) == wanted
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    assert [wanted[k]["fields"] for k in ("e0", "e1")] == [{"a": 1}, {"a": 2}]


CONVERT = {
    "int": [("42", 42), (" 42 ", 42), ("3.7", "error"), (3.7, 3), (True, 1), ("x", "error"), (None, None), ("1_0x", "error"), ("1_000", 1000), ("_1", "error")],
    "float": [("1.5", 1.5), ("1d", "error"), ("0x1p3", "error"), (2, 2.0), ("1e3", 1000.0), (False, 0.0), ("1_0.5", 10.5), ("1_.5", "error")],
    "str": [(1, "1"), (True, "True"), (0.5, "0.5"), ("x", "x"), (None, None)],
    "bool": [("Yes", True), ("no", False), ("", False), (0, False), (2.5, True), ([], False), ([0], True), (None, None)],
    "list": [("a , b", ["a", "b"]), ("", [""]), ([1], [1]), (7, [7]), (None, None)],
    "timestamp": [
        ("2024-01-02T03:04:05.5Z", "2024-01-02 03:04:05.5"), ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"),
        ("2024-1-2 3:4:5", "2024-01-02 03:04:05"), ("2024/01/02 03:04:05", "2024-01-02 03:04:05"),
        ("2024-01-02", "error"), (0, "1970-01-01 00:00:00"), ("2024-13-02 03:04:05", "error"),
    ],
    "widget": [("x", "error")],
}


@pytest.mark.parametrize("target", CONVERT)
def test_open_convert(make_events, read_events, target):
    cases = CONVERT[target]
    got = read_events(make_events([{"f": v} for v, _ in cases] + [{}]).transform(mutate(convert_fields={"f": target})))
    for i, (value, want) in enumerate(cases):
        event = got[f"e{i}"]
        assert ("convert_error_f" in event["metadata"]) == (want == "error"), value
        result = event["fields"]["f"]
        if target == "timestamp" and want != "error":
            result = result.replace("+00:00", "")
        assert result == (value if want == "error" else want), value
    assert got[f"e{len(cases)}"]["fields"] == {}


def test_typed_convert(spark):
    df = spark.createDataFrame(
        [("42", 3.7, 5, True, "2024-01-02 03:04:05"), ("x", float("nan"), 0, False, "bad"), (None,) * 5],
        "s string, d double, n int, b boolean, t string",
    )
    out = df.transform(mutate(convert_fields={"s": "int", "d": "int", "n": "bool", "b": "str", "t": "timestamp"})).collect()
    assert [(r.s, r.d, r.n, r.b) for r in out] == [(42, 3, True, "True"), (None, None, False, "False"), (None,) * 4]
    assert out[0].t == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert [sorted(r.metadata) for r in out] == [[], ["convert_error_d", "convert_error_s", "convert_error_t"], []]


def test_typed_rename_merge_split_strip(spark):
    df = spark.createDataFrame(
        [("1", None, "", "x", " p\u00a0"), (None, "2", None, "y", "\tq\n")], "a string, b string, e string, c string, p string"
    )
    rows = df.transform(mutate(rename_fields={"a": "b", "c": "z", "z": "z2"}, strip_fields=["p"])).collect()
    assert [(r.b, r.z2, r.p) for r in rows] == [("1", "x", "p"), ("2", "y", "q")]
    assert "a" not in rows[0].asDict() and "c" not in rows[0].asDict()
    merged = df.transform(mutate(merge_fields={"m": ["e", "a", "e", "c"], "none": ["e"]})).collect()
    assert [(r.m, r.none) for r in merged] == [("1  x", None), ("y", None)]
    gone = df.transform(mutate(rename_fields={"a": "a"}))
    assert "a" not in gone.columns


@pytest.mark.parametrize("limit", [-1, 0, 1, 2])
def test_split_counts_cuts(spark, limit):
    texts = ["a.b.c.", "", ".", "abc"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.transform(mutate(split_fields={"s": [".", limit]})).collect()
    assert [r.s for r in rows] == [t.split(".", limit) for t in texts]


def test_number_texts(spark):
    values = [1.0, 0.0, 1e7, 12345678.5, 1e16, 1.5e-5, 1e-4, 1.2345678901234567e-4, 1e22, 1.7976931348623157e308,
              -2.5e-10, 123456789012345.6, float("nan"), float("inf"), float("-inf"), 0.1, 9.999e15, 5e-324 * 1e10]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(tx.float_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [repr(v) for v in values]


def test_bad_settings():
    for bad in (
        {"gsub_fields": {"a": ["x"]}}, {"gsub_fields": {"a": ["(", "x"]}}, {"split_fields": {"a": [","]}},
        {"split_fields": {"a": [",", "x"]}}, {"split_fields": {"a": ["", 1]}}, {"upper": ["a"]},
    ):
        with pytest.raises(ValueError):
            mutate(**bad)
