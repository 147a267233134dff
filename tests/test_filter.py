"""Filter semantics, checked row by row against a plain restatement of the rules."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from logweave import filter_events

ROWS = [
    {"level": "INFO", "status_code": 200, "message": "all fine"},
    {"level": "ERROR", "status_code": 500, "message": "an error here", "error_code": 7},
    {"level": "DEBUG", "status_code": 404, "message": "a warning"},
    {"message": "no level"},
    {"level": "WARN"},
    {"level": "ERROR", "status_code": 400, "message": ""},
]
DDL = "level string, status_code int, message string, error_code int"
CONDITIONS = [
    "level == 'INFO'", "level != 'DEBUG'", "status_code > 400", "status_code < 400", "status_code >= 400",
    "status_code <= 400.5", "status_code == 200", "status_code != 200", "status_code in [200, 500]",
    "status_code not in [200, x]", "message =~ 'error|warning'", "message !~ 'error'", "level in [INFO, WARN]",
    "level in ['INFO', \"WARN\"]", "level not in [INFO, ERROR]", "exists:error_code", "missing:error_code",
    "level > 3", "nothing == 1", "missing:nothing", "status_code > abc", "status_code == 0200",
]


def truth(condition, row):
    """(holds, fails) of a condition on a dictionary of fields."""
    if condition.startswith("exists:"):
        return condition[7:] in row, False
    if condition.startswith("missing:"):
        return condition[8:] not in row, False
    field, op, value = re.match(r"(\w+) (==|!=|>=|<=|>|<|=~|!~|not in|in) (.*)", condition).groups()
    if field not in row:
        return False, False
    have = str(row[field])
    if op in ("in", "not in"):
        items = [v.strip().strip("'\"") for v in value[1:-1].split(",")]
        return (have in items) == (op == "in"), False
    value = value.strip("'\"")
    if op in ("=~", "!~"):
        return bool(re.search(value, have)) == (op == "=~"), False
    if op in ("==", "!="):
        return (have == value) == (op == "=="), False
    try:
        a, b = float(row[field]), float(value)
    except ValueError:
        return False, True
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op], False


def expected(conditions, mode, negate):
    kept = []
    for i, row in enumerate(ROWS):
        results = [truth(c, row) for c in conditions]
        if any(fails for _, fails in results):
            continue
        result = (any if mode == "any" else all)(holds for holds, _ in results)
        if result != negate:
            kept.append(f"e{i}")
    return kept


CASES = [([c], "any") for c in CONDITIONS] + [
    (list(pair), mode)
    for pair in [
        ("level == 'ERROR'", "message =~ 'warn'"), ("exists:error_code", "status_code >= 400"),
        ("level > 3", "message != 'x'"), ("missing:level", "status_code not in [500]"),
    ]
    for mode in ("any", "all")
]


@pytest.fixture(scope="module")
def layouts(spark, make_events):
    typed = spark.createDataFrame(
        [(f"e{i}", *(r.get(c) for c in ("level", "status_code", "message", "error_code"))) for i, r in enumerate(ROWS)],
        "id string, " + DDL,
    ).cache()
    return {"typed": typed, "open": make_events(ROWS).cache()}


@pytest.mark.parametrize("layout", ["typed", "open"])
def test_conditions_match_the_rules(layouts, layout):
    df = layouts[layout]
    # All cases in one job: one flag column per case.
    flags, wanted = [], []
    for (conditions, mode), negate in itertools.product(CASES, (False, True)):
        step = filter_events(conditions=conditions, mode=mode, negate=negate)
        flags.append(F.coalesce(step.judge(df).keep, F.lit(False)).alias(f"c{len(flags)}"))
        wanted.append((conditions, mode, negate))
    rows = df.select("id", *flags).orderBy("id").collect()
    for i, (conditions, mode, negate) in enumerate(wanted):
        got = [r["id"] for r in rows if r[f"c{i}"]]
        assert got == expected(conditions, mode, negate), (conditions, mode, negate)


def test_open_values_of_mixed_type(make_events):
    df = make_events([{"v": True}, {"v": None}, {"v": "5"}, {"v": 6}, {"v": "NaN"}, {"v": [1]}, {}])

    def kept(condition, **kw):
        return [r.id for r in df.transform(filter_events(condition, **kw)).orderBy("id").collect()]

    assert kept("v == True") == ["e0"]
    assert kept("v == None") == ["e1"]
    assert kept("v != 5") == ["e0", "e1", "e3", "e4", "e5"]
    assert kept("v > 4") == ["e2", "e3"]  # null and list cannot be compared, NaN never is greater
    assert kept("v > 4", negate=True) == ["e0", "e4", "e6"]
    assert kept("exists:v") == ["e0", "e1", "e2", "e3", "e4", "e5"]


def test_nan_is_never_greater(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (9.0,)], "x double")
    assert df.transform(filter_events("x > 0")).count() == 2
    assert df.transform(filter_events("x > 0", negate=True)).count() == 1


def test_bad_settings():
    for bad in ("level ~ x", "level in INFO", "level in [A, B] or id in [1]", "a.b == 1"):
        with pytest.raises(ValueError):
            filter_events(bad)
    with pytest.raises(ValueError, match="At least one condition"):
        filter_events()
    with pytest.raises(ValueError, match="Invalid mode"):
        filter_events("exists:a", mode="some")


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("INFO", 1, 2.0)], "level string, n int, x double").write.parquet(path)

    def pushed(**kw):
        plan = spark.read.parquet(path).transform(filter_events(**kw))._jdf.queryExecution().executedPlan().toString()
        return re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)

    assert "EqualTo(level,INFO)" in pushed(condition="level == INFO")
    assert "GreaterThan(n,1)" in pushed(condition="n > 1.5")
    assert "LessThanOrEqual(x,2.0)" in pushed(condition="x <= 2")
    assert "In(n, [1,2])" in pushed(condition="n in [1, 2]")
    assert "Or(" in pushed(conditions=["level == INFO", "n > 1"])
    assert "Or(IsNull(level),Not(EqualTo(level,INFO)))" in pushed(condition="level == INFO", negate=True)
