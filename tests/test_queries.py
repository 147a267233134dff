"""Every registered query: same rows as its SQL twin, and a plan fit for large data."""

import math
import os
from collections import Counter

import duckdb
import pytest

from logweave.checks import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not there")

# Joins every row with every row, or Python row by row.
UNFIT = ("NestedLoop", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroups", "MapInPandas", "MapInArrow")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v

    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [node for node in UNFIT if node in plan]
    assert found == (["MapInPandas"] if name == "custom_step" else [])
    result = db.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert _bag(df.columns, [tuple(r) for r in df.collect()]) == _bag(columns, result.fetchall())
