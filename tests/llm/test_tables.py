"""Chats, vectors, registered queries and the pipeline."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweave.llm import chat, topk
from logweave.llm.queries import QUERIES, SQL

from .conftest import WORD
from .test_documents import base_spans, classes, measured, without_repeats

FOLDER = "/root/testdata/sf0.001"
LOG = "conv_id bigint, turn bigint, role string, text string"


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"),  # continued by 2 and 3
        (2, 0, "Human ", "hi"), (2, 1, "gpt", "yes"), (2, 2, "user", "more <|im_end|>"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", "other"),
        (5, 0, "user", "hi"), (5, 1, "assistant", "no"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"),  # equal
        (6, 0, None, None), (6, 0, None, None), (None, 0, "user", "lost"), (7, None, "user", "hi"), (7, 5, "", "x"),
    ]
    log = spark.createDataFrame(rows, LOG).withColumns({"pos": F.lit("mine"), "last": F.lit(1)}).repartition(4)
    got = {r["conv_id"]: r for r in chat.format_chats(log).collect()}
    assert sorted(got) == [2, 3, 4, 6, 7]
    assert (got[4]["n_equal"], got[4]["n_turns"], got[6]["n_turns"]) == (2, 2, 1)
    assert got[2]["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore < |im_end|><|im_end|>\n"
    assert got[6]["text"] == "<|im_start|>unknown\n<|im_end|>\n"
    a, b = map(int, got[2]["answers"].split(":"))
    assert got[2]["text"][a:b] == "yes" and got[6]["answers"] == ""
    assert chat.format_chats(log.limit(0)).count() == 0


def test_chats_against_all_prefixes(spark):
    rng = random.Random(3)
    talks = {}
    for i in range(200):
        talks[i] = [(("user", "assistant")[k % 2], rng.choice("ab")) for k in range(rng.randrange(1, 7))]
    rows = [(i, k, r, t) for i, turns in talks.items() for k, (r, t) in enumerate(turns)]
    got = {r["conv_id"] for r in chat.format_chats(spark.createDataFrame(rows, LOG).repartition(5)).collect()}
    want = {i for i, t in talks.items() if not any((len(u) > len(t) and u[: len(t)] == t) or (u == t and j < i) for j, u in talks.items())}
    assert got == want


def best(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("kind", ["random", "clustered", "equal"])
def test_top_k(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)  # many rings, chunks and lanes
    rng = np.random.default_rng(1)
    if kind == "random":
        vectors = rng.normal(0, 0.3, (900, 8))
    elif kind == "clustered":
        vectors = rng.normal(0, 1, (6, 8))[rng.integers(0, 6, 900)] + rng.normal(0, 0.05, (900, 8))
    else:
        vectors = np.repeat(rng.normal(0, 1, (2, 8)), 450, 0)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>").repartition(6)
    ready = topk.quantized(rows)
    got = {}
    for r in topk.top_k(ready, ready.where("id % 20 = 0"), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = {i: np.floor(64 * v).astype(int) for i, v in enumerate(vectors)}
    assert got == best(whole, range(0, 900, 20), 7)


def test_top_k_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, []), (None, [9.0, 9.0]), (20, [3.0]), (1, [0.5, -1.0])]
    ready = topk.quantized(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit("mine")))
    got = sorted(tuple(r) for r in topk.top_k(ready, ready.where("id % 20 = 0"), 5).collect())
    assert got == [(0, 1, 20, 12288), (0, 2, 1, -6144), (20, 1, 0, 12288), (20, 2, 1, 6144)]
    assert topk.top_k(ready.limit(0), ready.limit(0), 5).count() == 0


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    result = db.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, result.fetchall()))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and n.startswith("op")))
def test_query_runs(spark, name):
    """Queries without SQL give rows; their content is held against brute force elsewhere."""
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_pipeline_stages(spark, documents, tmp_path):
    """Each stage against brute force on its own input."""
    docs = documents.withColumns({"n_removed": F.lit("mine"), "row": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = stage(spark, docs, FOLDER)
        if name != "packing":
            assert after.columns == docs.columns
            after.write.parquet(str(tmp_path / name))
            after = spark.read.parquet(str(tmp_path / name))
            now = {r["doc_id"]: r["text"] for r in after.collect()}
            assert after.where("n_chars <> length(text)").count() == 0
        if name == "quality":
            for i, text in before.items():
                n, _, _, _, repeated = measured(text)
                assert i not in now or (n >= 50 and 2 * repeated <= n)
        elif name == "line_dedup":
            want = without_repeats(sorted(before.items()))
            assert now == {i: t for i, t in want.items() if t == before[i] or WORD.search(t)}
        elif name == "near_dedup":
            assert set(now) == {i for i, c in classes(sorted(before.items())).items() if i == c}
        elif name == "secrets":
            assert set(now) == set(before)
            assert {i for i in now if now[i] != before[i]} == {i for i, t in before.items() if base_spans(t)}
        else:
            assert {r["doc_id"] for r in after.collect()} == set(before)
        docs = after


def test_pipeline_of_an_empty_table(spark, documents):
    docs = documents.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def test_pipeline_links_near_copies_at_0_82(frame):
    """100 shared shingles of 122 different ones: 0.82, between the pipeline's 0.8 and the 0.85 of op2."""
    words = [f"w{i}" for i in range(104)]
    docs = frame([(1, " ".join([*words, *(f"a{i}" for i in range(11))])), (2, " ".join([*words, *(f"b{i}" for i in range(11))])), (3, " ".join(reversed(words)))])
    stages = dict(corpus_pipeline.STAGES)
    assert {r["doc_id"] for r in stages["near_dedup"](docs.sparkSession, docs, FOLDER).collect()} == {1, 3}
