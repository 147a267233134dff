"""Exact top-k by inner product over a pivot-distance index.

Inner products become distances by one more coordinate: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2))
and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so nearest is highest. Every vector is keyed by its
nearest pivot and the distance to it; distances are cut into rings (annuli) of about equal size.

A query first meets the ring it lies in, which gives a score that its k-th best reaches at least. Then rings
of all pivots are gone through by their lower bound |d(q', pivot) - d|; by the triangle inequality no vector of
a ring is nearer than that, so the first ring whose bound cannot reach the score ends the search. Queries
and rings meet in blocks: a ring is dealt over chunks of bounded size, queries as well, and both sides of a
block go to one task, where whole blocks are multiplied.

Pivots are fitted on a sample of at most ``SAMPLE`` vectors; every vector is indexed and no bound is
approximate, so the result is exact. Scores are integers, exact as long as they fit in 53 bits.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without id;
a vector shorter than others has zeros where it ends. Of rows with the same id the smallest vector counts.
Ties go to the smaller id. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from logweave.llm.shared import ship, written

SAMPLE = 2048
PIVOTS = 16
RINGS = 64
BLOCK = 4096


def quantized(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``(id, v)`` with ``floor(scale * component)`` of all rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & (F.size("v") > 0))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for row, v in zip(out, column):
        row[: len(v)] = v
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that brings all to norm ``sqrt(top)``."""
    rest = np.sqrt(np.maximum(top - (x * x).sum(1), 0))
    return np.concatenate([x, rest[:, None]], 1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` pivots: each next one is the sampled vector farthest from those before."""
    chosen = [0]
    far = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


class Index:
    """Pivots and the rings around them; its size is bounded by ``PIVOTS * RINGS``."""

    def __init__(self, pivots: np.ndarray, width: int, top: float):
        self.pivots, self.width, self.top = pivots, width, top
        self.rings: pd.DataFrame | None = None

    def place(self, v) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(_lifted(_matrix(v, self.width), self.top), self.pivots)
        pivot = d.argmin(1)
        return pivot, d[np.arange(len(d)), pivot]

    def bounds(self, v) -> np.ndarray:
        """Of every query and ring the highest score that a vector of the ring can reach."""
        q = _matrix(v, self.width)
        lifted = np.concatenate([q, np.zeros((len(q), 1))], 1)
        d = _distances(lifted, self.pivots)[:, self.rings["pivot"].to_numpy()]
        low = np.maximum(np.maximum(d - self.rings["far"].to_numpy(), self.rings["near"].to_numpy() - d), 0)
        best = ((q * q).sum(1)[:, None] + self.top - low * low) / 2
        return best + 1e-6 * (1 + np.abs(best))  # for rounding


def build(rows: DataFrame) -> tuple[DataFrame, Index]:
    """Index the written table ``rows (id, v)``: each row with ``pivot``, ``ring`` and ``chunk``."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    width, top, total = rows.agg(F.max(F.size("v")), F.max(norm), F.count(F.lit(1))).first()
    sample = rows.orderBy(F.xxhash64("id")).limit(SAMPLE).collect()
    index = Index(_spread(_lifted(_matrix([r["v"] for r in sample], width), top), PIVOTS), width, top)

    def placed(frames):
        for frame in frames:
            pivot, far = index.place(frame["v"])
            yield frame.assign(pivot=pivot.astype(np.int32), d=far)

    keyed = written(rows.mapInPandas(placed, "id bigint, v array<bigint>, pivot int, d double"), "topk-keyed")
    n_rings = int(min(RINGS, max(1, -(-total // (len(index.pivots) * BLOCK // 2)))))
    steps = [k / n_rings for k in range(1, n_rings)]
    cuts = {r["pivot"]: np.unique(r["cuts"] or []) for r in keyed.groupBy("pivot").agg((F.percentile_approx("d", steps, 1000) if steps else F.array().cast("array<double>")).alias("cuts")).collect()}
    names = [(p, k) for p in sorted(cuts) for k in range(len(cuts[p]) + 1)]
    edge = F.create_map(*[x for p, c in cuts.items() for x in (F.lit(p), F.array(*(F.lit(float(e)) for e in c)).cast("array<double>"))])
    ring = F.size(F.filter(F.element_at(edge, F.col("pivot")), lambda e: e < F.col("d")))
    rung = keyed.withColumn("ring", ring)
    facts = rung.groupBy("pivot", "ring").agg(F.min("d").alias("near"), F.max("d").alias("far"), F.count(F.lit(1)).alias("held")).toPandas()
    assert len(facts) <= len(names) <= PIVOTS * RINGS
    index.rings = facts.sort_values(["pivot", "ring"], ignore_index=True)
    index.rings["chunks"] = -(-index.rings["held"] // BLOCK)
    chunks = F.create_map(*[x for r in index.rings.itertuples() for x in (F.lit(f"{r.pivot}/{r.ring}"), F.lit(int(r.chunks)))])
    of = F.element_at(chunks, F.concat_ws("/", "pivot", "ring"))
    return rung.withColumn("chunk", F.pmod(F.xxhash64("id"), of).cast("int")), index


SCORED = "query_id bigint, vec_id bigint, score bigint"
CANDIDATE = "id bigint, v array<bigint>, reach bigint, pivot int, ring int, chunk int"


def _scores(index: Index, k: int, only_bound: bool):
    """Function of one block: its queries and vectors to the scores that count."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        right = right.sort_values("id")
        ids = right["id"].to_numpy()
        q, x = _matrix(left["v"], index.width), _matrix(right["v"], index.width)
        if index.top < 2**52:
            scores = (q @ x.T).astype(np.int64)
        else:
            scores = q.astype(np.int64) @ x.astype(np.int64).T
        least = np.iinfo(np.int64).min
        out = []
        for query, reach, row in zip(left["id"].to_numpy(), left["reach"].to_numpy(), scores):
            row = np.where(ids == query, least, row)
            good = np.flatnonzero((row >= reach) & (ids != query))
            if len(good) > k:  # ids ascend, so a stable sort puts the smaller id first
                good = good[np.argsort(-row[good], kind="stable")[:k]]
            if only_bound:
                if len(good) == k:
                    out.append((np.full(1, query), ids[good[-1:]], row[good].min(keepdims=True)))
            else:
                out.append((np.full(len(good), query), ids[good], row[good]))
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*out) if out else ([], [], []))]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    return meet


def _blocks(queries: DataFrame, indexed: DataFrame, index: Index, k: int, lanes: int, only_bound: bool) -> DataFrame:
    """Queries (with ``pivot``, ``ring``, ``chunk``) against those parts of the index, in blocks."""
    lane = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(lanes)).cast("int")
    left = queries.withColumn("lane", lane)
    right = indexed.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))) if lanes > 1 else indexed.withColumn("lane", F.lit(0))
    by = ["pivot", "ring", "chunk", "lane"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_scores(index, k, only_bound), SCORED)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """For each of ``queries (id, v)`` its ``k`` best of ``rows (id, v)`` other than itself: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    ship(rows.sparkSession)
    rows = written(rows, "topk-rows")
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    indexed, index = build(rows)
    indexed = written(indexed, "topk-index").drop("d")
    queries = written(queries, "topk-queries")
    lanes = max(1, -(-queries.count() // BLOCK))
    least = int(np.iinfo(np.int64).min) + 1

    def homes(frames):
        """The ring with the best bound that holds enough, its first chunk."""
        rings = index.rings
        for frame in frames:
            bound = np.where(rings["held"].to_numpy() > k, index.bounds(frame["v"]), -np.inf)
            at = bound.argmax(1)
            yield frame.assign(reach=least, pivot=rings["pivot"].to_numpy()[at].astype(np.int32), ring=rings["ring"].to_numpy()[at].astype(np.int32), chunk=np.int32(0))

    def visits(frames):
        """All parts of the rings that may reach the score, rings in order of their bound."""
        rings = index.rings
        for frame in frames:
            bound = index.bounds(frame["v"])
            order = np.argsort(-bound, 1, kind="stable")
            sorted_ = np.take_along_axis(bound, order, 1)
            stop = (sorted_ >= frame["reach"].to_numpy()[:, None]).sum(1)  # the first that cannot ends it
            query = np.repeat(np.arange(len(frame)), stop)
            ring = np.concatenate([order[i, :n] for i, n in enumerate(stop)]) if len(frame) else np.zeros(0, int)
            for a in range(0, len(ring), 20_000):
                q, r = query[a : a + 20_000], ring[a : a + 20_000]
                chunks = rings["chunks"].to_numpy()[r]
                q, r = np.repeat(q, chunks), np.repeat(r, chunks)
                chunk = np.concatenate([np.arange(c) for c in chunks]) if len(chunks) else np.zeros(0, int)
                yield frame.iloc[q].assign(
                    pivot=rings["pivot"].to_numpy()[r].astype(np.int32), ring=rings["ring"].to_numpy()[r].astype(np.int32), chunk=chunk.astype(np.int32)
                )

    first = _blocks(queries.mapInPandas(homes, CANDIDATE), indexed.where("chunk = 0"), index, k, lanes, True)
    reached = written(first.groupBy("query_id").agg(F.max("score").alias("reach")), "topk-reach")
    known = queries.join(reached.withColumnRenamed("query_id", "id"), "id", "left").withColumn("reach", F.coalesce("reach", F.lit(least)))
    found = _blocks(known.mapInPandas(visits, CANDIDATE), indexed, index, k, lanes, False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
