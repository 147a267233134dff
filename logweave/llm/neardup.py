"""Near-duplicate documents by MinHash.

One pass over the texts gives each document its set of 5-word shingles (as 64-bit hashes), a
one-permutation MinHash signature of ``BINS`` bins made full by optimal densification, and from it
banded bucket keys. Documents with the same set are joined first, without buckets.

Candidates of a bucket are star-shaped and go on, round by round, until nothing is open (``stars.py``): all
members against one center first, then against the members it left unlinked. Every candidate is confirmed on
the full sets. Documents of a bucket that have too few shingles in common with any other document leave
before candidates are made.

The threshold sets the shape of the bands (``band_shape``): the longest that miss a pair right at it with
a probability of ``MISSED`` at most. At 0.85 these are 32 bands of 8 bins, (1 - 0.85**8)**32 = 4e-5; at 0.8
42 bands of 6, (1 - 0.8**6)**42 = 3e-6.

A null or empty text, or one without words, has an empty set and links with nothing; a row with a
null ``doc_id`` links with nothing either. Rows with the same ``doc_id`` are one document (it links
if any of its texts does). Equal rows are answered one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from logweave.llm.bytewords import U, Texts, mix, ngrams, slices, stream
from logweave.llm.components import components
from logweave.llm.shared import free_names, ship, written
from logweave.llm.stars import held_in_common, star_classes

BINS = 256
MISSED = 1e-4  # of pairs right at the threshold, those that share no bucket
SHINGLE = 5
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: Texts, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where each text's begin."""
    words = texts.words()
    hashes = words.hashes()
    grams, where = ngrams(hashes, words.at, shingle, 5)
    doc = np.searchsorted(words.at, where, "right") - 1
    few = np.flatnonzero((words.counts() > 0) & (words.counts() < shingle))  # the whole sequence is the shingle
    if len(few):
        weights = stream(6, shingle)
        whole = []
        for d in few:
            own = hashes[words.at[d] : words.at[d + 1]]
            whole.append((own * weights[: len(own)]).sum(dtype=U) + U(len(own)))
        grams = np.concatenate([grams, mix(np.array(whole, U))])
        doc = np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        grams, doc = grams[order], doc[order]
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(at[:-1], at[1:]):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    kept = np.zeros(len(grams) + 1, np.int64)
    np.cumsum(new, out=kept[1:])
    return grams[new], kept[at]


@lru_cache(maxsize=4096)
def _probe(attempt: int) -> np.ndarray:
    """The bin that an empty bin borrows from at its ``attempt``: a hash of both, the same for all sets."""
    return (stream(1000 + attempt, BINS) >> U(56)).astype(np.int64) % BINS


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One-permutation MinHash: of each set the smallest hash in every bin; empty bins borrow.

    Optimal densification: an empty bin goes along its own pseudo-random row of bins until it meets
    one that was filled, so two sets borrow alike as far as they are alike.
    """
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    slot = doc * BINS + (sets >> U(56)).astype(np.int64)  # the top 8 bits name the bin
    first = np.ones(len(sets), bool)
    first[1:] = slot[1:] != slot[:-1]  # ascending hashes: the first of a bin is its smallest
    sig = np.full(n * BINS, EMPTY, U)
    sig[slot[first]] = sets[first]
    sig = sig.reshape(n, BINS)
    full = sig != EMPTY
    filled = full.sum(1)
    lone = np.flatnonzero(filled == 1)
    sig[lone] = sig[lone].min(1, keepdims=True)
    row, b = np.nonzero(~full & (filled > 1)[:, None])
    source, attempt = sig.copy(), 0
    while len(row):
        value = source[row, _probe(attempt)[b]]
        there = value != EMPTY
        sig[row[there], b[there]] = value[there]
        row, b, attempt = row[~there], b[~there], attempt + 1
    return sig


assert BINS == 256  # bins are named by 8 bits above


def band_shape(percent: int) -> tuple[int, int]:
    """Bands and bins of each for a threshold; bins that fill no band are left out."""
    fits = [r for r in range(1, BINS + 1) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISSED]
    rows = max(fits, default=1)
    return BINS // rows, rows


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weights = stream(77, bands * rows).reshape(1, bands, rows) | U(1)
    return mix((sig[:, : bands * rows].reshape(-1, bands, rows) * weights).sum(2, dtype=U) + stream(78, bands))


FEATURES = "struct<n_shingles: bigint, set1: bigint, set2: bigint, bands: array<bigint>>"


def features(percent: int):
    """Column function ``text -> FEATURES``: set size, a 128-bit digest of the set, and its bucket keys (none for an empty set)."""
    bands, rows = band_shape(percent)

    @arrow_udf(FEATURES)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for texts in slices(batch, lower=True):
                sets, at = shingle_sets(texts)
                size = np.diff(at)
                digest = digests(sets, at)
                full = size > 0
                offsets = np.concatenate([at[:-1][full], at[-1:]])
                keys = band_keys(signatures(sets, offsets), bands, rows) if full.any() else np.zeros((0, bands), U)
                parts.append((size, digest[0], digest[1], np.where(full, bands, 0), keys.ravel()))
            size, d1, d2, n_bands, keys = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, U),) * 5
            offsets = np.concatenate([[0], np.cumsum(n_bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.astype(U).view(np.int64)))
            arrays = [pa.array(size.astype(np.int64)), pa.array(d1.astype(U).view(np.int64)), pa.array(d2.astype(U).view(np.int64)), lists]
            yield pa.StructArray.from_arrays(arrays, names=["n_shingles", "set1", "set2", "bands"])

    return measure


def full_set(shingle: int):
    """Column function: the whole set of shingle hashes of each text."""

    def sets_of_batch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets, sizes = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for texts in slices(batch, lower=True):
                own, at = shingle_sets(texts, shingle)
                sets.append(own)
                sizes.append(np.diff(at))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))

    return sets_of_batch


def digests(sets: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of every set, which depend on its items alone."""
    out = []
    for seed in (1, 2):
        total = np.zeros(len(sets) + 1, U)
        np.cumsum(mix(sets ^ stream(seed, 1)), out=total[1:])
        out.append(mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(U)))
    return out


def near_duplicate_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", *, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents with ``100 * |intersection| >= percent * |union|`` are linked; a component is what is
    reachable over links, named by its smallest ``doc_id``.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = written(docs.select("doc_id", features(percent)(F.coalesce("text", F.lit(""))).alias("f")).select("doc_id", "f.*"), "near-features")
    # 1. Equal sets, of any number, come together by their digest alone.
    member, same = distinct_sets(found)
    # 2. Buckets with two members or more.
    rows = member.where("doc_id = rep").select(F.explode("bands").alias("bucket"), F.col("rep").alias("node"), "n")
    shared = rows.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    active = written(rows.join(written(shared, "near-shared"), "bucket").distinct(), "near-buckets")
    if active.isEmpty():
        return answer(found, member, components(same))
    # The sets of all that may be compared, made once, and what each has in common with any other.
    sets = sets_of(docs, active.select("node").distinct(), SHINGLE)
    common = held_in_common(sets).groupBy("node").agg(F.countDistinct("item").alias("shared"))
    active = active.join(written(common, "near-common"), "node").select("bucket", "node", "n", "shared")
    return answer(found, member, star_classes(active, sets, percent, same))


def distinct_sets(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``found`` (doc_id, n_shingles, set1, set2, ...) with a set, as ``member`` with ``rep``, the smallest id of equal sets, and ``n``.

    Second, links ``(a, b)`` between representatives of the sets of one id, where rows of that id have several.
    """
    whole = found.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = written(whole.groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("rep")), "near-first")  # written, so that the join may split copies
    member = whole.join(first, ["set1", "set2", "n_shingles"]).withColumnRenamed("n_shingles", "n").drop("set2")
    member = written(member, "near-members")
    lowest = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id", "a")
    return member, member.select("doc_id", F.col("rep").alias("b")).join(lowest, "doc_id").where("a < b").select("a", "b").distinct()


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``(node, items)``: the whole sets of the documents (doc_id, text) in ``nodes``, as a table."""
    named = nodes.withColumnRenamed("node", "doc_id").hint("merge")  # one plan at every size: each text moves once
    items = arrow_udf(full_set(shingle), "array<bigint>")(F.coalesce("text", F.lit("")))
    rows = docs.join(named, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), items.alias("items"))
    return written(rows, "near-sets")


def answer(found: DataFrame, member: DataFrame, classes: DataFrame) -> DataFrame:
    """Every row of ``found`` with the smallest id its set reaches."""
    reps = member.groupBy("doc_id").agg(F.min("rep").alias("node"))
    named = reps.join(classes, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    named = found.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", *, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest ``key``.

    Of rows with the same key and the same text one stays. Rows without a key all stay.
    """
    classes = near_duplicate_classes(docs, text, key, percent=percent)
    kept_key, turn, held = free_names(docs, "_kept", "_turn", "_digest")
    kept = classes.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(kept_key)).distinct()
    with_key = docs.where(F.col(f"`{key}`").isNotNull()).withColumn(held, F.xxhash64(F.col(f"`{text}`"), F.lit(1)))
    stay = with_key.join(kept, with_key[key].cast("bigint") == F.col(kept_key), "left_semi")
    order = Window.partitionBy(F.col(f"`{key}`"), held).orderBy(F.lit(0))
    stay = stay.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).drop(turn, held)
    return stay.unionByName(docs.where(F.col(f"`{key}`").isNull()))
