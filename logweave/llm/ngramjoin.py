"""Join of documents by the Jaccard similarity of their word n-grams, filtered under several global orders.

Put the n-grams of all documents into one order and sort every set by it: two sets as alike as asked for share
an n-gram among the first ``p = n - ceil(percent * n / 100) + 1`` of each. That holds for any order, so a pair is a
candidate only if it shares prefix n-grams under every one of these, before a full set is looked at:

* rarest first, by the exact number of documents;
* rarest first by classes of that number (powers of two), ties in another order;
* a random order.

Under the first order n-grams that no other document has come first. A document with ``p`` of them or more
is no candidate, which is the case for almost all that are no near copies, whatever passages
they share. To find those without counting every n-gram of the corpus, a first pass counts only the n-grams
whose hash falls in the lowest ``share`` of all hashes, the same of every document: whose *sample* has ``p`` n-grams that
no other document has is out. What is left is counted in full.

The other members of a prefix list are not paired with each other: candidates are star-shaped, round by round
until nothing is open (``stars.py``), then filtered by the other orders, then confirmed on the full sets.
Documents with equal sets come together by a digest before all that.

A null or empty text, or one without words, has an empty set and links with nothing; a row with a null
``doc_id`` links with nothing either. With fewer words than ``size`` the whole sequence is the one n-gram. Rows
with the same ``doc_id`` are one document (it links if any of its texts does); equal rows are answered one by
one. No other columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from logweave.llm.bytewords import U, mix, slices, stream
from logweave.llm.components import components
from logweave.llm.neardup import answer, digests, distinct_sets, sets_of, shingle_sets
from logweave.llm.shared import ship, written
from logweave.llm.stars import held_in_common, star_classes

FEATURES = "struct<n_shingles: bigint, set1: bigint, set2: bigint, sample: array<bigint>>"
SHARES = 2  # the sample is this many times the share of n-grams that a pair may differ in
NAME = U(16)  # bits by which the hashes of sampled n-grams are shortened; if two become equal, a document stays in longer


def prefix_length(n: Column, percent: int) -> Column:
    return n - F.ceil(F.lit(percent) * n / 100).cast("bigint") + 1


def _features(size: int, percent: int):
    """Column function ``text -> FEATURES``."""
    bound = U(min(SHARES * (100 - percent), 100) * ((1 << 64) - 1) // 100)

    @arrow_udf(FEATURES)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, U),) * 5]
            for texts in slices(batch, lower=True):
                sets, at = shingle_sets(texts, size)
                low = mix(sets ^ stream(91, 1)) <= bound
                ends = np.concatenate([[0], np.cumsum(low)])[at]
                parts.append((np.diff(at), *digests(sets, at), np.diff(ends), sets[low] >> NAME))
            n, d1, d2, sampled, sample = (np.concatenate(x) for x in zip(*parts))
            offsets = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sample.astype(np.int64)))
            arrays = [pa.array(n.astype(np.int64)), pa.array(d1.astype(U).view(np.int64)), pa.array(d2.astype(U).view(np.int64)), lists]
            yield pa.StructArray.from_arrays(arrays, names=["n_shingles", "set1", "set2", "sample"])

    return measure


def _open_by_sample(found: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """``(node)``: documents whose sample leaves it open whether they link.

    An n-gram is a set's own if all documents that hold it have that set, however many they are; sets are told apart
    by 48 bits of their digest, so that copies need not be found first.
    """
    rows = found.select(F.shiftright("set1", 16).alias("held"), F.explode("sample").alias("item"))
    own = rows.groupBy("item").agg(F.min("held").alias("lo"), F.max("held").alias("hi")).where("lo = hi")
    own = own.groupBy(F.col("lo").alias("held")).agg(F.count(F.lit(1)).alias("own"))
    reps = member.where("doc_id = rep").select(F.col("rep").alias("node"), "n", F.shiftright("set1", 16).alias("held"))
    left = reps.join(own, "held", "left").where(F.coalesce("own", F.lit(0)) < prefix_length(F.col("n"), percent))
    return written(left.select("node").distinct(), "ngram-open")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``(node, n, items, shared, by_rarity, by_class, by_chance)`` of sets that may link: their prefixes under the three orders.

    N-grams of one document alone are left out of the prefixes, where they meet nothing.
    """
    met = held_in_common(sets)
    cells = F.collect_list(F.struct("df", "item")).alias("cells")
    rows = sets.select("node", F.size("items").cast("bigint").alias("n"), "items").join(met.groupBy("node").agg(cells), "node")
    alone = F.col("n") - F.size("cells")
    rows = rows.withColumn("prefix", prefix_length(F.col("n"), percent)).withColumn("left", (F.col("prefix") - alone).cast("int")).where("left > 0")

    def first(key) -> Column:
        ordered = F.sort_array(F.transform("cells", lambda x: F.struct(*key(x), x["item"].alias("item"))))
        return F.transform(F.slice(ordered, F.lit(1), F.col("left")), lambda x: x["item"])

    def chance(item: Column) -> Column:
        return F.xxhash64(item)

    by_chance = F.transform(F.sort_array(F.transform("items", lambda x: F.struct(chance(x).alias("by"), x.alias("item")))), lambda x: x["item"])
    known = F.transform("cells", lambda x: x["item"])
    return rows.select(
        "node", "n", "items", F.size("cells").cast("bigint").alias("shared"),
        first(lambda x: [x["df"].alias("by")]).alias("by_rarity"),
        first(lambda x: [F.floor(F.log2(x["df"])).alias("by"), chance(x["item"]).alias("then")]).alias("by_class"),
        F.array_intersect(F.slice(by_chance, F.lit(1), F.col("prefix").cast("int")), known).alias("by_chance"),
    )


def similar_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", *, size: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    Documents with ``100 * |intersection| >= percent * |union|`` are linked; a component is what is
    reachable over links, named by its smallest ``doc_id``.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = written(docs.select("doc_id", _features(size, percent)(F.coalesce("text", F.lit(""))).alias("f")).select("doc_id", "f.*"), "ngram-features")
    member, same = distinct_sets(found.drop("sample"))
    left = _open_by_sample(found, member, percent)
    if left.isEmpty():
        return _rows(answer(found, member, components(same)))
    sets = written(prefixes(sets_of(docs, left, size), percent), "ngram-prefixes")
    active = sets.select(F.explode("by_rarity").alias("bucket"), "node", "n", "shared")
    return _rows(answer(found, member, star_classes(active, sets, percent, same, ["by_class", "by_chance"])))


def _rows(classes: DataFrame) -> DataFrame:
    return classes.select("doc_id", "n_shingles", "component_id")
