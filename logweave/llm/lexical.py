"""Ranked lexical search over a K2-treap index.

Terms are the longest runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case.
``index`` deals the documents, as they are read, into blocks of neighbours. Each block is a grid of its
terms by its documents that holds what a term adds to the score of a document, kept as a K2-treap
(``treap.py``): a quadtree whose cells hold the largest number below them. Nothing is shuffled for it.

``search`` descends the grids of all blocks for every item: the paths of the item's terms go down together
over ranges of documents, the most promising range first, until no range left can reach the item's best
``k``. What an item has found bounds the next blocks of the task, and a task hands on ``k`` rows an item
at most; these are merged. The result is exact.

With ``N`` documents that have a term, ``L`` their terms in all, ``n`` the terms of one document, ``df`` the
documents that hold a term and ``tf`` its places in one document, a document scores the sum over the item's
different terms of ``w * ((1000000000 * tf) div (1000 * tf + 20 * m))`` with ``w = floor(1000 * ln((2 * N + 2) /
(2 * df + 1)))`` and ``m = 100 - 50 + ((50 * n * N) div L)``. Terms are compared by 64-bit hashes.

Documents with a null or empty text, or without a term, are found by nothing and not counted; items of that
kind find nothing. Repeated rows of documents are ranked each, those without an id after others of the same
score; rows of items are answered each, under their own id. Items go to the workers in chunks of
``CHUNK_TERMS`` terms (an item with more is a chunk). Texts are read whole, long ones part by part; a block has
at most ``BLOCK_DOCUMENTS`` documents and is closed once it has ``BLOCK_CELLS`` cells. Only the named columns
are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from logweave.llm.bytewords import MARKS, U, parts
from logweave.llm.shared import ship, written
from logweave.llm.treap import Best, Treap, pack

BLOCK_DOCUMENTS = 4096
BLOCK_CELLS = 1 << 19
CHUNK_TERMS = 200_000  # of items that go to the workers together
BLOCKS = "documents array<bigint>, terms binary, held binary, cells binary"


def text_terms(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of texts, hashes of their terms and how often each stands there; a long text comes in several parts."""
    for number, few in parts(texts, MARKS):
        words = few.words()
        doc = np.repeat(np.arange(len(few)), words.counts()) + number
        hashes = words.hashes()
        yield _summed(doc, hashes, np.ones(len(doc), np.int64))


def _summed(doc: np.ndarray, hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of text and term once, in order, with the sum of its times."""
    order = np.lexsort((hashes, doc))
    doc, hashes, times = doc[order], hashes[order], times[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return doc[first], hashes[first], np.add.reduceat(times, first) if len(first) else times


@dataclass(frozen=True)
class Index:
    """Blocks of an indexed table, and what is counted over all of it."""

    blocks: DataFrame
    documents: int  # that have a term
    terms: int  # of all documents


def index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Index:
    """The index of ``docs``; its blocks are a table in the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            for number, few in parts(batch, MARKS):
                out[number : number + len(few)] += few.words().counts()
            yield pa.array(out)

    n = arrow_udf(counted, "bigint")("text")
    documents, terms = rows.select(n.alias("n")).where("n > 0").agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            base = len(ids)
            ids += names
            for doc, hashes, times in text_terms(batch.column("text")):
                cells.append((doc + base, hashes, times))
                held += len(doc)
            if len(ids) >= BLOCK_DOCUMENTS or held >= BLOCK_CELLS:
                yield from _blocks(ids, cells, documents, terms)
                ids, cells, held = [], [], 0
        if ids:
            yield from _blocks(ids, cells, documents, terms)

    return Index(written(rows.mapInArrow(blocks, BLOCKS), "lexical-blocks"), documents, terms)


def _blocks(ids: list[int | None], cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]], documents: int, terms: int) -> Iterator[pa.RecordBatch]:
    """The blocks of the gathered documents."""
    doc, hashes, times = (np.concatenate(x) for x in zip(*cells))
    for start in range(0, len(ids), BLOCK_DOCUMENTS):
        mine = (doc >= start) & (doc < start + BLOCK_DOCUMENTS)
        own = _block(ids[start : start + BLOCK_DOCUMENTS], doc[mine] - start, hashes[mine], times[mine], documents, terms)
        if own is not None:
            yield own


def _block(ids: list[int | None], doc: np.ndarray, hashes: np.ndarray, times: np.ndarray, documents: int, terms: int) -> pa.RecordBatch | None:
    if not len(doc):
        return None
    doc, hashes, times = _summed(doc, hashes, times)  # the parts of a long text meet here
    n = np.bincount(doc, weights=times, minlength=len(ids)).astype(np.int64)
    m = 50 + (50 * n * documents) // terms
    adds = (1_000_000_000 * times) // (1000 * times + 20 * m[doc])
    names, row, found = np.unique(hashes, return_inverse=True, return_counts=True)
    frequent = np.argsort(-found, kind="stable")  # rows of frequent terms lie together
    place = np.empty(len(names), np.int64)
    place[frequent] = np.arange(len(names))
    # A long document may add less than 1 by a term, which is no cell but counts for the frequency.
    some = adds > 0
    grid = pack(place[row][some], doc[some], adds[some], len(names), len(ids))
    held = pa.compress(found[frequent].astype("<u4").tobytes(), "zstd", asbytes=True)
    columns = [pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (names[frequent].astype("<u8").tobytes(), held, grid))]
    return pa.RecordBatch.from_arrays(columns, names=["documents", "terms", "held", "cells"])


def item_terms(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """``(item, item_id, term)``: the different terms of each row of ``items``, rows numbered."""

    def terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            doc, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U)]
            for numbers, own, _ in text_terms(batch):
                doc.append(numbers)
                hashes.append(own)
            offsets = np.searchsorted(np.concatenate(doc), np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(hashes).view(np.int64)))

    ship(items.sparkSession)
    found = arrow_udf(terms, "array<bigint>")(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{key}`").alias("item_id"), F.array_distinct(found).alias("terms"))
    return written(rows, "lexical-items").select("item", "item_id", F.explode("terms").alias("term"))


def search(built: Index, items: DataFrame, k: int = 50, text: str = "text", key: str = "item_id") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: of each item the ``k`` documents with the highest scores above 0, equal ones by ascending id."""
    spark = items.sparkSession
    wanted = item_terms(items, text, key)
    total = wanted.count()
    chunks = max(1, -(-total // CHUNK_TERMS))
    chunk = F.pmod(F.xxhash64("item"), F.lit(chunks))
    results = []
    for number in range(chunks):
        asked = wanted.where(chunk == number)
        terms = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in asked.select("term").distinct().toLocalIterator()], np.int64).view(U)))
        df = built.blocks.select("terms", "held").mapInArrow(_frequencies(terms), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(built.documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
        weighted = asked.join(df, "term").select("item", "term", weight.alias("weight")).where("weight > 0")
        held = sorted(weighted.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).toLocalIterator())
        paths = [(r["item"], np.array([t["term"] for t in r["terms"]], np.int64).view(U), np.array([t["weight"] for t in r["terms"]], np.int64)) for r in held]
        found = built.blocks.select("documents", "terms", "cells").mapInArrow(_descended(spark.sparkContext.broadcast(paths), k), "item bigint, doc_id bigint, score bigint")
        results.append(found)
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    names = wanted.select("item", "item_id").distinct()
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def _frequencies(terms):
    """How many documents of each block hold each asked term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for names, held in zip(*(batch.column(c) for c in ("terms", "held"))):
                names = np.frombuffer(names.as_py(), "<u8")
                found = np.frombuffer(pa.decompress(held.as_py(), 4 * len(names), "zstd", asbytes=True), "<u4")
                order = np.argsort(names)
                at = order[np.minimum(np.searchsorted(names, wanted, sorter=order), len(names) - 1)]
                total += np.where(names[at] == wanted, found[at], 0)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[there].view(np.int64)), pa.array(total[there])], names=["term", "df"])

    return count


def _descended(paths, k: int):
    """The best of each item among the blocks of a task."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = paths.value
        best = [Best(k) for _ in items]
        for batch in batches:
            for ids, names, cells in zip(*(batch.column(c) for c in ("documents", "terms", "cells"))):
                names, ids, grid = np.frombuffer(names.as_py(), "<u8"), ids.as_py(), Treap(cells.as_py())
                order = np.argsort(names)
                for (_, terms, weights), worth in zip(items, best):
                    at = order[np.minimum(np.searchsorted(names, terms, sorter=order), len(names) - 1)]
                    there = names[at] == terms
                    grid.best(at[there], weights[there], worth, ids)
        rows = [(item, doc_id, score) for (item, _, _), worth in zip(items, best) for score, doc_id in worth.rows()]
        columns = [pa.array(list(x), pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return descend
