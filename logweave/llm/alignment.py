"""Alignment of the tokens of two tokenizers over the same texts.

Each text, with a space before it, is a byte sequence that both tokenizers cut. Offsets where a token of
both ends cut it into groups. Two tokens are linked where their byte ranges end together, and an id pair's count
is the number of links of the whole corpus that hold it.

Most groups are one token of either side with the same bytes. For them an identity map, made before any text is
read, names the B id of every A id; such a group is counted by its A id alone, in vectors as long as the vocabulary,
which tasks add up by themselves. Only links of other groups enter the shuffle of pairs, once per document and pair.

Texts are tokenized once; what is kept of each is written (its different links and their number, the digest of
its groups). The sums over its links are then looked up: those of the identity map in a vector, pairs that have
1/``HOT`` or more of all entries (so at most ``HOT`` pairs) in a table sent to all tasks, all others by a join
in which, so, no key is large.

A text that is null or empty, or that the tokens of one side do not give back byte for byte (as where a
tokenizer rewrites characters), has no tokens: zeros and ``''``. Texts are read whole; one text is held with some
hundred bytes per byte of it. Rows are answered one by one, repeated ones and those without an id too; an
empty table gives no rows; no other columns are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from logweave.llm.packing import TextIds
from logweave.llm.shared import ship, written

HOT = 4096
CHARS = 1 << 18  # of texts aligned at a time; a longer text is aligned by itself
ROW = (
    "struct<n_a: bigint, n_b: bigint, n_groups: bigint, groups_sha256: string, same: array<int>, same_n: array<int>,"
    " pairs: array<bigint>, pairs_n: array<int>>"
)


def byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: those that print are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Vocabulary:
    """The bytes of every token, and the text of its id as a byte row."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after the other."""
        length = self.length[ids]
        shift = self.start[ids] - (np.cumsum(length) - length)
        return self.data[np.repeat(shift, length) + np.arange(int(length.sum()))]


class Both:
    """Two tokenizers: byte-level BPE from a ``tokenizers`` file (A), a ``sentencepiece`` model (B)."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        with open(byte_level, encoding="utf-8") as file:
            spec = json.load(file)
        letters, words = byte_letters(), {n: t for t, n in spec["model"]["vocab"].items()}
        tokens = [words.get(i, "") for i in range(max(words) + 1)]
        a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]
        self.ids_a = TextIds(byte_level)
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        b = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
        self.a, self.b = Vocabulary(a), Vocabulary(b)
        ids: dict[bytes, int] = {}
        for i, t in enumerate(b):  # of a character and its byte, the character
            if t and (t not in ids or not model.is_byte(i)) and not (model.is_control(i) or model.is_unknown(i)):
                ids[t] = i
        self.same = np.array([ids.get(t, -1) for t in a], np.int64)
        digits = len(str(max(len(a), len(b))))
        signs = [*(f"{i}{e}" for e in ",|" for i in range(len(a))), *(f"{i}{e}" for e in ",;" for i in range(len(b)))]
        self.signs = np.array(signs, f"S{digits + 1}").view(np.uint8).reshape(len(signs), digits + 1)

    def align(self, texts: list[str]) -> list[tuple]:
        """What ``ROW`` names, for every text."""
        whole = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        ids_a = [np.array(self.ids_a(" " + t) if t else [], np.int32) for t in texts]
        ids_b = [np.array(self.model.encode(t), np.int32) for t in texts]
        out: list[tuple] = [(0, 0, 0, "", *(np.zeros(0, np.int64) for _ in range(4)))] * len(texts)
        right = [i for i, w in enumerate(whole) if w]
        for ids, words in ((ids_a, self.a), (ids_b, self.b)):
            flat = _joined([ids[i] for i in right])
            ends = np.concatenate([[0], np.cumsum(words.length[flat])])[np.cumsum([0, *(len(ids[i]) for i in right)])]
            spelled = words.spelled(flat).tobytes()
            right = [i for i, x, y in zip(right, ends[:-1], ends[1:]) if spelled[x:y] == whole[i]]
        if right:
            for i, row in zip(right, self._aligned([ids_a[i] for i in right], [ids_b[i] for i in right])):
                out[i] = row
        return out

    def _aligned(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray]) -> Iterator[tuple]:
        n_a, n_b = (np.array([len(x) for x in ids]) for ids in (ids_a, ids_b))
        a, b = _joined(ids_a), _joined(ids_b)
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        cut = np.zeros(int(end_a[-1]) + 1, np.uint8)
        cut[end_a] = 1
        cut[end_b] += 2
        last_a, last_b = cut[end_a] == 3, cut[end_b] == 3
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        held_a, held_b = np.bincount(group_a), np.bincount(group_b)
        doc = np.repeat(np.arange(len(n_a)), n_a)[last_a]
        n_groups = np.bincount(doc, minlength=len(n_a))
        x, y = a[last_a], b[last_b]  # of every group its link
        plain = (held_a == 1) & (held_b == 1) & (self.same[x] == y)
        same = _counted(doc[plain], x[plain], self.a.size, len(n_a))
        pairs = _counted(doc[~plain], x[~plain] * self.b.size + y[~plain], self.a.size * self.b.size, len(n_a))
        # The groups as text: tokens in their order, each with the sign that follows it.
        before_a, before_b = np.cumsum(held_b) - held_b, np.cumsum(held_a)
        signs = np.empty(len(a) + len(b), np.int64)
        signs[np.arange(len(a)) + before_a[group_a]] = a + np.where(last_a, self.a.size, 0)
        signs[np.arange(len(b)) + before_b[group_b]] = b + np.where(last_b, self.b.size, 0) + 2 * self.a.size
        letters = self.signs[signs]
        there = letters != 0
        ends = np.concatenate([[0], np.cumsum(there.sum(1))])[np.cumsum([0, *(n_a + n_b)])]
        text = letters[there].tobytes()
        for k in range(len(n_a)):
            digest = hashlib.sha256(text[ends[k] : ends[k + 1] - 1]).hexdigest()  # less the last sign
            yield int(n_a[k]), int(n_b[k]), int(n_groups[k]), digest, *same[k], *pairs[k]


def _joined(ids: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int64)


def _counted(doc: np.ndarray, value: np.ndarray, bound: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of every document its different values, and how often each is there."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    doc, value, times = doc[first], value[first], np.diff(np.append(first, len(doc)))
    at = np.searchsorted(doc, np.arange(n + 1))
    return [(value[i:j], times[i:j]) for i, j in zip(at[:-1], at[1:])]


@lru_cache(maxsize=1)
def _both(byte_level: str, pieces: str) -> Both:
    return Both(byte_level, pieces)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), kind))


def groups(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(row, key, *ROW)``: each row of ``docs`` with the numbers of its tokens and groups and its different links.

    ``same`` holds the A ids of links of the identity map, ``pairs`` other links as ``a * size of B + b``.
    """

    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        both = _both(byte_level, pieces)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        for batch in batches:
            rows: list[tuple] = []
            few, held = [], 0
            for value in batch:
                few.append(value.as_py() or "")
                held += len(few[-1])
                if held >= CHARS:
                    rows += both.align(few)
                    few, held = [], 0
            rows += both.align(few)
            columns = [list(c) for c in zip(*rows)] or [[]] * 8
            arrays = [pa.array(c, k) for c, k in zip(columns[:4], kinds)] + [_lists(c, k) for c, k in zip(columns[4:], kinds[4:])]
            yield pa.StructArray.from_arrays(arrays, names=["n_a", "n_b", "n_groups", "groups_sha256", "same", "same_n", "pairs", "pairs_n"])

    ship(docs.sparkSession)
    found = arrow_udf(measure, ROW)(F.col(f"`{text}`").cast("string"))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias(key), found.alias("found")).select("row", key, "found.*")


def _sums(size: int):
    """Sums of ``same_n`` by ``same`` in one vector a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids, times = (np.asarray(batch.column(c).flatten()) for c in ("same", "same_n"))
            total += np.bincount(ids, times, size).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["a", "n"])

    return add


def align(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of each row of ``docs``.

    ``count_sum`` adds the corpus-wide counts of the id pairs of the row's links; ``n_best`` is the number of links
    whose pair is (among) the most frequent of its B id.
    """
    spark = docs.sparkSession
    both = _both(byte_level, pieces)
    size, same = both.b.size, both.same
    found = written(groups(docs, byte_level, pieces, text, key), "aligned")
    entries = found.select("row", F.explode(F.arrays_zip("pairs", "pairs_n")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.pairs_n").alias("n"))
    counts = written(entries.groupBy("pair").agg(F.sum("n").alias("links"), F.count("n").alias("held")), "aligned-pairs")
    # Vectors as long as a vocabulary.
    links = np.zeros(len(same), np.int64)
    for r in found.select("same", "same_n").mapInArrow(_sums(len(same)), "a bigint, n bigint").groupBy("a").agg(F.sum("n").alias("n")).toLocalIterator():
        links[r["a"]] = r["n"]
    best = np.zeros(size, np.int64)
    np.maximum.at(best, same[same >= 0], links[same >= 0])
    for r in counts.groupBy((F.col("pair") % size).alias("b")).agg(F.max("links").alias("n")).toLocalIterator():
        best[r["b"]] = max(best[r["b"]], r["n"])
    held = counts.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    hot = counts.where(F.col("held") * HOT >= F.lit(held)).select("pair", "links")
    top = sorted((r["pair"], r["links"]) for r in hot.toLocalIterator())
    sent = spark.sparkContext.broadcast((links, best, np.array([p for p, _ in top], np.int64), np.array([n for _, n in top], np.int64), same, size))

    @arrow_udf("struct<n_best: bigint, count_sum: bigint>")
    def known(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        links, best, keys, key_links, same, size = sent.value
        for ids, times, pairs, pairs_n in batches:
            out = np.zeros((2, len(ids)), np.int64)
            for lists, number, frequent in ((ids, times, False), (pairs, pairs_n, True)):
                value, n = np.asarray(lists.flatten()), np.asarray(number.flatten()).astype(np.int64)
                row = np.repeat(np.arange(len(ids)), np.asarray(pa.compute.list_value_length(lists)))
                if not frequent:
                    count, b = links[value], same[value]
                elif len(keys):
                    at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                    mine = keys[at] == value
                    value, n, row, count = value[mine], n[mine], row[mine], key_links[at[mine]]
                    b = value % size
                else:
                    continue
                np.add.at(out[0], row, n * (best[b] == count))
                np.add.at(out[1], row, n * count)
            yield pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n_best", "count_sum"])

    base = found.select("row", key, "n_a", "n_b", "n_groups", "groups_sha256", known("same", "same_n", "pairs", "pairs_n").alias("known"))
    highest = spark.createDataFrame([(int(b), int(n)) for b, n in enumerate(best) if n], "b int, best bigint")
    rare = counts.join(F.broadcast(highest), F.col("pair") % size == F.col("b")).select("pair", "links", (F.col("links") == F.col("best")).cast("int").alias("is_best"))
    looked_up = entries.join(F.broadcast(hot), "pair", "left_anti").join(rare.hint("merge"), "pair")
    sums = looked_up.groupBy("row").agg(F.sum(F.col("n") * F.col("links")).alias("more_sum"), F.sum(F.col("n") * F.col("is_best")).alias("more_best"))
    rows = base.join(sums.hint("merge"), "row", "left")
    return rows.select(
        key, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        (F.col("known.n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("known.count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
