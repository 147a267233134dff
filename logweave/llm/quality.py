"""Quality rules by distribution divergence.

A text is compared with the writing of its language: how its characters spread over classes, and
how its words spread over the common words of that language. The distance is Jensen-Shannon's
(square root of the divergence to base 2, 0 to 1). References are learned from all texts of the
table, one per language.

* Common words are kept as hashed buckets: each word falls into one of ``2**12``; a bucket is
  common where it holds at least ``common_share`` of the language's words (so at most
  ``1 / common_share`` are), all others count together. Counting is exact, of fixed size, and sums
  over tasks in any order.
* A language has a reference if its texts hold ``reference_words`` words or more, whatever its share
  of the table. References are a table with a row of bounded size per language, joined on the language,
  so no number of languages is too many. A text of another or no language has no reference: its
  distances are 0 and the base rules alone decide, as nothing is known of its writing.
* Guards: below ``min_chars`` characters that are no white space the class distance does not
  count, below ``min_words`` words the word distance does not; short texts spread too much.

Null and empty texts have no words, fail the base rules and are not kept. Repeated rows are judged
each; extra columns pass through unless they bear the name of a result, which replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from logweave.llm.bytewords import Texts, ngrams, slices, span_hashes
from logweave.llm.shared import free_names, ship, written

BUCKETS = 1 << 12
SYMBOLS = b"#*$%&|<>"
# Character classes by byte: a code point is counted at its first byte.
LOWERCASE, UPPERCASE, WIDE, DIGIT, SPACE, STOP, SYMBOL, OTHER = range(8)
CLASSES = 8
KIND = np.full(256, OTHER, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58] = LOWERCASE, UPPERCASE, DIGIT
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[list(b".,;:!?'\"()-")] = STOP
KIND[list(SYMBOLS)] = SYMBOL
KIND[192:] = WIDE  # begins a character beyond ASCII
CONTINUES = np.zeros(256, bool)
CONTINUES[128:192] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring positions ``at``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _kinds(texts: Texts) -> np.ndarray:
    """Characters of each class per text."""
    first = ~CONTINUES[texts.data]
    doc = np.repeat(np.arange(len(texts)), np.diff(texts.at))
    flat = np.bincount(doc[first] * CLASSES + KIND[texts.data[first]], minlength=len(texts) * CLASSES)
    return flat.reshape(len(texts), CLASSES)


def _dup_lines(texts: Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    data, n = texts.data, len(texts.data)
    cut = np.flatnonzero(data == 10)
    start = np.union1d(texts.at[:-1], cut + 1)
    start = start[start < n]
    doc = np.searchsorted(texts.at, start, "right") - 1
    end = np.minimum(np.append(cut, n)[np.searchsorted(cut, start)], texts.at[doc + 1])
    has = np.zeros(n + 1, np.int64)
    np.cumsum((KIND[data] != SPACE), out=has[1:])
    worded = has[end] > has[start]
    start, end, doc = start[worded], end[worded], doc[worded]
    h = span_hashes(data, start, end)
    order = np.lexsort((h, doc))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][same], minlength=len(texts))


def _repeat_words(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words that lie in a window of three words found twice or more in their text."""
    grams, where = ngrams(hashes, at, 3, 7)
    doc = np.searchsorted(at, where, "right") - 1
    bounds = np.searchsorted(doc, np.arange(len(at)))
    twice = np.zeros(len(grams), bool)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a > 1:
            order = np.argsort(grams[a:b], kind="stable")
            g = grams[a:b][order]
            same = g[1:] == g[:-1]
            twice[a + order[1:][same]] = True
            twice[a + order[:-1][same]] = True
    hit = np.zeros(len(hashes) + 3, bool)
    starts = where[twice]
    for k in range(3):
        hit[starts + k] = True
    return _sums(hit[: len(hashes)], at)


MEASURES = "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, kinds: array<bigint>>"


def base_measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The counts of the base rules and the character classes of each text."""
    for batch in batches:
        found: list[list[np.ndarray]] = [[] for _ in range(6)]
        for texts in slices(batch):
            words = texts.words()
            kinds = _kinds(texts)
            n_words = words.counts()
            solid = kinds.sum(1) - kinds[:, SPACE]
            for out, v in zip(found, (n_words, solid, kinds[:, SYMBOL], _dup_lines(texts), _repeat_words(words.hashes(), words.at), kinds)):
                out.append(v)
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found[:5]]
        kinds = np.concatenate(found[5]).ravel() if found[5] else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * CLASSES, pa.array(kinds, pa.int64()))
        yield pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in columns), lists], names=[*BASE, "kinds"])


def _buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word, and its text."""
    words = texts.words()
    return (words.hashes() >> np.uint64(52)).astype(np.int64), np.repeat(np.arange(len(texts)), words.counts())


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one task: per language the characters of each class (kind 0) and words of each bucket (kind 1)."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        done = 0
        for texts in slices(batch.column(0)):
            own = np.array(langs[done : done + len(texts)])
            done += len(texts)
            kinds, (bucket, doc) = _kinds(texts), _buckets(texts)
            for lang in np.unique(own):
                mine = own == lang
                a, b = sums.setdefault(str(lang), (np.zeros(CLASSES, np.int64), np.zeros(BUCKETS, np.int64)))
                a += kinds[mine].sum(0)
                b += np.bincount(bucket[mine[doc]], minlength=BUCKETS)
        if len(sums) > 64:  # hand on what many languages have gathered, so memory stays bounded
            yield _emit(sums)
            sums = {}
    if sums:
        yield _emit(sums)


def _emit(sums: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    lang, kind, at, n = [], [], [], []
    for name, pair in sums.items():
        for k, counts in enumerate(pair):
            there = np.flatnonzero(counts)
            lang += [name] * len(there)
            kind += [k] * len(there)
            at.append(there)
            n.append(counts[there])
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(kind, pa.int32()), pa.array(np.concatenate(at or [[]]), pa.int32()), pa.array(np.concatenate(n or [[]]), pa.int64())],
        names=["lang", "kind", "at", "n"],
    )


REFERENCE = "struct<kinds: array<double>, at: array<int>, share: array<double>>"


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common_share: float = 0.005, reference_words: int = 5000) -> DataFrame:
    """``(lang, reference)``: of each language with enough words the shares of character classes and of common word buckets.

    One pass over the texts, sums of fixed size; a language has at most ``CLASSES + BUCKETS`` sums.
    """
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.mapInArrow(_language_counts, "lang string, kind int, at int, n bigint").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))
    cells = F.sort_array(F.collect_list(F.struct("kind", "at", "n")))

    def total(kind: int) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))

    per = counts.groupBy("lang").agg(total(0).alias("chars"), total(1).alias("words"), cells.alias("cells")).where(F.col("words") >= F.lit(max(1, reference_words)))
    common = F.filter("cells", lambda c: (c["kind"] == 1) & (c["n"] / F.col("words") >= common_share))
    classes = F.map_from_entries(F.transform(F.filter("cells", lambda c: c["kind"] == 0), lambda c: F.struct(c["at"], c["n"] / F.col("chars"))))
    kinds = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.coalesce(F.try_element_at(classes, k), F.lit(0.0)))
    places, shares = F.transform(common, lambda c: c["at"]), F.transform(common, lambda c: c["n"] / F.col("words"))
    return per.select("lang", F.struct(kinds.alias("kinds"), places.alias("at"), shares.alias("share")).cast(REFERENCE).alias("reference"))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance between rows of ``p`` and ``q``; rows sum to 1, a row of zeros gives 1."""
    m = (p + q) / 2

    def gain(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(-1)

    return np.where(p.sum(-1) > 0, np.sqrt(np.clip((gain(p) + gain(q)) / 2, 0, 1)), 1.0)


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(-1, keepdims=True), 1)


def _held_against(reference: dict, kinds: np.ndarray, bucket: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Both distances of texts of one language: their class counts, and buckets of their words with the number of the text."""
    n, width = len(kinds), len(reference["at"]) + 1
    place = np.full(BUCKETS, width - 1)  # of a bucket in the histogram; the last takes all others
    place[np.array(reference["at"], np.int64)] = np.arange(width - 1)
    share = np.array(reference["share"], float)
    flat = np.bincount(doc * width + place[bucket], minlength=n * width)
    words = js_distance(_shares(flat.reshape(n, width)), np.append(share, 1 - share.sum()))
    return np.stack([js_distance(_shares(kinds), np.array(reference["kinds"])), words], 1)


FAR = "struct<class_distance: double, word_distance: double>"


def distances(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """``(text, lang, reference)``: both distances to the reference of the language, 0 where there is none."""
    for text, lang, reference in batches:
        there = np.asarray(reference.is_valid())
        names, done = np.array([x or "" for x in lang.to_pylist()], object), 0
        out: list[np.ndarray] = []
        for texts in slices(text):
            rows = slice(done, done + len(texts))
            kinds, (bucket, doc) = _kinds(texts), _buckets(texts)
            far = np.zeros((len(texts), 2))
            for name in set(names[rows][there[rows]]):
                mine = there[rows] & (names[rows] == name)
                number, held = np.cumsum(mine) - 1, mine[doc]
                own = reference[done + int(np.argmax(mine))].as_py()
                far[mine] = _held_against(own, kinds[mine], bucket[held], number[doc[held]])
            out.append(far)
            done += len(texts)
        both = np.concatenate(out) if out else np.zeros((0, 2))
        yield pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["class_distance", "word_distance"])


def quality(
    docs: DataFrame, text: str = "text", lang: str = "lang", *, max_class_distance: float = 0.3, max_word_distance: float = 0.4,
    min_chars: int = 200, min_words: int = 50, common_share: float = 0.005, least_words: int = 50, most_repeated: int = 50,
    reference_words: int = 5000,
) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, both distances and ``kept``.

    ``most_repeated`` is a percentage: a text fails when more of its words lie in repeated windows.
    """
    ship(docs.sparkSession)
    held, far, name, usual = free_names(docs, "_base", "_far", "_name", "_usual")
    # Written, so that the join knows its size: broadcast while small, else shuffled and a hot language split.
    refs = written(references(docs, text, lang, common_share, reference_words), "quality-references").toDF(name, usual)
    read, own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.col(f"`{lang}`").cast("string")
    rows = docs.join(refs, own == F.col(name), "left")
    rows = rows.withColumn(held, arrow_udf(base_measures, MEASURES)(read)).withColumn(far, arrow_udf(distances, FAR)(read, own, F.col(usual)))

    def base(name: str) -> Column:
        return F.col(f"{held}.{name}")

    failed = (base("n_words") < least_words) | (100 * base("n_repeat_words") > most_repeated * base("n_words"))
    strange = (F.col(f"{far}.class_distance") > max_class_distance) & (base("word_chars") >= min_chars)
    strange = strange | ((F.col(f"{far}.word_distance") > max_word_distance) & (base("n_words") >= min_words))
    made = {name: base(name) for name in BASE} | {"class_distance": F.col(f"{far}.class_distance"), "word_distance": F.col(f"{far}.word_distance")}
    return rows.withColumns(made | {"base_failed": failed, "kept": ~failed & ~strange}).drop(held, far, name, usual)
