"""Language identification by cross-parsing.

Each language is known by a bounded sample of labelled text, kept as a suffix automaton: it accepts every
substring of the sample. A text is parsed against a language into the longest phrases that occur in its
sample; the fewer phrases, the closer the language. With c phrases against a sample of N characters the
parse costs c * log2(N) bits; the language with the lowest cost wins, ties go to the first by name. The score
is the winner's share when costs are read as code lengths: 1 / sum(2 ** (best - cost)).

Only letters count, in lower case; any run of other characters is one space. Texts are parsed whole, in
blocks of ``BLOCK`` characters that each begin a new phrase: all blocks of a batch advance together, one
character at a time, through transition tables, so long texts take no longer per character than short ones.
A letter beyond the ``ALPHABET`` most frequent of a sample is a phrase by itself.

The sample: of each language up to ``SAMPLE_ROWS`` documents in the order of a hash of their id, cut at
``SAMPLE_CHARS`` characters together. The most frequent ``MOST_LANGUAGES`` labels are learned. These bounds
are what the model holds; every text is parsed whole.

A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be learned.
Rows are answered one by one, repeated ones too; extra columns pass through unless they bear a result's name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from logweave.llm.shared import ship

SAMPLE_ROWS = 400
SAMPLE_CHARS = 40_000
MOST_LANGUAGES = 200
ALPHABET = 120
BLOCK = 512
CHARS = 1 << 20  # characters parsed at a time
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points of the text in lower case; what is no letter is 0, and stands once."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, 0)
    if not len(points):
        return points
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    return points[keep]


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Suffix automaton: transitions of every state, the first one being the start."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for symbol in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at != -1 and symbol not in step[at]:
            step[at][symbol] = new
            at = link[at]
        if at != -1:
            to = step[at][symbol]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at != -1 and step[at].get(symbol) == to:
                    step[at][symbol] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return step


class Language:
    """A sample as a transition table. An entry is twice the place of the next state's row, plus 1 if a phrase begins."""

    def __init__(self, sample: str):
        codes = _codes(sample)
        common = [c for c, _ in Counter(codes.tolist()).most_common(ALPHABET)]
        self.symbol = np.full(0x110000, len(common), np.uint8)  # the last symbol is any other letter
        self.symbol[common] = np.arange(len(common))
        width = self.width = len(common) + 1
        coded = self.symbol[codes].tolist()
        steps = automaton(coded)
        self.bits = math.log2(max(len(coded), 2))
        first = np.zeros(width, np.int64)  # where a phrase that begins with a symbol goes on
        for symbol, to in steps[0].items():
            first[symbol] = to
        first[width - 1] = 0
        table = np.empty((len(steps), width), np.int64)
        table[:] = first * width * 2 + 1
        for state, edges in enumerate(steps):
            if state:
                for symbol, to in edges.items():
                    if symbol != width - 1:
                        table[state, symbol] = to * width * 2
        self.table = table.ravel().astype(np.int32 if table.max() < 2**31 else np.int64)

    def phrases(self, lanes: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Number of phrases of each lane; ``lanes`` has a row per step, of which the first ``active[step]`` lanes go on."""
        state = np.zeros(lanes.shape[1], self.table.dtype)
        count = np.zeros(lanes.shape[1], np.int64)
        for row, n in zip(lanes, active):
            entry = self.table.take((state[:n] >> 1) + self.symbol.take(row[:n]))
            count[:n] += entry & 1
            state[:n] = entry
        return count


@lru_cache(maxsize=4)
def _languages(samples: tuple[tuple[str, str], ...]) -> list[tuple[str, Language]]:
    return [(name, Language(sample)) for name, sample in samples]


def costs(languages: list[tuple[str, Language]], codes: list[np.ndarray]) -> np.ndarray:
    """Bits that each text costs in each language."""
    sizes = np.array([len(c) for c in codes], np.int64)  # typed, as there may be no text
    flat = np.concatenate(codes) if len(codes) else np.zeros(0, np.uint32)
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(codes)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
    length = np.minimum(sizes[owner] - nth * BLOCK, BLOCK) if len(owner) else np.zeros(0, int)
    order = np.argsort(-length, kind="stable")  # long lanes first: those still going are always in front
    owner, start, length = owner[order], start[order], length[order]
    steps = int(length.max()) if len(length) else 0
    lanes = np.zeros((steps, len(length)), np.uint32)
    for k in range(steps):
        n = np.searchsorted(-length, -k, "left")
        lanes[k, :n] = flat[start[:n] + k]
    active = [int(np.searchsorted(-length, -k, "left")) for k in range(steps)]
    out = np.zeros((len(codes), len(languages)))
    for j, (_, language) in enumerate(languages):
        out[:, j] = np.bincount(owner, language.phrases(lanes, active), len(codes)) * language.bits
    return out


def learn(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[tuple[str, str], ...]:
    """Samples ``(language, text)`` from the rows that are ``usable`` and have both.

    Rows are chosen by key first, with at most ``SAMPLE_ROWS`` of a language leaving a task; only
    chosen texts are read.
    """
    rows = docs.where(usable & F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull() & F.col(f"`{key}`").isNotNull())
    rows = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{lang}`").cast("string").alias("name"), F.col(f"`{text}`").cast("string").alias("body"))
    labels = [r["name"] for r in rows.groupBy("name").count().orderBy(F.desc("count"), "name").limit(MOST_LANGUAGES).collect()]
    order = Window.partitionBy("name").orderBy(F.xxhash64("id"), "id")
    chosen = rows.where(F.col("name").isin(labels)).select("id", "name").withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= SAMPLE_ROWS)
    share = SAMPLE_CHARS  # no more of one text than the whole sample holds
    texts = rows.join(F.broadcast(chosen), ["id", "name"]).select("name", "turn", "id", F.substring("body", 1, share).alias("body"))
    samples: dict[str, list[str]] = {}
    room: dict[str, int] = {}
    for row in texts.orderBy("name", "turn", F.length("body"), "body").toLocalIterator():
        left = room.setdefault(row["name"], SAMPLE_CHARS)
        if left > 0:
            samples.setdefault(row["name"], []).append(row["body"][:left])
            room[row["name"]] = left - len(row["body"]) - 1
    return tuple((name, " ".join(parts)) for name, parts in sorted(samples.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages = _languages(samples)
        names = [name for name, _ in languages]
        for batch in batches:
            found: list[str] = []
            scores: list[float] = []
            codes: list[np.ndarray] = []
            held = 0

            def flush() -> None:
                cost = costs(languages, codes)
                for own, row in zip(codes, cost):
                    if not names or not own.any():
                        found.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        best = int(row.argmin())
                        found.append(names[best])
                        scores.append(float(1 / np.exp2(np.maximum(row[best] - row, -1000.0)).sum()))

            for value in batch:
                codes.append(_codes(value.as_py() or ""))
                held += len(codes[-1])
                if held > CHARS:
                    flush()
                    codes, held = [], 0
            flush()
            yield pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    ship(docs.sparkSession)
    found = arrow_udf(predict, "struct<lang_pred: string, score: double>")(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.select(*rest, found.alias("_found")).select(*rest, "_found.lang_pred", "_found.score")
