"""Best-fit packing of documents into training sequences under several capacities at once.

Every sequence has room for tokens, for documents and for attention cost (the sum of squared lengths,
which is what attention within documents costs). Pieces go in by descending length; of the open
sequences that a piece fits under *every* capacity, the one with the best score takes it:

* ``norm``: the smallest weighted norm of what would be left (each capacity scaled to 1), or
* ``dot``: the largest weighted dot product of the piece with what is left.

A sequence that fits nowhere opens a new one. Documents are turned into ids first, ``id 0`` ends each.
Only longer ones are cut, into pieces of the capacity; the first piece is the shorter one.

Pieces are dealt by hash over shards of some ``SHARD`` each; each is packed by itself, so a shard adds
less than one sequence over packing all at once, and no task holds more than a shard. Token ids stay in
their task: what is shuffled is a few numbers a piece.

Null and empty texts are one piece of the end token alone. Repeated rows are packed each. Extra columns
of the documents are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from logweave.llm.shared import ship, written

CAPACITY = 2048
SHARD = 1 << 14
END = 0
SPACES = re.compile(r"\s\s")
# How byte-level BPE of this family cuts a text before it merges; what the tokenizer file names "ByteLevel".
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PATTERN = PATTERN.replace(r"\s+(?!\S)|", "")
PROBE = (
    "", " ", "  two  spaces ", "It's we'll they've I'd 'Tis", "a\nb\n\n c\t\td \n", "3.14159 and 1,000,000 or 12ab34", "na\u00efve \u00fcber \u00c9t\u00e9",
    "\u4e2d\u6587\u5b57 \u0440\u0443\u0441\u0441\u043a\u0438\u0439 \U0001f600\U0001f468\u200d\U0001f469", "<|endoftext|> x", "\u00a0nbsp \u2003em\u3000wide", "x" * 300, "#*$%&|<> !!! ...",
)
PIECE = "array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"


class TextIds:
    """Token ids of a text by the tokenizer in a file.

    A file of byte-level BPE (whose numbers follow its merges) is also read into ``tiktoken``, which gives
    the same ids in a third of the time; a probe of texts is compared, and where it differs, or the file
    is of another kind, the ``tokenizers`` library does the work. A text without two white-space
    characters in a row needs no look-ahead in the pattern, which saves as much again.

    The string of a special token in a text is ordinary text with ``special_as_text``, else it becomes that
    token's id, as in a plain call of the library.
    """

    def __init__(self, path: str, special_as_text: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.encode = self._by_words = self._by_tokenizers
        ranks = self._ranks(path)
        if ranks is not None:
            import tiktoken

            whole, words = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (PATTERN, PLAIN_PATTERN))
            if all((words(t) if not SPACES.search(t) else whole(t)) == whole(t) == self._by_tokenizers(t) for t in PROBE if not self._has_special(t)):
                self.encode, self._by_words = whole, words

    def _by_tokenizers(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _ranks(path: str) -> dict[bytes, int] | None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cutter = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space"):
            return None
        # Byte-level vocabularies write bytes as printable characters: those that are stay, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        return {bytes(map(letter.__getitem__, t)): n for t, n in spec["model"]["vocab"].items() if t not in special}

    def _has_special(self, text: str) -> bool:
        return any(t in text for t in self.special)

    def __call__(self, text: str) -> list[int]:
        if self._has_special(text):
            return self._by_tokenizers(text)
        return self.encode(text) if SPACES.search(text) else self._by_words(text)


@lru_cache(maxsize=2)
def _tokenizer(path: str, special_as_text: bool) -> TextIds:
    return TextIds(path, special_as_text)


def cut(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``total`` ids; only the first may be shorter."""
    if total <= capacity:
        return [total]
    return [total % capacity or capacity] + [capacity] * ((total - 1) // capacity)


def pieces(
    docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", *, capacity: int = CAPACITY, special_as_text: bool = True
) -> DataFrame:
    """``(key, piece, start, length, ids_crc32)`` of every document."""

    def tokenized(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _tokenizer(tokenizer, special_as_text)
        for batch in batches:
            sizes, rows = [], ([], [], [], [])
            for text in batch:
                own = np.array([*encode(text.as_py() or ""), END], "<u4")
                lengths, start = cut(len(own), capacity), 0
                sizes.append(len(lengths))
                for number, n in enumerate(lengths):
                    for column, value in zip(rows, (number, start, n, zlib.crc32(own[start : start + n].tobytes()))):
                        column.append(value)
                    start += n
            values = pa.StructArray.from_arrays(
                [pa.array(rows[0], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[1:])], names=["piece", "start", "length", "ids_crc32"]
            )
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), values)

    ship(docs.sparkSession)
    found = arrow_udf(tokenized, PIECE)(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    return docs.select(F.col(f"`{key}`").alias(key), found.alias("found")).select(key, F.inline("found"))


def best_fit(lengths: np.ndarray, capacities: np.ndarray, weights: np.ndarray, score: str) -> np.ndarray:
    """The sequence of each piece; pieces come by descending length. Capacities: tokens, documents, cost."""
    room, most, bound = capacities
    out = np.empty(len(lengths), np.int64)
    tokens, documents, cost, name = np.empty(1024), np.empty(1024), np.empty(1024), np.empty(1024, np.int64)  # left in open sequences
    used = opened = 0
    smallest = lengths[-1] if len(lengths) else 0
    w = weights / capacities**2
    for i, n in enumerate(lengths.astype(float)):
        best = -1
        if n + smallest <= room:  # else no open sequence has room
            fits = np.flatnonzero((tokens[:used] >= n) & (cost[:used] >= n * n))
            if len(fits):
                t, d, c = tokens[fits], documents[fits], cost[fits]
                if score == "dot":
                    best = fits[(w[0] * n * t + w[1] * d + w[2] * n * n * c).argmax()]
                else:
                    t -= n
                    d -= 1
                    c -= n * n
                    best = fits[(w[0] * t * t + w[1] * d * d + w[2] * c * c).argmin()]
        if best < 0:
            if used == len(name):
                tokens, documents, cost, name = (np.concatenate([x, np.empty_like(x)]) for x in (tokens, documents, cost, name))
            best, tokens[used], documents[used], cost[used], name[used] = used, room, most, bound, opened
            used, opened = used + 1, opened + 1
        out[i] = name[best]
        tokens[best] -= n
        documents[best] -= 1
        cost[best] -= n * n
        if tokens[best] < smallest or documents[best] < 1:  # nothing more fits
            used -= 1
            for x in (tokens, documents, cost, name):
                x[best] = x[used]
    return out


def pack(
    rows: DataFrame, *, capacity: int = CAPACITY, max_documents: int | None = None, max_cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001), score: str = "norm",
) -> DataFrame:
    """``rows`` (with ``length``) and the sequence and offset of each.

    Without other bounds the number of documents and the cost are bounded by what the tokens allow.
    """
    if score not in ("norm", "dot"):
        raise ValueError("score is norm or dot")
    capacities = np.array([capacity, max_documents or capacity, max_cost or float(capacity) ** 2], float)
    rows = written(rows, "pieces")
    longest, total = rows.agg(F.max("length"), F.count(F.lit(1))).first()
    if total and (longest > capacity or float(longest) ** 2 > capacities[2]):
        raise ValueError(f"a piece of {longest} does not fit a sequence")
    shards = max(1, -(-total // SHARD))
    weighed = np.array(weights, float)
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id bigint, offset bigint"

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort([*(frame[c].to_numpy() for c in ("ids_crc32", "start") if c in frame), -frame["length"].to_numpy()])
        frame = frame.iloc[order]
        lengths = frame["length"].to_numpy()
        sequence = best_fit(lengths, capacities, weighed, score)
        by = np.argsort(sequence, kind="stable")
        before = np.cumsum(lengths[by]) - lengths[by]
        fresh = np.r_[True, np.diff(sequence[by]) > 0] if len(by) else np.zeros(0, bool)
        offset = np.empty(len(frame), np.int64)
        offset[by] = before - np.maximum.accumulate(np.where(fresh, before, 0))
        return frame[names].assign(sequence_id=(frame["_shard"].to_numpy() << 32) + sequence, offset=offset)

    # The files are written, so the running number of a row is the same if its task runs again.
    # Its hash is dealt, as the numbers of all partitions end in the same bits.
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(packed, schema)


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", *, special_as_text: bool = True, **options) -> DataFrame:
    """Documents tokenized, cut and packed: one row per piece."""
    found = pieces(docs, tokenizer, text, key, capacity=options.get("capacity", CAPACITY), special_as_text=special_as_text)
    return pack(found, **options)
