"""Words of many texts at once, as positions and 64-bit hashes over one byte buffer.

Words are runs of anything but space and the control characters 9 to 13. Those six are single
bytes in UTF-8 and occur in no longer character, so words can be cut on bytes. All work is done
with whole-array operations over slices of about ``SLICE`` bytes; a longer text is a slice of
its own, so memory follows the longest text of a batch (some 60 bytes per byte of it).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What is neither an ASCII letter or digit nor part of a longer character.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: a bijection that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(U(seed) + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))


LETTER = stream(11, 256)  # a random number per byte value
BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


@dataclass
class Texts:
    """Neighbouring texts of a batch: their bytes, and where each begins."""

    data: np.ndarray
    at: np.ndarray  # len + 1 offsets into data
    blank: np.ndarray = field(default_factory=lambda: SPACE)  # the bytes between words

    def __len__(self) -> int:
        return len(self.at) - 1

    def words(self) -> "Words":
        data, n = self.data, len(self.data)
        word = ~self.blank[data]
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        before = np.ones(n, bool)
        before[1:] = ~word[:-1]
        start = np.flatnonzero(word & (before | edge[:n]))
        after = np.ones(n, bool)
        after[:-1] = ~word[1:]
        end = np.flatnonzero(word & (after | edge[1:])) + 1
        return Words(self, start, end, np.searchsorted(start, self.at))


@dataclass
class Words:
    texts: Texts
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray  # of each text the first word; len + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.texts.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of the bytes of every span, from prefix sums modulo 2**64."""
    n = len(data)
    up, down = powers(max(SLICE, n))
    total = np.zeros(n + 1, U)
    np.cumsum(LETTER[data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[np.minimum(start, max(n - 1, 0))] + (end - start).astype(U))


def slices(texts: pa.Array, lower: bool = False) -> Iterator[Texts]:
    """The texts of an Arrow array, null read as empty, in slices of bounded size, in order."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
        j = min(j, n)
        part = data[at[i] : at[j]]
        yield Texts(LOWER[part] if lower else part, at[i : j + 1] - at[i])
        i = j


def parts(texts: pa.Array, blank: np.ndarray) -> Iterator[tuple[int, Texts]]:
    """As ``slices``, in lower case; a longer text comes in several parts, cut between words.

    With each slice the number of its first text. The parts of a long text come one by one, each under
    the number of that text; only a single word longer than a slice makes a longer part.
    """
    done = 0
    for few in slices(texts, lower=True):
        n = len(few.data)
        if n <= SLICE:
            yield done, Texts(few.data, few.at, blank)
        else:  # one text
            gaps = np.flatnonzero(blank[few.data]) + 1
            start = 0
            while start < n:
                fits = int(np.searchsorted(gaps, start + SLICE, "right")) - 1
                end = int(gaps[fits]) if fits >= 0 else 0
                if end <= start:
                    end = int(gaps[fits + 1]) if fits + 1 < len(gaps) else n
                if n - start <= SLICE:
                    end = n
                yield done, Texts(few.data[start:end], np.array([0, end - start]), blank)
                start = end
        done += len(few)


def ngrams(hashes: np.ndarray, at: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``n`` neighbouring words of one text, and the index of each run's first word."""
    if len(hashes) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    weights = stream(seed, n) | U(1)
    total = hashes[: len(hashes) - n + 1] * weights[0]
    for k in range(1, n):
        total = total + hashes[k : len(hashes) - n + 1 + k] * weights[k]
    whole = np.ones(len(total), bool)  # not those that reach into the next text
    for k in range(1, n):
        inner = at[1:-1] - k
        whole[inner[(inner >= 0) & (inner < len(total))]] = False
    where = np.flatnonzero(whole)
    return mix(total[where]), where
