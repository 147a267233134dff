"""A K2-treap: a sparse grid of numbers as a quadtree whose cells hold the largest number below them.

The grid is halved along rows and columns together, the longer side alone until both are as long. Of a
cell only a mask of its non-empty parts is kept, and by how much each part's largest number stays below
its own; parts of a level stand in the order of their cells, so a part is found by counting mask bits.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

BITS = np.array([bin(i).count("1") for i in range(16)], np.uint8)
HEAD = struct.Struct("<IIQQ")


def _steps(row_bits: int, column_bits: int) -> list[tuple[bool, bool]]:
    """From the top: whether a step halves rows, and whether it halves columns."""
    return [(b <= row_bits, b <= column_bits) for b in range(max(row_bits, column_bits), 0, -1)]


def pack(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int, n_columns: int) -> bytes:
    """The grid with ``values`` (positive, below 2**32) at distinct places, fewer than 2**32, as bytes."""
    row_bits, column_bits = max(n_rows - 1, 0).bit_length(), max(n_columns - 1, 0).bit_length()
    steps = _steps(row_bits, column_bits)
    cells = np.zeros(len(rows), np.uint64)
    one = np.uint64(1)
    for b, step in zip(range(len(steps) - 1, -1, -1), steps):
        for halved, place in zip(step, (rows, columns)):
            if halved:
                cells = (cells << one) | ((place.astype(np.uint64) >> np.uint64(b)) & one)
    order = np.argsort(cells, kind="stable")
    cells, most = cells[order], values[order].astype(np.int64)
    levels: list[bytes] = []
    for step in reversed(steps):
        bits = sum(step)
        part = (cells & np.uint64((1 << bits) - 1)).astype(np.uint8)
        cells = cells >> np.uint64(bits)
        new = np.ones(len(cells), bool)
        new[1:] = cells[1:] != cells[:-1]
        first = np.flatnonzero(new)
        top = np.maximum.reduceat(most, first) if len(first) else most
        less = (top[np.cumsum(new) - 1] - most).astype("<u4")
        masks = np.bitwise_or.reduceat(np.uint8(1) << part, first) if len(first) else part
        levels.append(masks.tobytes() + less.view(np.uint8).reshape(-1, 4).T.tobytes())
        cells, most = cells[new], top
    body = b"".join(reversed(levels))
    head = HEAD.pack(row_bits, column_bits, int(most[0]) if len(most) else 0, len(body))
    return head + pa.compress(body, "zstd", asbytes=True)


class Treap:
    """A packed grid, ready to be descended. A node of a level is its number in that level."""

    def __init__(self, packed: bytes):
        self.row_bits, self.column_bits, self.top, size = HEAD.unpack_from(packed)
        self.steps = _steps(self.row_bits, self.column_bits)
        body = np.frombuffer(pa.decompress(packed[HEAD.size :], size, "zstd", asbytes=True), np.uint8)
        self.masks, self.first, self.most = [], [], [np.array([self.top], np.uint32)]
        at, n = 0, 1 if self.top else 0
        for _ in self.steps:
            masks = body[at : at + n]
            held = BITS[masks]
            ends = np.cumsum(held, dtype=np.int64)
            parts = int(ends[-1]) if n else 0
            less = np.ascontiguousarray(body[at + n : at + n + 4 * parts].reshape(4, parts).T).view("<u4").ravel()
            self.masks.append(masks)
            self.first.append((ends - held).astype(np.uint32))
            self.most.append(np.repeat(self.most[-1], held) - less)
            at, n = at + n + 4 * parts, parts

    def part(self, level: int, nodes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which ``nodes`` of a level have the part of that ``number``, and its node on the next."""
        masks = self.masks[level][nodes]
        there = (masks >> number.astype(np.uint8)) & 1 > 0
        before = BITS[masks[there] & ((1 << number[there]) - 1)]
        return there, self.first[level][nodes[there]].astype(np.int64) + before

    def best(self, rows: np.ndarray, weights: np.ndarray, worth: "Best", names: Sequence[int | None], stride: int = 6) -> None:
        """Offer to ``worth`` the columns with the largest sums over ``rows`` of weight times number.

        The paths of all rows go down together over ranges of columns. A range is bounded by the weighted sum
        of its cells' largest numbers; the range with the largest bound is opened next, ``stride`` halvings at
        once, until no bound reaches what ``worth`` still takes. A range of one column is its exact sum.
        """
        import heapq

        if not self.top or not len(rows):
            return
        turn, nodes = 0, np.zeros(len(rows), np.int64)
        bound = int((weights * self.top).sum())
        heap = [(-bound, turn, 0, 0, nodes, np.arange(len(rows)))]
        while heap:
            bound, _, level, column, nodes, which = heapq.heappop(heap)
            if -bound < worth.least:
                return
            if level == len(self.steps):
                worth.offer(-bound, names[column])
                continue
            columns, halvings = np.full(len(nodes), column, np.int64), 0
            while level < len(self.steps) and halvings < stride:
                by_row, by_column = self.steps[level]
                shift = len(self.steps) - 1 - level
                side = (rows[which] >> shift) & 1 if by_row else np.zeros(len(which), np.int64)
                if by_column:
                    number = np.concatenate([side * 2, side * 2 + 1] if by_row else [side, side + 1])
                    columns = np.concatenate([columns * 2, columns * 2 + 1])
                    which, nodes = np.concatenate([which, which]), np.concatenate([nodes, nodes])
                    halvings += 1
                else:
                    number = side
                there, nodes = self.part(level, nodes, number)
                columns, which, level = columns[there], which[there], level + 1
            if not len(nodes):
                continue
            order = np.argsort(columns, kind="stable")
            columns, nodes, which = columns[order], nodes[order], which[order]
            cuts = np.flatnonzero(np.concatenate([[True], columns[1:] != columns[:-1]]))
            sums = np.add.reduceat(weights[which] * self.most[level][nodes].astype(np.int64), cuts)
            ends = np.append(cuts[1:], len(columns))
            for k in np.flatnonzero(sums >= worth.least).tolist():
                a, b = cuts[k], ends[k]
                if level == len(self.steps):
                    worth.offer(int(sums[k]), names[int(columns[a])])
                else:
                    turn += 1
                    heapq.heappush(heap, (-int(sums[k]), turn, level, int(columns[a]), nodes[a:b], which[a:b]))


class Best:
    """The ``k`` best named sums above 0: larger first, then the smaller name, no name last. Equal offers count each."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.held: list[tuple[int, int, int]] = []  # (sum, 0 without a name, -name), smallest first

    def offer(self, value: int, name: int | None) -> None:
        import heapq

        entry = (value, 0, 0) if name is None else (value, 1, -name)
        if value < self.least:
            return
        if len(self.held) < self.k:
            heapq.heappush(self.held, entry)
        else:
            heapq.heappushpop(self.held, entry)
        if len(self.held) == self.k:
            self.least = max(1, self.held[0][0])

    def rows(self) -> list[tuple[int, int | None]]:
        return [(value, -name if named else None) for value, named, name in self.held]
