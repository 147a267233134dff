"""Sampled subword segmentations without replacement, and decoding.

A text's segmentations into pieces of a SentencePiece vocabulary are the paths of a lattice. A piece weighs
what its rank in the vocabulary suggests (Zipf: ``1 / (rank + 2.7) ** alpha``), a path the product of its
pieces, so a backward sum over the lattice gives every step its exact probability. ``samples`` different
segmentations are drawn without replacement by the Gumbel top-k trick: every path has a perturbed log
probability, and an A* search that always opens the branch with the highest possible one emits the best
paths first. A branch inherits the perturbed maximum of the paths below it: along a path the maximum stays
the same, and all that branches off at a step has a Gumbel maximum of its own, located at the log of its
total probability and cut off at the parent's. So the branches of a step are one entry of the queue, opened
only when it is the highest.

The inclusion score of a sample is the log of the probability that its perturbed value exceeds the first
value not emitted, ``log(1 - exp(-exp(log_prob - next)))``; 0 where every segmentation was emitted.

No piece of the vocabulary goes on after a space, so the lattice falls into words (with the spaces before
them). The lattice of a word is built once and remembered; steps of all words of many texts are drawn
together. Random numbers are hashes of the row key, the sample, the word and the step: the same row gives the
same samples wherever and however often it runs.

A null text has no samples, an empty one a single empty segmentation. A text with fewer than ``samples``
segmentations has all of them. Characters without a piece are spelled in bytes. Decoding gives the text
back, except that U+2581, which stands for the space, reads as one. Rows are answered one by one; extra
columns pass through unless they bear the name of the result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from logweave.llm.bytewords import U, mix
from logweave.llm.shared import ship

SPACE = "▁"
KNOWN = 60_000  # words a worker remembers; beyond that it forgets those not met again
CHARS = 1 << 18  # characters segmented at a time
BLOCK = 1 << 16  # pieces decoded at a time
NEAR = 1e-12  # what a step lacks to 1 where the others are added up themselves
GREATEST = 37.0  # a Gumbel variable of 53 random bits is further above its location once in 2**53 draws, if ever
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
RESULT = "array<struct<ids: array<int>, log_prob: double, perturbed: double, log_inclusion: double>>"


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ranges one after another, and where each range is among them."""
    cuts = np.concatenate([[0], np.cumsum(end - begin)])
    return np.repeat(begin - cuts[:-1], end - begin) + np.arange(cuts[-1]), cuts


def _values(strings: pa.Array) -> memoryview:
    """The bytes of all strings one after another."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return memoryview(strings.buffers()[2] or b"")[ends[0] : ends[-1]]


class Vocabulary:
    """Pieces and their log weights, and how ids read as bytes."""

    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.byte = [0] * 256
        self.text: list[bytes] = [b""] * model.vocab_size()
        ordinary = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
                self.text[i] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece goes on after a space: words are not independent")
                self.ids[piece] = i
                self.text[i] = piece.replace(SPACE, " ").encode()
                ordinary.append(i)
        weight = -alpha * np.log(np.arange(len(ordinary)) + 2.7)
        self.log_weight = np.full(model.vocab_size(), -np.inf)
        self.log_weight[ordinary] = weight - np.log(np.exp(weight - weight.max()).sum()) - weight.max()
        self.least = float(self.log_weight[ordinary].min())  # of a character in bytes
        # All beginnings of pieces as states; (state, next character) leads to a state, by a hash table with more empty slots than full ones.
        state = {"": 0}
        for piece in self.ids:
            for k in range(1, len(piece) + 1):
                state.setdefault(piece[:k], len(state))
        step = np.array([state[s[:-1]] << 21 | ord(s[-1]) for s in state if s], np.int64)
        leads = np.arange(1, len(state))
        self.piece = np.full(len(state), -1, np.int32)  # the piece a state is, if it is one
        for piece, i in self.ids.items():
            self.piece[state[piece]] = i
        self.goes_on = np.zeros(len(state), bool)
        self.goes_on[step >> 21] = True
        self.root = np.full(0x110000, -1, np.int32)  # the state a first character leads to
        first = step < 1 << 21
        self.root[step[first]] = leads[first]
        step, leads = step[~first], leads[~first]
        bits = (2 * len(step)).bit_length()
        self.shift = U(64 - bits)
        self.step, self.leads = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slot = self._slots(step)
        while len(slot):  # what finds its slot taken tries the next one
            free = np.flatnonzero(self.step[slot] < 0)
            self.step[slot[free]] = step[free]
            here = self.step[slot] == step
            self.leads[slot[here]] = leads[here]
            step, leads, slot = step[~here], leads[~here], (slot[~here] + 1) & (len(self.step) - 1)
        self.pieces = pa.array(self.text, pa.binary())

    def _slots(self, step: np.ndarray) -> np.ndarray:
        return (step.view(U) * U(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def follow(self, state: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states a character leads on from, and to which states."""
        place = np.flatnonzero(self.goes_on[state])
        step = state[place].astype(np.int64) << 21 | chars[place]
        slot = self._slots(step)
        to = np.full(len(state), -1, np.int32)
        while len(place):
            found = self.step[slot]
            here = np.flatnonzero(found == step)
            to[place[here]] = self.leads[slot[here]]
            on = np.flatnonzero((found != step) & (found >= 0))
            place, step, slot = place[on], step[on], (slot[on] + 1) & (len(self.step) - 1)
        known = np.flatnonzero(to >= 0)
        return known, to[known]

    def decode_all(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The texts of lists of ids that follow one another, cut at ``cuts``, ``BLOCK`` pieces at a time."""
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            parts = [self.pieces.take(pa.array(ids[at : min(at + BLOCK, b)])) for at in range(a, b, BLOCK)]
            text = b"".join(_values(part) for part in parts).decode("utf-8", "replace")
            out.append(text[1:] if text[:1] == " " else text)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0]


class Lattices:
    """Lattices of words one after another: nodes are places in words, edges the pieces that begin there."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}  # by the word without the space it begins with
        types = {"met": np.int32, "word": np.int64, "node": np.int64, "upto": np.float64, "length": np.int16, "piece": np.int32, "log": np.float64}
        self.tables = {name: np.zeros(1 if name in ("word", "node") else 0, kind) for name, kind in types.items()}  # with room to grow
        self.used = {name: len(values) for name, values in self.tables.items()}

    def settle(self) -> None:
        """Forget the words not met again, and of the others the half of ``KNOWN`` met in most batches stays; older meetings count less."""
        words, tables, met = list(self.number), self.tables, self.tables["met"][: len(self.number)]
        stay = np.flatnonzero(met)
        if len(stay) > KNOWN // 2:
            stay = np.sort(stay[np.argsort(-met[stay], kind="stable")[: KNOWN // 2]])
        places, nodes = _ranges(tables["word"][stay], tables["word"][stay + 1])
        steps, edges = _ranges(tables["node"][places], tables["node"][places + 1])
        self.number = dict(zip([words[i] for i in stay.tolist()], range(len(stay))))
        self.tables = {"met": met[stay] // 2, "word": nodes, "node": edges} | {name: tables[name][steps] for name in ("upto", "length", "piece", "log")}
        self.used = {name: len(values) for name, values in self.tables.items()}

    def _append(self, name: str, values: np.ndarray) -> None:
        table, used = self.tables[name], self.used[name]
        self.used[name] = used + len(values)
        if self.used[name] > len(table):
            self.tables[name] = np.zeros(self.used[name] * 3 // 2, table.dtype)
            self.tables[name][:used] = table[:used]
        self.tables[name][used : self.used[name]] = values

    def _pieces(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, length and id (below 0: a character in bytes) of all pieces, by place and length; ``ends``: of each place's word."""
        vocabulary = self.vocabulary
        place, state = np.arange(len(chars)), np.zeros(len(chars), np.int32)
        starts, lengths, pieces, k = [], [], [], 0
        bare = np.ones(len(chars), bool)
        while len(place):
            if k == 0:
                state = vocabulary.root[chars]
                known = state >= 0
                place, state, k = place[known], state[known], 1
            else:
                known, state = vocabulary.follow(state, chars[place + k])
                place, k = place[known], k + 1
            piece = vocabulary.piece[state]
            whole = piece >= 0
            starts.append(place[whole])
            lengths.append(np.full(len(starts[-1]), k))
            pieces.append(piece[whole])
            bare[starts[-1]] = False
            on = place + k < ends[place]
            place, state = place[on], state[on]
        starts.append(np.flatnonzero(bare))
        lengths.append(np.ones(len(starts[-1]), np.int64))
        pieces.append(-1 - chars[starts[-1]])
        start = np.concatenate(starts)
        order = np.argsort(start, kind="stable")
        return start[order], np.concatenate(lengths)[order], np.concatenate(pieces)[order]

    def add(self, words: list[str]) -> None:
        """Remember different words, given without the space they begin with."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        chars = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        end = np.repeat(ends, sizes)
        start, length, piece = self._pieces(chars, end)
        weight = np.where(piece < 0, self.vocabulary.least, self.vocabulary.log_weight[np.maximum(piece, 0)])
        # Log of the sum over all paths from a place to the end of its word: all places equally far from their ends together.
        away = end[start] - start
        order = np.argsort(away.astype(np.uint16) if sizes.max() < 1 << 16 else away, kind="stable")  # sorted by digits where 16 bits do
        cuts = np.searchsorted(away[order], np.arange(1, int(sizes.max()) + 2))
        from_, to, sums = start[order], np.where(away == length, len(chars), start + length)[order], weight[order]
        mass = np.zeros(len(chars) + 1)  # the last one stands for the end of any word
        for a, b in zip(cuts[:-1], cuts[1:]):
            value, at = sums[a:b], from_[a:b]
            value += mass[to[a:b]]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            top = np.maximum.reduceat(value, first)
            total = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(first, b - a)))), first)
            mass[at[first]] = top + np.log(total)
        log = np.empty(len(order))
        log[order] = np.minimum(sums - mass[from_], 0.0)
        # Probabilities of a place's steps added up in their order, ending at 1.
        node = np.cumsum(np.bincount(start, minlength=len(chars)))
        first = np.concatenate([[0], node[:-1]])
        upto = np.exp(log)
        here = first[first + 1 < node] + 1
        stop = node[first + 1 < node]
        while len(here):
            upto[here] += upto[here - 1]
            here, stop = here[here + 1 < stop] + 1, stop[here + 1 < stop]
        upto[node - 1] = 1.0
        sure = np.flatnonzero(log == 0.0)  # a step is 0 only where it is the only one
        log[sure[node[start[sure]] > first[start[sure]] + 1]] = -1e-300
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        places, edges = self.used["node"] - 1, self.used["upto"]
        for name, values in (("met", np.zeros(len(words), np.int32)), ("word", places + ends), ("node", edges + node), ("upto", upto), ("length", length), ("piece", piece), ("log", log)):
            self._append(name, values)

    def others(self, nodes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The log probability of all other steps of the places of these steps, which have some, added up themselves."""
        first = self.tables["node"][nodes]
        sizes = self.tables["node"][nodes + 1] - first
        begin = np.cumsum(sizes) - sizes
        each = np.repeat(first - begin, sizes) + np.arange(sizes.sum())
        logs = np.where(each == np.repeat(edges, sizes), -np.inf, self.tables["log"][each])
        top = np.maximum.reduceat(logs, begin)
        return top + np.log(np.add.reduceat(np.exp(logs - np.repeat(top, sizes)), begin))

    def _edges(self, word: str) -> list[list[tuple[int, int, float]]]:
        """For every place of a word the steps from there: length, id (below 0: a character in bytes), probability."""
        at, tables = int(self.numbers([word[1:]])[0]), self.tables
        cuts = tables["node"][tables["word"][at] : tables["word"][at + 1] + 1]
        columns = tables["length"], tables["piece"], np.exp(tables["log"])
        return [list(zip(*(c[a:b].tolist() for c in columns))) for a, b in zip(cuts[:-1], cuts[1:])]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of different words, given without the space they begin with."""
        if len(self.number) > KNOWN:
            self.settle()
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(found < 0)
        self.tables["met"][found[found >= 0]] += 1
        if len(unknown):
            found[unknown] = len(self.number) + np.arange(len(unknown))
            self.add([words[i] for i in unknown.tolist()])
        return found


def units(text: str) -> list[str]:
    """Words of a text with the spaces before them; the text counts as begun by one."""
    if not text:
        return []
    if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
        return UNIT.findall(SPACE + text.replace(" ", SPACE))
    return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")


def words_of(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Where the words of each text begin, the different words without the space they begin with, and which of them each word is."""
    plain = []
    for text in texts:
        if "  " in text or SPACE in text or text[:1] == " " or text[-1:] == " ":
            text = " ".join([u[1:] for u in units(text)])
        plain.append(text or None)
    split = pc.split_pattern(pa.array(plain, pa.string()), " ")
    words = split.flatten().dictionary_encode()
    sizes = pc.list_value_length(split).fill_null(0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return at, words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(zero_copy_only=False)


def stir(seed: np.ndarray, part) -> np.ndarray:
    """A hash of the seed and a part."""
    return mix(seed + np.asarray(part).astype(U) * U(0x9E3779B97F4A7C15) + U(0x632BE59BD9B4E019))


def between(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> U(11)).astype(np.float64) + 0.5) / (1 << 53)


def uniform(seed: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) from a hash of the seed and the parts."""
    for p in parts:
        seed = stir(seed, p)
    return between(seed)


def _gumbel(u):
    return -np.log(-np.log(u))


def _below(location, ceiling, u):
    """A Gumbel variable at ``location`` given that it is at most ``ceiling``."""
    return location - np.log(np.exp(np.minimum(location - ceiling, 700.0)) - np.log(u))


def _greatest(values: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` greatest values, greatest first, of equal ones the earlier first."""
    if count == 1:
        return np.array([np.argmax(values)])
    if len(values) > 4 * count:
        some = np.flatnonzero(values >= np.partition(values, len(values) - count)[len(values) - count])
        return some[np.argsort(-values[some], kind="stable")[:count]]
    return np.argsort(-values, kind="stable")[:count]


def _walk(lattices: Lattices, words: np.ndarray, skip: np.ndarray, seed: np.ndarray):
    """One random path through each word, from place ``skip`` on, by the word's seed: edges, nodes, and each word's share of them."""
    tables = lattices.tables
    at = tables["word"][words] + skip
    end = tables["word"][words + 1]
    lane = np.flatnonzero(at < end)
    at, end, seed, step = at[lane], end[lane], seed[lane], 0
    taken = []
    while len(lane):
        u = between(stir(seed, step))
        edge = tables["node"][at]
        beyond = np.flatnonzero(tables["upto"][edge] < u)
        above = u[beyond]
        while len(beyond):
            edge[beyond] += 1
            still = np.flatnonzero(tables["upto"][edge[beyond]] < above)
            beyond, above = beyond[still], above[still]
        taken.append((lane, edge, at))
        at = at + tables["length"][edge]
        on = np.flatnonzero(at < end)
        lane, at, end, seed, step = lane[on], at[on], end[on], seed[on], step + 1
    if not taken:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(words) + 1, np.int64)
    count = np.zeros(len(words), np.int64)
    for k, (ln, _, _) in enumerate(taken):
        count[ln] = k + 1
    first = np.concatenate([[0], np.cumsum(count)])
    edges, nodes = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    for k, (ln, e, a) in enumerate(taken):
        spot = first[ln] + k
        edges[spot] = e
        nodes[spot] = a
    return edges, nodes, first


class Path:
    """A sample of one text: its edges, and of the steps from ``fresh`` on, its own, nodes, words, and log probabilities up to and after them."""

    __slots__ = ("edges", "fresh", "nodes", "word", "first", "start", "before", "total", "log_prob", "value")

    def __init__(self, edges, fresh, nodes, word, first, start, before, total, value):
        self.edges, self.fresh, self.nodes, self.value = edges, fresh, nodes, value
        self.word, self.first = word, first  # number of the first word, and where each word's own steps begin
        self.start, self.before, self.total = start, before, total  # start: before all own steps
        self.log_prob = float(total[-1]) if len(total) else start

    def word_of(self, step: int) -> int:
        return self.word + int(np.searchsorted(self.first, self.first[0] + step - self.fresh, "right")) - 1

    def up_to(self, step: int) -> float:
        """Log probability of all steps before this own one."""
        return float(self.total[step - self.fresh - 1]) if step > self.fresh else self.start


def sample_batch(lattices: Lattices, texts: list[str], seeds: np.ndarray, samples: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples: edges as ids to be spelled, log probability, perturbed value, log inclusion."""
    at, different, which = words_of(texts)
    flat = lattices.numbers(different)[which]
    tables = lattices.tables
    # Entries of the queues: (-highest value, turn, step, path, edges taken there).
    queues: list[list] = [[] for _ in texts]
    emitted: list[list[Path]] = [[] for _ in texts]
    # Texts to draw a path for, its perturbed value, and the word and place in it where it goes on.
    todo, values = np.arange(len(texts)), _gumbel(uniform(seeds, 1 << 20, 0))
    from_word = into = np.zeros(len(texts), np.int64)
    branches: list[tuple | None] = [None] * len(texts)  # path left, step there, edge taken instead
    for turn in range(samples):
        if not len(todo):
            break
        begin = at[todo] + from_word
        own, cuts = _ranges(begin, at[todo + 1])
        sizes = np.diff(cuts)
        skip = np.zeros(len(own), np.int64)
        skip[cuts[:-1][sizes > 0]] = into[sizes > 0]
        edges, nodes, first = _walk(lattices, flat[own], skip, stir(np.repeat(stir(seeds[todo], turn), sizes), own - np.repeat(at[todo], sizes)))
        bounds = first[cuts]
        counts = np.diff(bounds)
        logs = tables["log"][edges]
        starts = np.array([0.0 if b is None else b[0].up_to(b[1]) + float(tables["log"][b[2]]) for b in branches])
        fresh = np.array([0 if b is None else b[1] + 1 for b in branches], np.int64)
        total = logs.copy()
        total[bounds[:-1][counts > 0]] += starts[counts > 0]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            np.cumsum(total[a:b], out=total[a:b])
        before = total - logs
        # What branches off at each new step; only as many can ever be opened as samples are left, and one more to compare with.
        left, hashes = samples - turn, stir(seeds[todo], (1 << 21) + turn)
        some = np.flatnonzero(logs < -NEAR)
        limits = np.searchsorted(some, bounds)
        text = np.repeat(np.arange(len(todo)), np.diff(limits))
        highest_of = _below(before[some] + np.log(-np.expm1(logs[some])), values[text], between(stir(hashes[text], some + (fresh - bounds[:-1])[text])))
        close = np.flatnonzero((logs >= -NEAR) & (logs < 0))
        closest = np.searchsorted(close, bounds).tolist()
        limits, bounds, fresh = limits.tolist(), bounds.tolist(), fresh.tolist()
        for k, d in enumerate(todo.tolist()):
            branch, a, b = branches[k], bounds[k], bounds[k + 1]
            value, part = float(values[k]), slice(a, b)
            e = edges[part] if branch is None else np.concatenate([branch[0].edges[: branch[1]], [branch[2]], edges[part]])
            path = Path(e, fresh[k], nodes[part], int(from_word[k]), first[cuts[k] : cuts[k + 1] + 1], float(starts[k]), before[part], total[part], value)
            emitted[d].append(path)
            highest, steps = highest_of[limits[k] : limits[k + 1]], some[limits[k] : limits[k + 1]]
            if closest[k] < closest[k + 1]:
                # Next to a step that is all but certain, where rounding would lose what it lacks to 1, unless not even the greatest Gumbel value makes it one of them.
                near = close[closest[k] : closest[k + 1]]
                least = np.partition(highest, len(highest) - left)[len(highest) - left] if len(highest) >= left else -np.inf
                near = near[before[near] > least - math.log(NEAR) - GREATEST]
                if len(near):
                    location = before[near] + lattices.others(nodes[near], edges[near])
                    highest = np.append(highest, _below(location, value, between(stir(hashes[k : k + 1], near + (fresh[k] - a)))))
                    steps = np.append(steps, near)
            if len(steps):
                for i in _greatest(highest, left).tolist():
                    at_ = int(steps[i])
                    heapq.heappush(queues[d], (-float(highest[i]), turn, fresh[k] + at_ - a, path, (int(edges[at_]),)))
        if turn + 1 == samples:
            break
        opened = [(d, *heapq.heappop(queues[d])) for d in todo.tolist() if queues[d]]
        todo, values = np.array([o[0] for o in opened], np.int64), -np.array([o[1] for o in opened])
        steps = np.array([o[3] for o in opened], np.int64)
        chance = uniform(seeds[todo], (1 << 22) + turn, steps).tolist()
        branches, from_word, into, others = [], [], [], []
        for u, (d, _, _, t, path, closed) in zip(chance, opened):
            node = int(path.nodes[t - path.fresh])
            open_ = [x for x in range(int(tables["node"][node]), int(tables["node"][node + 1])) if x not in closed]
            logs = tables["log"][open_]
            shares = np.exp(logs - logs.max())
            pick = min(int(np.searchsorted(np.cumsum(shares) / shares.sum(), u)), len(open_) - 1)
            chosen = open_[pick]
            if len(open_) > 1:
                rest = np.delete(logs, pick)
                rest = rest.max() + math.log(np.exp(rest - rest.max()).sum())
                others.append((len(branches), path.before[t - path.fresh] + rest, (turn, t, path, (*closed, chosen))))
            word = path.word_of(t)
            from_word.append(word)
            into.append(node + int(tables["length"][chosen]) - int(tables["word"][flat[at[d] + word]]))
            branches.append((path, t, chosen))
        from_word, into = np.array(from_word, np.int64), np.array(into, np.int64)
        rows = np.array([o[0] for o in others], np.int64)
        again = _below(np.array([o[1] for o in others]), values[rows], uniform(seeds[todo[rows]], (1 << 23) + turn, steps[rows]))
        for row, value, (_, _, entry) in zip(rows.tolist(), again.tolist(), others):
            heapq.heappush(queues[todo[row]], (-value, *entry))
    out = []
    for d, paths in enumerate(emitted):
        following = -queues[d][0][0] if queues[d] else -math.inf
        rows = []
        for p in paths:
            gap = p.log_prob - following
            score = 0.0 if following == -math.inf else (gap if gap < -30 else math.log(-math.expm1(-math.exp(min(gap, 700.0)))) if gap < 30 else 0.0)
            rows.append((tables["piece"][p.edges], p.log_prob, p.value, score))
        out.append(rows)
    return out


def _spelled(pieces: np.ndarray, cuts: np.ndarray, byte: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids with characters that have no piece in bytes, and where the cuts are among them."""
    odd = np.flatnonzero(pieces < 0)
    if not len(odd):
        return pieces, cuts
    bytes_ = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in pieces[odd].tolist()]
    sizes = np.ones(len(pieces), np.int64)
    sizes[odd] = list(map(len, bytes_))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.repeat(pieces, sizes)
    out[_ranges(ends[odd], ends[odd + 1])[0]] = np.array(byte, pieces.dtype)[np.frombuffer(b"".join(bytes_), np.uint8)]
    return out, ends[cuts]


@lru_cache(maxsize=2)
def _vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


@lru_cache(maxsize=2)
def _lattices(path: str, alpha: float) -> Lattices:
    return Lattices(_vocabulary(path, alpha))


def _rows(found: list[list[tuple]], byte: list[int]) -> pa.Array:
    """The samples of each text as a value of type ``RESULT``."""
    flat = [sample for samples in found for sample in samples]
    cuts = np.concatenate([[0], np.cumsum([len(sample[0]) for sample in flat], dtype=np.int64)])
    ids, cuts = _spelled(np.concatenate([sample[0] for sample in flat]) if flat else np.zeros(0, np.int32), cuts, byte)
    lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids, pa.int32()))
    numbers = [pa.array([sample[k] for sample in flat], pa.float64()) for k in (1, 2, 3)]
    rows = pa.StructArray.from_arrays([lists, *numbers], names=["ids", "log_prob", "perturbed", "log_inclusion"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)), rows)


def encode_samples(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", *, samples: int = 2, alpha: float = 1.0, seed: int = 0, into: str = "samples") -> DataFrame:
    """``docs`` with ``into``: up to ``samples`` different segmentations, the highest perturbed value first."""

    def drawn(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        lattices = _lattices(model, alpha)
        byte = lattices.vocabulary.byte
        for values, keys in batches:
            numbers = mix(np.asarray(keys.to_numpy(zero_copy_only=False)).astype(np.int64).astype(U) ^ mix(np.array([seed], U)))
            texts: list[str] = []
            begin = held = 0
            for row in range(len(values)):
                texts.append(values[row].as_py() or "")
                held += len(texts[-1])
                if held > CHARS or row + 1 == len(values):  # what is drawn goes on at once
                    found = sample_batch(lattices, texts, numbers[begin : row + 1], samples)
                    yield _rows([[] if not values[begin + i].is_valid else x for i, x in enumerate(found)], byte)
                    begin, texts, held = row + 1, [], 0

    ship(docs.sparkSession)
    row_key = F.coalesce(F.xxhash64(F.col(f"`{key}`")), F.lit(0).cast("bigint"))
    return docs.withColumn(into, arrow_udf(drawn, RESULT)(F.col(f"`{text}`").cast("string"), row_key))


def decode(frame: DataFrame, ids: str, model: str, into: str = "decoded") -> DataFrame:
    """``frame`` with the text that a column of ids reads as."""

    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _vocabulary(model, 1.0)
        for batch in batches:
            # Nulls have no ids here, whatever lies below them.
            sizes = pc.list_value_length(batch).fill_null(0).to_numpy(zero_copy_only=False)
            flat = batch.flatten().to_numpy(zero_copy_only=False)
            texts = vocabulary.decode_all(flat, np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.array([x if there else None for x, there in zip(texts, batch.is_valid().to_pylist())], pa.string())

    ship(frame.sparkSession)
    return frame.withColumn(into, arrow_udf(decoded, "string")(F.col(f"`{ids}`")))
