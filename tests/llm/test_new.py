"""Token alignment, lexical search and the n-gram join against plain forms on small tables."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from logweave.llm.alignment import align
from logweave.llm.bytewords import SLICE
from logweave.llm.langid import CHARS, identify
from logweave.llm.lexical import index, search
from logweave.llm.neardup import sets_of
from logweave.llm.ngramjoin import prefixes, similar_classes
from logweave.llm.treap import Best, Treap, pack

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def aligned(texts):
    """The contract read plainly: tokens as byte ranges, groups, links, counts over all texts."""
    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    names = {i: t for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = dict(zip(map(chr, plain), plain))
    for i, x in enumerate(sorted(set(range(256)) - set(plain))):
        letter[chr(256 + i)] = x

    def b_bytes(i):
        piece = sp.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    rows, count = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        a = [(i, bytes(letter[c] for c in names[i])) for i in a_tok.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, b_bytes(i)) for i in sp.encode(text)] if text else []
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            rows.append(None)
            continue
        ends = []
        for side in (a, b):
            at, place = 0, []
            for i, x in side:
                at += len(x)
                place.append((at, i))
            ends.append(place)
        links = [(i, j) for x, i in ends[0] for j in [dict(ends[1]).get(x)] if j is not None]
        cuts = sorted({x for x, _ in ends[0]} & {x for x, _ in ends[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for x, i in side if low < x <= cut) for side in ends))
            low = cut
        count.update(links)
        rows.append((len(a), len(b), groups, links))
    best = Counter()
    for (i, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = row
            out.append((n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def alignment(df):
    got = align(df, A, B).collect()
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, *tuple(r)[1:]) for r in got)


def test_alignment_of_table(documents, texts):
    some = sorted(texts.items())
    want = [(False, i, *row) for (i, _), row in zip(some, aligned([t for _, t in some]))]
    assert alignment(documents) == want


@pytest.mark.parametrize("hot", [1, 4096])
def test_alignment_odd_rows(frame, hot, monkeypatch):
    monkeypatch.setattr("logweave.llm.alignment.HOT", hot)  # all pairs by the join but the most frequent, or by the table
    rows = ["", None, " ", "a", "▁x", "two  spaces", "tab\tand\nline\n", "naïve café 中文 \U0001f600", "<|endoftext|> and </s>", "ﬁ ligature", "x" * 3000, "unlikelihoods " * 50, "A\x00B"]
    pairs = [(i, t) for i, t in enumerate(rows * 2)] + [(None, "no id"), (3, "same id")]
    df = frame(pairs).withColumnsRenamed({"source": "n_a", "n_chars": "row"})
    want = sorted((i is None, i or 0, *row) for (i, _), row in zip(pairs, aligned([t for _, t in pairs])))
    assert alignment(df) == want
    assert alignment(df.limit(0)) == []


def scores(docs, items):
    def terms(text):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))

    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, bag in bags:
            n = sum(bag.values())
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * (50 + 50 * n * n_docs // total)))
                for t in set(terms(text)) if bag[t]
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:50], 1)]
    return sorted(out, key=str)


def ranked(docs, items):
    return sorted((tuple(r) for r in search(index(docs), items).collect()), key=str)


def test_search_of_table(spark, documents, texts):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert ranked(documents, items) == scores(sorted(texts.items()), [tuple(r) for r in items.select("item_id", "text").collect()])


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_search_odd_rows(spark, frame, block, monkeypatch):
    rng = random.Random(block)
    texts = [" ".join(rng.choices(["a", "B", "b", "c9", "été", "d-d", "中"], k=rng.randint(0, 9))) for _ in range(150)]
    docs = [*enumerate(texts), (7, "a a a"), (7, "a a a"), (None, "b b"), (200, None), (201, "!!! ..."), (202, "İ É")]
    items = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (4, "zzz"), (5, "C9; Été été 中"), (None, "d"), (6, "?!")]
    monkeypatch.setattr("logweave.llm.lexical.BLOCK_DOCUMENTS", block)
    monkeypatch.setattr("logweave.llm.lexical.CHUNK_TERMS", 3 if block == 7 else 200_000)
    asked = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS rank", "2 AS score", "3 AS doc_id")
    got = ranked(frame(docs).withColumnsRenamed({"source": "terms", "lang": "item_id"}), asked)
    assert got == scores(docs, items)
    assert ranked(frame(docs).limit(0), asked) == [] == ranked(frame(docs), asked.limit(0))
    assert ranked(frame([(1, None), (2, "...")]), asked) == []


def test_search_of_very_long_texts(spark, frame):
    """Texts beyond a slice are read part by part; one word may be longer than a slice."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    long = " ".join(rng.choices(words, k=SLICE // 2))
    docs = [(1, long), (2, "w1 w2 w3"), (3, "x" * (2 * SLICE) + " w7 w8"), (4, "w9"), (5, long + " w1 last")]
    items = [(1, "w1 w2 w7 last"), (2, "x" * (2 * SLICE))]
    assert ranked(frame(docs).coalesce(1), spark.createDataFrame(items, "item_id bigint, text string")) == scores(docs, items)


@pytest.mark.parametrize("rows,columns", [(1, 1), (1, 70), (90, 1), (5, 300), (300, 5), (64, 64)])
def test_treap_against_all_columns(rows, columns):
    rng = np.random.default_rng(rows)
    grid = rng.integers(1, 1000, (rows, columns)) * (rng.random((rows, columns)) < 0.4)
    r, c = np.nonzero(grid)
    treap = Treap(pack(r, c, grid[r, c], rows, columns))
    asked, weights = np.arange(0, rows, 2), rng.integers(1, 5, len(range(0, rows, 2)))
    sums = (grid[asked] * weights[:, None]).sum(0)
    for k, stride in ((1, 1), (10, 2), (columns, 6), (3, 20)):
        worth = Best(k)
        treap.best(asked, weights, worth, list(range(columns)), stride)
        want = sorted(((int(s), i) for i, s in enumerate(sums) if s > 0), key=lambda x: (-x[0], x[1]))[:k]
        assert sorted(worth.rows(), key=lambda x: (-x[0], x[1])) == want


def test_bounds_keep_cells_closed(monkeypatch):
    """Ranges whose bound stays below what is found are not opened."""
    rng = np.random.default_rng(1)
    r, c = np.nonzero(rng.random((200, 4096)) < 0.02)
    values = (rng.pareto(1.5, len(r)) * 100 + 1).astype(np.int64)
    treap, opened = Treap(pack(r, c, values, 200, 4096)), []
    part = Treap.part
    monkeypatch.setattr(Treap, "part", lambda self, level, nodes, number: (opened.append(len(nodes)), part(self, level, nodes, number))[1])
    cost = []
    for k in (3, 4096):
        opened.clear()
        treap.best(np.arange(5), np.ones(5, np.int64), Best(k), list(range(4096)), 2)
        cost.append(sum(opened))
    assert cost[0] < 0.8 * cost[1]


def ngram_classes(rows, size, percent):
    """Components by comparing all pairs of rows; rows of one id are one document."""
    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())

    sets = [(i, grams(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and None not in (i, j) and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in sets), key=str)


def joined(df, **options):
    return sorted((tuple(r) for r in similar_classes(df, **options).collect()), key=str)


def test_ngram_join_of_table(documents, texts):
    assert joined(documents) == ngram_classes(sorted(texts.items()), 4, 85)


@pytest.mark.parametrize("percent,size", [(85, 4), (70, 3), (100, 4)])
def test_ngram_join_around_the_threshold(frame, percent, size):
    """Copies with few words changed, cut short, or run on; passages shared by many; words of few kinds."""
    rng = random.Random(percent)
    base = [f"w{rng.randint(0, 400)}" for _ in range(130)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 99)}"
        rows.append((i, " ".join(words[: rng.randint(100, 130)])))
    rows += [(200 + i, passage + " " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 90)))) for i in range(60)]
    rows += [(300 + i, " ".join(rng.choices("ab", k=rng.randint(1, 12)))) for i in range(60)]
    assert joined(frame(rows), percent=percent, size=size) == ngram_classes(rows, size, percent)


def test_ngram_join_odd_rows(spark, frame):
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one"), (6, "three four"), (7, "three  four"), (None, "one"), (None, None), (8, "one"), (8, "one"), (9, long), (10, long + " end"), (11, "É a b c d"), (12, "é a b c d")]
    df = frame(rows).withColumnsRenamed({"source": "n_shingles", "lang": "Node"})
    assert joined(df) == ngram_classes(rows, 4, 85)
    assert joined(df.limit(0)) == []


def test_ngram_join_links_through_one_id(frame):
    """Rows of one id are one document: it links if any of its texts does."""
    rows = [(5, "a b c d e"), (5, "f g h i j"), (3, "a b c d e"), (9, "f g h i j"), (7, "k")]
    assert joined(frame(rows)) == ngram_classes(rows, 4, 85)


def test_every_order_filters(spark, frame):
    """A pair that meets under the first order only is no candidate; one that links meets under all."""
    rng = random.Random(3)
    base = [f"w{k}" for k in rng.choices(range(14), k=40)]
    rows = [(i, " ".join(w if rng.random() < 0.95 else f"w{rng.randrange(14)}" for w in base[rng.randrange(8):])) for i in range(40)]
    rows += [(40 + i, " ".join(f"w{k}" for k in rng.choices(range(14), k=40))) for i in range(40)]
    docs = frame(rows).select("doc_id", "text")
    sets = sets_of(docs, docs.selectExpr("doc_id AS node"), 2)
    heads = {r["node"]: r for r in prefixes(sets, 80).collect()}
    items = {r["node"]: set(r["items"]) for r in sets.collect()}
    met = {order: {(a, b) for a in heads for b in heads if a < b and set(heads[a][order]) & set(heads[b][order])} for order in ("by_rarity", "by_class", "by_chance")}
    alike = {(a, b) for a in items for b in items if a < b and 5 * len(items[a] & items[b]) >= 4 * len(items[a] | items[b])}
    every = set.intersection(*met.values())
    assert alike <= every and len(every) < min(map(len, met.values()))


def test_languages_of_very_long_texts(frame):
    """Texts beyond what is parsed at a time, first, in the middle and last of a batch."""
    rng = random.Random(1)
    kinds = {"aa": ["alpha", "beta", "gamma", "delta"], "bb": ["uno", "dos", "tres", "cuatro"]}
    samples = tuple((lang, " ".join(rng.choices(words, k=300))) for lang, words in kinds.items())
    long = {lang: " ".join(rng.choices(words, k=2 * CHARS // 5)) for lang, words in kinds.items()}
    rows = [(0, long["aa"]), (1, "uno dos"), (2, long["bb"]), (3, None), (4, "beta"), (5, long["aa"])]
    got = {r["doc_id"]: r["lang_pred"] for r in identify(frame(rows).coalesce(1), samples).collect()}
    assert got == {0: "aa", 1: "bb", 2: "bb", 3: "und", 4: "aa", 5: "aa"}
    only = frame([(0, long["bb"])]).coalesce(1)
    assert [r["lang_pred"] for r in identify(only, samples).collect()] == ["bb"]
