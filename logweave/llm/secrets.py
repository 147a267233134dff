"""Secret scans: known forms, and strings too random to be words.

Known forms (``assign``, ``access``, ``hex``) are regular expressions. Beside them every run of
``LEAST`` or more letters, digits and ``+/_=-`` that holds a letter and a digit is a candidate of one
character class: hex digits, lower case with digits, capitals with digits, or mixed. A window of ``WINDOW``
characters (of the whole candidate, if that is shorter) slides over it; character counts change by one
coming in and one going out, and so does the sum of n*log2(n) from which the Shannon entropy of the window
follows. A candidate with a window at or above the bound of its class and window is an ``entropy`` span, unless a
pattern of the allow-list finds it or it overlaps a known form. The bounds are low quantiles of random
strings, so few keys are missed for their entropy; a random string without any digit is no candidate.
Everything is a DataFrame expression on one row; nothing is shuffled.

Spans are ``kind:start:end`` in code points, end exclusive. Null and empty texts have none. Repeated
rows are scanned each; extra columns pass through unless they bear the name of a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logweave.functions.once import once
from logweave.llm.shared import free_names

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A greedy run that is too short is no match at all, and none begins inside it: the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST = 16
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
WINDOW = 20
# Bits per character that a window of LEAST, ..., WINDOW characters must reach, by character class: what 99.5 % or more of
# random windows over 16, 36 to 38, and 62 symbols have (quantiles of 200,000 each).
LOWER_OR_UPPER = (3.07, 3.16, 3.23, 3.28, 3.34)
BOUNDS = (
    ("^[0-9a-fA-F]+$", (2.6, 2.66, 2.71, 2.78, 2.82)), ("^[a-z0-9_-]+$", LOWER_OR_UPPER), ("^[A-Z0-9_-]+$", LOWER_OR_UPPER),
    (".", (3.32, 3.38, 3.46, 3.53, 3.58)),
)
# Not secret though random: UUIDs, hashes named as such, placeholders, paths of words and short numbers, ordered alphabets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(?i)example|placeholder|changeme|xxxx|dummy",
    r"^(sha|md)[0-9]+[-=_]", r"^/?(([A-Za-z]+[0-9]{0,2}|[0-9]{1,4})[/_-]+)+([A-Za-z]*[0-9]{0,2}|[0-9]{1,4})$", r"(?i)0123456789|abcdefgh",
)


def _found(text: Column, pattern: str, kind: str, least: int = 0, needs: str = "") -> Column:
    """Spans of all matches, left to right: array of (start, kind, end).

    ``least``: length of group 2. ``needs``: a character class of which every match has one; a text
    without is not searched.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else whole
    steps = F.arrays_zip(
        F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("own"), F.transform(second, F.length).alias("value"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["own"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        hit = x["own"].isNotNull() & (x["value"] >= least)
        return F.struct(end.alias("at"), F.when(hit, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(steps, state, step)["spans"]
    there = text.rlike(needs) & text.rlike(pattern) if needs else text.rlike(pattern)
    return F.when(there, spans).otherwise(none)


def _peak(string: Column) -> Column:
    """Highest Shannon entropy of a window over ``string``, bits per character; a shorter string is one window."""
    width = F.least(F.length(string), F.lit(WINDOW))

    def weight(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n)).otherwise(0.0)

    def code(at: Column) -> Column:
        return F.ascii(F.substring(string, at, F.lit(1)))

    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def slide(acc: Column, i: Column) -> Column:
        # Out goes the character that leaves the window, then the new one comes in.
        leaves = F.when(i > WINDOW, code(i - WINDOW)).otherwise(F.lit(-1))
        enters = code(i)
        n_out = F.when(leaves >= 0, F.get(acc["counts"], leaves)).otherwise(0)
        less = acc["sum"] - weight(n_out) + F.when(n_out > 0, weight(n_out - 1)).otherwise(0.0)
        n_in = F.get(acc["counts"], enters) - F.when(enters == leaves, 1).otherwise(0)
        total = less - weight(n_in) + weight(n_in + 1)
        counts = F.transform(acc["counts"], lambda n, k: n + (k == enters).cast("int") - (k == leaves).cast("int"))
        bits = F.when(i >= width, F.log2(width) - total / width).otherwise(0.0)
        return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"))

    return F.aggregate(F.sequence(F.lit(1), F.length(string)), start, slide)["best"]


def _random(string: Column, allowed: Sequence[str]) -> Column:
    bound = F.lit(99.0)
    for pattern, bits in reversed(BOUNDS):
        own = F.get(F.array(*(F.lit(b) for b in bits)), F.least(F.length(string), F.lit(WINDOW)) - LEAST)
        bound = F.when(string.rlike(pattern), own).otherwise(bound)
    worth = string.rlike("[0-9]") & string.rlike("[A-Za-z]")
    for pattern in allowed:
        worth = worth & ~string.rlike(pattern)
    return F.when(worth, _peak(string) >= bound).otherwise(F.lit(False))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, text: str = "text", *, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``docs`` with ``base_spans`` and ``secret_spans``: arrays of (start, kind, end), in order of start and kind."""
    body, some, wild = free_names(docs, "_body", "_some", "_wild")
    rows = docs.withColumn(body, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    base = F.sort_array(F.concat(_found(F.col(body), ASSIGN, "assign", 6, "[:=]"), _found(F.col(body), ACCESS, "access"), _found(F.col(body), HEX, "hex")))
    rows = once(rows, "base_spans", base)
    rows = once(rows, wild, _found(F.col(body), CANDIDATE, "entropy", needs="[0-9]"))
    free = F.filter(wild, lambda w: ~F.exists("base_spans", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    random = F.filter(free, lambda w: _random(F.substring(F.col(body), w["start"] + 1, w["end"] - w["start"]), allowed))
    rows = once(rows, some, random)
    return rows.withColumn("secret_spans", F.sort_array(F.concat("base_spans", some))).drop(body, some, wild)


def written_spans(spans: str) -> Column:
    """A span column as ``kind:start:end`` joined by commas."""
    return _written(F.col(spans))


def redact(docs: DataFrame, text: str = "text", *, mark: str = "[SECRET]", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``mark``, and ``n_secrets``; overlapping spans become one mark."""
    base, spans = free_names(docs, "_base", "_spans")
    taken = [c for c in docs.columns if c.lower() in ("base_spans", "secret_spans")]
    keep = {c: n for c, n in zip(taken, free_names(docs, *(f"_own_{c}" for c in taken)))}
    rows = secret_spans(docs.withColumnsRenamed(keep), text, allowed=allowed).withColumnsRenamed({"base_spans": base, "secret_spans": spans})
    body = F.col(f"`{text}`").cast("string")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        part = F.substring(body, acc["at"] + 1, s["start"] - acc["at"])
        added = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(part, F.lit(mark)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), added.alias("parts"))

    clean = F.aggregate(spans, state, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(body, acc["at"] + 1, F.length(body))))
    made = {"n_secrets": F.size(spans).cast("bigint"), text: F.when(F.size(spans) > 0, clean).otherwise(body)}
    return rows.withColumns(made).drop(base, spans).withColumnsRenamed({n: c for c, n in keep.items()})
