"""Escapes and replacements against ``re``."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logweave.functions import regex

PARTS = [r"\x41", r"\u00e9", r"\U0001F600", r"\012", r"\0", r"\101", r"\.", r"\\", r"\d", r"\w", r"\t", "a", "b", "A", "1", "0", ".", "[\\x41-C]", "[\\101b]", "a+", "b?", "(a|b)", r"(?:\x41b)*", "x{2}"]
TEXTS = ["", "A", "Abc 1", "é a", "\U0001F600b", "a\nb", "A1b0", "\0", "a.b", "\\", "\t1", "xx", "aab A\n\n0", "ab ab", "CAB", "b10"]


def test_found_as_by_re(spark):
    rng = random.Random(12)
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").coalesce(1).cache()
    patterns = ["".join(rng.choices(PARTS, k=rng.randrange(1, 4))) for _ in range(120)] + [r"(a)(b)\2", r"(?P<x>a).*(?P=x)", r"\x41bc (?P<n>\d+)", r"(a)(b)(c)?\1?0"]
    found = texts.select("i", *(regex.found(F.col("t"), regex.compile_pattern(p)).alias(f"p{k}") for k, p in enumerate(patterns))).collect()
    for row in found:
        for k, p in enumerate(patterns):
            assert row[f"p{k}"] == bool(re.search(p, TEXTS[row["i"]])), (p, TEXTS[row["i"]])


@pytest.mark.parametrize("pattern, template", [
    (r"(?P<w>\w+) (?P<n>\d+)", r"<\g<n>:\g<w>>"), (r"(b)(c)", r"\2\1"), (r"(b)", r"\g<1>0$"), (r"b", r"[\g<0>]"), (r"b", r"\\x$1"), (r"b", r"\n\t"), (r"b", r"\.\-"), (r"b", r"\060\0"),
])
def test_replacement_as_by_re(spark, pattern, template):
    compiled = regex.compile_pattern(pattern)
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in rows.select(F.regexp_replace("t", F.lit(compiled.java), F.lit(regex.replacement(template, compiled)))).collect()]
    assert got == [re.sub(pattern, template, t) for t in TEXTS]


@pytest.mark.parametrize("template", [r"\g<nope>", r"\3", r"\q"])
def test_bad_replacements(template):
    with pytest.raises(ValueError):
        regex.replacement(template, regex.compile_pattern("(a)"))
