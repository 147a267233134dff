"""Line dedup: remove the later copies of repeated runs of lines.

The unit is the line, trimmed of white space at both ends; blank lines do not count and go with the
run that surrounds them. A line goes if it lies in a run of lines with ``min_words`` words or more that is
also found at an earlier place, by ``doc_id``, then line. Words are stretches without white space. Where words
are not parted by it, characters count: every ``CHARACTERS`` of a script written without blanks are a word, and
of another stretch of ``LONG`` characters or more every ``CHARACTERS`` are a further one.

1. A *window* is the shortest run with ``min_words`` words that ends at a line, or that begins at one.
   Winnowing: each window selects its line with the smallest hash (the last such) as fingerprint.
   Equal windows select the same one, so no repeated run of ``min_words`` words goes unnoticed.
2. Windows whose fingerprint is found at two places or more are joined on their content with the first
   place where the same window is found.
3. Matches are extended both ways by their neighbours: a repeated run goes on to the right as long as the
   window that ends at the next line matches, to the left as long as the one that begins at the line
   before does; matches that overlap or touch become one run.
4. All lines of the later run go. The first place keeps its lines, but where a later run overlaps it: text that repeats
   itself without a gap is left once, so of twenty equal lines the first one stays (the run that begins one line on is a later copy).

Before 1, lines that occur once in the table are set aside by a count of line hashes: no repeated run
holds one. Everything is a DataFrame expression; groups are counted before they are shuffled, and each
join reads two plain tables, so that Spark may split a hot line or passage over tasks.

Null texts stay null, empty ones empty. Rows with the same ``doc_id`` and the same text are one
document (each gets the same result); with another text they are documents of their own, ordered by
a hash of the text. Rows without ``doc_id`` come last in that order. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweave.llm.shared import free_names, written

BLANKS = " \t\r\x0b\x0c"
CHARACTERS = 5
LONG = 40
# Scripts written without blanks, all of three bytes a character or more: Thai to Myanmar, Khmer, kana, Han.
UNPARTED = r"\u0E00-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
STRETCH = rf"[^\x20\x09-\x0D{UNPARTED}]"
WORDS = rf"[{UNPARTED}]{{1,{CHARACTERS}}}|{STRETCH}+"
LONGER = rf"{STRETCH}{{{LONG},}}"


def _words(line: Column, min_words: int) -> Column:
    """Words of a trimmed line that is not blank, one at least; of a line with ``min_words`` or more, some number of them that is no less.

    Blanks are counted where that says as much: each parts two words, and there are enough of them or
    neither unparted scripts nor long stretches. Only other lines are searched by pattern.
    """
    long = F.length(F.array_join(F.regexp_extract_all(line, F.lit(LONGER), F.lit(0)), ""))
    searched = F.regexp_count(line, F.lit(WORDS)) + F.when(line.rlike(LONGER), F.floor(long / CHARACTERS)).otherwise(0).cast("int")
    blanks = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    single = ~line.contains("  ")
    for other in "\t\r\x0b\x0c":
        single = single & ~line.contains(other)
    narrow = F.octet_length(line) - F.length(line) < 2
    short = (F.length(line) < LONG) | ~line.rlike(rf"[^ ]{{{LONG}}}")
    return F.when(single & ((blanks + 1 >= min_words) | (narrow & short)), blanks + 1).otherwise(searched)


def _lines(docs: DataFrame, text: str, key: str, min_words: int) -> DataFrame:
    """One row per line that is not blank: document, place among such lines, line number, hashes, words."""
    body = F.col(f"`{text}`").cast("string")
    parts = F.transform(F.split(body, "\n", -1), lambda x, i: F.struct(i.alias("line_no"), F.btrim(x, F.lit(BLANKS)).alias("line")))
    rows = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("doc"), F.xxhash64(body).alias("version"),
        F.posexplode(F.filter(parts, lambda p: p["line"] != "")).alias("pos", "part"),
    )
    line = F.col("part.line")
    return rows.select(
        "doc", "version", "pos", F.col("part.line_no").alias("line_no"), F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("h2"), _words(line, min_words).alias("words")
    )


def _repeated(rows: DataFrame, key: str, *place: str) -> DataFrame:
    """Values of ``key`` that are found at two different places or more."""
    at = rows.select(key, F.xxhash64(*place).alias("at"))
    ends = at.groupBy(key).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    return ends.where("lo < hi").select(key)


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """The windows of each document, both kinds, with the fingerprint they select and keys of their content."""
    doc = ["doc", "version"]
    one = Window.partitionBy(*doc, "pos").orderBy("line_no")
    lines = lines.withColumn("copy", F.row_number().over(one)).where("copy = 1")
    by_pos = Window.partitionBy(*doc).orderBy("pos")
    lines = lines.withColumn("island", F.col("pos") - F.row_number().over(by_pos))  # neighbours share it
    held = F.collect_list(F.struct("h", "h2", "pos", "line_no"))
    kinds = []
    for order, reach in ((F.asc("pos"), "upto"), (F.desc("pos"), "downto")):
        lines = lines.withColumn(reach, F.sum("words").over(Window.partitionBy(*doc, "island").orderBy(order)))
        # Every line has a word or more, so these sums are distinct and the range holds the shortest run.
        frame = Window.partitionBy(*doc, "island").orderBy(reach).rangeBetween(-(min_words - 1), 0)
        lines = lines.withColumn(f"run_{reach}", F.when(F.col(reach) >= min_words, held.over(frame)))
        kinds.append(F.sort_array(F.transform(f"run_{reach}", lambda x: F.struct(x["pos"], x["line_no"], x["h"], x["h2"]))))
    runs = lines.select(*doc, F.explode(F.array(*kinds)).alias("run")).where("run IS NOT NULL")
    least = F.array_min(F.transform("run", lambda x: F.struct(x["h"].alias("h"), (-x["pos"]).alias("pos"))))
    first, last = F.element_at("run", 1), F.element_at("run", -1)
    return runs.select(
        *doc, first["pos"].alias("lo"), last["pos"].alias("hi"), first["line_no"].alias("first_line"), last["line_no"].alias("last_line"),
        least["h"].alias("print"), (-least["pos"]).alias("print_pos"),
        F.xxhash64(F.transform("run", lambda x: x["h"])).alias("k1"), F.xxhash64(F.transform("run", lambda x: x["h2"])).alias("k2"),
    )


def repeated_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", *, min_words: int = 8) -> DataFrame:
    """Runs to remove: ``doc``, ``version`` (hash of the text), ``runs`` as an array of first and last line number."""
    lines = written(_lines(docs, text, key, min_words), "lines")
    often = written(_repeated(lines, "h", "doc", "version", "pos"), "line-repeats")
    windows = written(_windows(lines.join(often, "h", "left_semi"), min_words), "line-windows")
    prints = written(_repeated(windows, "print", "doc", "version", "print_pos"), "line-prints")
    windows = windows.join(prints, "print", "left_semi")
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "version", "lo")
    ends = windows.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = written(ends.where(~F.col("first").eqNullSafe(F.col("last"))).select("k1", "k2", "first"), "line-firsts")
    runs = windows.join(first, ["k1", "k2"]).where(~place.eqNullSafe(F.col("first")))
    order = Window.partitionBy("doc", "version").orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", (F.col("lo") > F.coalesce(reached, F.lit(-9)) + 1).cast("int"))
    runs = runs.withColumn("group", F.sum("new").over(order))
    whole = runs.groupBy("doc", "version", "group").agg(F.min("first_line").alias("first"), F.max("last_line").alias("last"))
    return whole.groupBy("doc", "version").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def drop_repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", *, min_words: int = 8) -> DataFrame:
    """``docs`` with ``text`` less the later copies of repeated runs, and ``n_lines``, ``n_removed`` (lines)."""
    runs = written(repeated_runs(docs, text, key, min_words=min_words), "line-runs")
    doc, version, cut = free_names(docs, "_doc", "_version", "_runs")
    runs = runs.select(F.col("doc").alias(doc), F.col("version").alias(version), F.col("runs").alias(cut))
    body = F.col(f"`{text}`").cast("string")
    joined = docs.join(runs, F.col(f"`{key}`").cast("bigint").eqNullSafe(F.col(doc)) & (F.xxhash64(body) == F.col(version)), "left")
    lines = F.split(body, "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.exists(F.col(cut), lambda r: (i >= r["first"]) & (i <= r["last"])))
    removed = F.aggregate(cut, F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    made = {
        "n_lines": F.when(body.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("bigint"),
        "n_removed": F.coalesce(removed, F.lit(0)).cast("bigint"),
        text: F.when(F.col(cut).isNull(), body).otherwise(F.array_join(left, "\n")),
    }
    return joined.withColumns(made).drop(doc, version, cut)
