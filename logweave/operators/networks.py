"""Longest-prefix match of addresses against a table of ranges.

Addresses are fixed-width hex texts (``functions/ip.py``), so a network whose length is a multiple of four bits
is the common head of its addresses. Every range is cut into such heads, the fewest that fill it. An address
lies in a range exactly if one of its own heads is in the table: an equality, whatever the ranges
look like. Where ranges overlap, heads that lie inside a head of a smaller range are dropped, so
of the heads an address has in the table the longest one belongs to the smallest range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweave.files import stage
from logweave.functions import ip as ips
from logweave.operators import joins
from logweave.session import shared_dir

DIGITS = "0123456789abcdef"


def _heads(lo: str, hi: str) -> str:
    """SQL for the heads that fill the range between two hex texts of one width."""
    # c: length of the common head. The first and last head are as short as zeros and f at the ends allow.
    c = f"coalesce(filter(sequence(1, length({lo})), i -> substring({lo}, i, 1) <> substring({hi}, i, 1))[0] - 1, length({lo}))"
    a = f"greatest(length(rtrim('0', {lo})), c + 1)"
    b = f"greatest(length(rtrim('f', {hi})), c + 1)"

    def between(head: str, after: str, before: str) -> str:
        """Heads one digit longer, with digits after one and before the other."""
        inner = f"filter(sequence(1, 16), d -> d > {after} AND d < {before})"
        return f"transform({inner}, d -> concat({head}, substring('{DIGITS}', d, 1)))"

    def digit(of: str, at: str) -> str:
        return f"instr('{DIGITS}', substring({of}, {at}, 1))"

    def levels(last: str, heads: str) -> str:
        return f"flatten(transform(filter(sequence(1, length({lo})), k -> k > c + 1 AND k <= {last}), k -> {heads}))"

    up = levels("a", between(f"substring({lo}, 1, k - 1)", digit(lo, "k"), "17"))
    down = levels("b", between(f"substring({hi}, 1, k - 1)", "0", digit(hi, "k")))
    middle = between(f"substring({lo}, 1, c)", digit(lo, "c + 1"), digit(hi, "c + 1"))
    cut = f"concat(array(substring({lo}, 1, a), substring({hi}, 1, b)), {up}, {down}, {middle})"
    whole = f"c > 0 AND rtrim('0', substring({lo}, c + 1)) = '' AND rtrim('f', substring({hi}, c + 1)) = ''"
    filled = f"CASE WHEN {whole} THEN array(substring({lo}, 1, c)) ELSE {cut} END"
    # Values named c, a and b, by lambdas over arrays of one.
    filled = f"transform(array({b}), b -> {filled})[0]"
    filled = f"transform(array({a}), a -> {filled})[0]"
    return f"transform(array({c}), c -> {filled})[0]"


def _size(lo: str, hi: str) -> Column:
    """The number of addresses of a range, less one, as two halves that compare in order."""

    def half(column: str, first: int) -> str:
        return f"cast(conv(substring(lpad({column}, 32, '0'), {first}, 16), 16, 10) AS DECIMAL(21, 0))"

    low = f"({half(hi, 17)} - {half(lo, 17)})"
    borrow = f"CASE WHEN {low} < 0 THEN 1 ELSE 0 END"
    return F.expr(f"struct({half(hi, 1)} - {half(lo, 1)} - {borrow} AS high, {low} + {borrow} * cast(18446744073709551616 AS DECIMAL(21, 0)) AS low)")


def _marked(width: Column, head: Column) -> Column:
    """A head with the version of its addresses, so that the versions stay apart."""
    return F.concat(F.when(width == 8, "4").otherwise("6"), head)


def prefixes(ranges: DataFrame, value: Column) -> DataFrame:
    """``(head, version, digits, value)``: the heads of all ranges (lo, hi), as a table in the shared folder.

    Ranges without two addresses of one version, first before last, are left out.
    """
    table = ips.with_ip_hex(ranges, F.col("lo").cast("string"), "_lo")
    table = ips.with_ip_hex(table, F.col("hi").cast("string"), "_hi")
    table = table.where((F.length("_lo") == F.length("_hi")) & (F.col("_lo") <= F.col("_hi"))).select("_lo", "_hi", value.alias("value"))
    rank = F.struct(_size("_lo", "_hi").alias("size"), F.col("_lo").alias("first"), F.to_json("value").alias("text"))
    heads = table.select(F.length("_lo").alias("width"), "value", rank.alias("rank"), F.explode(F.expr(_heads("_lo", "_hi"))).alias("digits"))
    heads = heads.select(_marked(F.col("width"), F.col("digits")).alias("head"), "value", "rank")
    heads = heads.groupBy("head").agg(F.min_by("value", "rank").alias("value"), F.min("rank").alias("rank"))
    folder = shared_dir(ranges.sparkSession, "networks")
    heads = stage(heads, folder)
    # Heads above each, to see whether one of them belongs to a smaller range.
    above = F.transform(F.sequence(F.lit(2), F.length("head") - 1), lambda n: F.substring("head", F.lit(1), n))
    above = heads.where("length(head) > 2").select(F.col("head").alias("below"), F.col("rank").alias("own"), F.explode(above).alias("head"))
    hidden = above.join(heads.select("head", "rank"), "head").where("rank < own").select(F.col("below").alias("head")).distinct()
    seen = heads.join(hidden, "head", "left_anti")
    return stage(seen.select("head", F.substring("head", 1, 1).alias("version"), (F.length("head") - 1).alias("digits"), "value"), shared_dir(ranges.sparkSession, "network-heads"))


def longest_match(df: DataFrame, table: DataFrame, address: str, value: str, broadcast_rows: int = joins.BROADCAST_ROWS) -> DataFrame:
    """``df`` with ``value`` of the longest head of ``address`` (hex, or NULL) in the ``table``; every row once.

    A table that was measured to be small is joined head length by head length, each broadcast. Beyond that the
    different addresses are looked up first, all their heads in one join, and rows then join their
    address. Streams take the first way at every size.
    """
    spark = df.sparkSession
    lengths = [(r["version"], r["digits"]) for r in table.select("version", "digits").distinct().collect()]  # 40 at most
    lengths.sort(key=lambda x: (x[0], -x[1]))
    kind = table.schema["value"].dataType
    if not lengths:
        return df.withColumn(value, F.lit(None).cast(kind))
    small = joins.fits_broadcast(table, broadcast_rows)

    def head(version: str, digits: int) -> Column:
        width = 8 if version == "4" else 32
        return F.when(F.length(address) == width, F.concat(F.lit(version), F.substring(address, 1, digits)))

    if small or df.isStreaming:
        found = []
        for number, (version, digits) in enumerate(lengths):
            found.append(f"_head_{number}")
            some = table.where((F.col("version") == version) & (F.col("digits") == digits)).select(F.col("head").alias("_head"), F.col("value").alias(found[-1]))
            df = joins.left_lookup(df.withColumn("_head", head(version, digits)), some, "_head", small).drop("_head")
        return df.withColumn(value, F.coalesce(*found)).drop(*found)
    heads = F.filter(F.array(*(head(*x) for x in lengths)), lambda h: h.isNotNull())
    asked = df.where(F.col(address).isNotNull()).select(address).distinct().select(address, F.explode(heads).alias("head"))
    best = asked.join(table.select("head", "digits", "value"), "head").groupBy(address).agg(F.max_by("value", "digits").alias(value))
    return joins.left_lookup(df, stage(best, shared_dir(spark, "addresses")), address, False)
