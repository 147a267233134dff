"""Lines dealt to files by their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from logweave.files import stage
from logweave.functions.prefix import with_running_sum
from logweave.operators.joins import fits_broadcast, left_lookup


TASK_BYTES = 64 << 20  # that a task writes at most, unless its files are larger


def dealt_by_bytes(lines: DataFrame, keys: list[str], size: int, folder: str) -> DataFrame:
    """``value`` and ``keys``, dealt to partitions so that each has whole files of ``size`` bytes, in the order of the rows.

    A line goes to the file its place in the text of its key falls into; the last file of a key has the rest. The place is a
    prefix sum of two levels: the running sum within what a task reads of a key, and the bytes of that key read before, which is
    a table of a row per input split and key. So no task sees a whole key, and a key with most of the rows is cut
    as any other. Lines are written to ``folder`` first, as both levels must see the same rows, and shuffled
    once, to their files. Lay all keys end to end: the files that begin within ``size`` bytes of that, at most one of each key, are
    a share of less than twice the size, so small keys have one together. Shares beyond those that make ``TASK_BYTES`` a
    partition, or that shuffles have partitions, are dealt in turn to the ones there are, as few as still give each file of a
    key a partition of its own: a task writes files of several keys, but one of each. Sizes count the bytes of lines with
    their ends, before compression.
    """
    rows = lines.withColumn("_row", F.monotonically_increasing_id()).sortWithinPartitions(*keys, "_row").drop("_row")
    rows = stage(rows.withColumn("_size", (F.coalesce(F.octet_length("value"), F.lit(0)) + 1).cast("bigint")), f"{folder}/lines")
    key = F.concat_ws("|", *(F.coalesce(F.col(k), F.lit("")) for k in keys))
    rows = rows.select("*", key.alias("_key"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    unit = F.concat_ws("|", "_path", F.col("_block").cast("string"), "_key").alias("_unit")

    lengths = rows.groupBy("_key", "_path", "_block").agg(F.sum("_size").alias("_length"))
    before = Window.partitionBy("_key").orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = lengths.groupBy("_key").agg(F.sum("_length").alias("_total"))
    earlier = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)  # a row per key
    first = F.floor(F.coalesce(F.sum("_total").over(earlier), F.lit(0)) / F.lit(size)).alias("_first")
    last = (F.col("_first") + F.floor((F.col("_total") - 1) / F.lit(size))).alias("_last")
    starts = lengths.withColumn("_before", F.coalesce(F.sum("_length").over(before), F.lit(0)))
    starts = starts.join(totals.select("_key", "_total", first).select("_key", "_first", last), "_key")
    starts = stage(starts.select(unit, "_before", "_first", "_last"), f"{folder}/starts")
    last, most = starts.agg(F.max("_last"), F.max(F.col("_last") - F.col("_first") + 1)).first()
    if last is None:
        return rows.select("value", *keys)
    shares = int(last) + 1
    wanted = max(-(-shares * size // TASK_BYTES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = max(int(most), min(shares, wanted))

    placed = with_running_sum(rows, ["_path", "_block", "_key"], "_size", "_offset").withColumn("_unit", unit)
    placed = left_lookup(placed, starts.drop("_last"), "_unit", fits_broadcast(starts))
    place = F.col("_before") + F.col("_offset")
    part = F.pmod(F.col("_first") + F.floor(place / F.lit(size)), F.lit(parts)).cast("int")
    dealt = placed.select("value", *keys, place.alias("_place"), part.alias("_part")).repartitionById(parts, "_part")
    return dealt.sortWithinPartitions(*keys, "_place").select("value", *keys)
