"""Left joins against a lookup side of unknown size, safe for hot keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

# A side below both bounds is broadcast; both are measured, never assumed.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
# A key with more than 1/HOT_SHARE of the rows is hot; fewer than HOT_SHARE keys can be.
HOT_SHARE = 200
# Slices a key would get if it held all rows.
SLICES = 2000


def fits_broadcast(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Measure the lookup side with one aggregation over it."""
    if max_rows <= 0:
        return False
    width = F.octet_length(F.to_json(F.struct("*")))
    rows, size = dim.agg(F.count(F.lit(1)), F.sum(width)).first()
    return within_bounds(rows, size, max_rows)


def within_bounds(rows: int | None, size: int | None, max_rows: int = BROADCAST_ROWS) -> bool:
    return max_rows > 0 and (rows or 0) <= max_rows and (size or 0) <= BROADCAST_BYTES


def hot_keys(df: DataFrame, key: str) -> DataFrame | None:
    """Rows ``(key, _slices)`` for the keys that hold an outsized share of ``df``.

    One pass with a fixed-size sketch per task, no shuffle of the keys. The sketch may
    misjudge a borderline key; that changes the spread of the work, not the result.
    """
    total, top = (
        df.where(F.col(key).isNotNull())
        .agg(F.count(F.lit(1)), F.expr(f"approx_top_k(`{key}`, {HOT_SHARE}, {HOT_SHARE * 50})"))
        .first()
    )
    hot = [(item, -(-count * SLICES // total)) for item, count in (top or []) if count * HOT_SHARE > total]
    if not hot:
        return None
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame(hot, f"`{key}` {kind}, _slices bigint")


def left_lookup(
    df: DataFrame, dim: DataFrame, key: str, small: bool, condition: Column | None = None
) -> DataFrame:
    """``df`` LEFT JOIN ``dim`` on the column ``key`` of both (and ``condition``).

    A ``small`` lookup side, one that was measured within the bounds, is broadcast: no
    shuffle and no skew. Beyond them both sides are shuffled, the rows of a hot key cut
    into slices and its lookup rows repeated once per slice; rows without a key are cut into
    slices too, in a stream as well. ``dim`` must match a row at most once.
    """
    if small:
        return _join(df, F.broadcast(dim), [key], condition)
    hot = None if df.isStreaming else hot_keys(df, key)
    # The slice of a row follows from its partition and content, so that a task that runs
    # again sends each row to the same place.
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant", "array", "struct")]
    place = F.xxhash64(F.spark_partition_id(), *(F.col(f"`{c}`") for c in plain))
    if hot is None:
        left, right = df.withColumn("_slices", F.lit(1)), dim.withColumn("_slices", F.lit(1))
    else:
        few = F.broadcast(hot)  # fewer than HOT_SHARE rows
        left, right = df.join(few, key, "left"), dim.join(few, key, "left")
    # Rows without a key match nothing and may be any number: they are dealt over all tasks.
    slices = F.when(F.col(key).isNull(), F.lit(SLICES)).otherwise(F.coalesce(F.col("_slices"), F.lit(1)))
    left = left.withColumn("_slice", F.pmod(place, slices.cast("bigint")))
    right = right.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_slices"), F.lit(1)).cast("bigint") - 1)))
    joined = _join(left.drop("_slices"), right.drop("_slices").hint("merge"), [key, "_slice"], condition)
    return joined.drop("_slice")


def _join(left: DataFrame, right: DataFrame, keys: list[str], condition: Column | None) -> DataFrame:
    right = right.withColumnsRenamed({k: f"_dim_{k}" for k in keys})
    on = reduce(and_, [F.col(f"`{k}`") == F.col(f"`_dim_{k}`") for k in keys])
    on = on if condition is None else on & condition
    return left.join(right, on, "left").drop(*(f"_dim_{k}" for k in keys))
