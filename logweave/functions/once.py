"""Evaluate a costly expression exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Add ``column`` so that its expression runs once, whatever uses it later.

    A plain projection would be copied into every later filter on the column, and a chain
    of them multiplies. The value is generated as a one-element list instead: filters on
    other columns still pass through to the scan, filters on this one stay above and read
    the finished value.
    """
    made = F.explode(F.array(value)).alias(column)
    if column not in df.columns:
        return df.select("*", made)
    return df.select(*(made if c == column else F.col("`" + c.replace("`", "``") + "`") for c in df.columns))
