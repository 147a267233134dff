"""Strict JSON reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweave.functions.once import once


def with_parsed(df: DataFrame, text: Column, column: str) -> DataFrame:
    """Add ``column``: the parsed text, NULL unless the *whole* text is one JSON value.

    The parser itself stops after the first value and would accept trailing text. So the
    text is parsed as first item of a list whose second item is the text's own hash: any
    leftover shifts or swallows the hash. The column holds that list; ``member`` and
    ``value`` read from it without copying the document.
    """
    listed = "_listed_json"
    guard = F.xxhash64(text)
    items = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), guard.cast("string"), F.lit("]")))
    whole = F.try_variant_get(F.col(listed), "$[1]", "bigint") == guard
    return once(df, listed, items).withColumn(column, F.when(whole, F.col(listed))).drop(listed)


def member(column: str, name: str, kind: str) -> Column:
    """A member by dotted name, NULL if it is missing or does not fit the type."""
    path = "".join(f"['{part}']" for part in name.split("."))
    return F.try_variant_get(F.col(column), f"$[0]{path}", kind)


def value(column: str, kind: str = "variant") -> Column:
    """The whole parsed value."""
    return F.try_variant_get(F.col(column), "$[0]", kind)
