"""Field extraction with regular expressions and grok patterns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from logweave.functions import grok_patterns, regex
from logweave.functions.once import once
from logweave.model import WHERE_FOUND, Fields, is_open, put, remove
from logweave.operators.base import Step


def extract_regex(
    pattern: str,
    field: str = "raw_data",
    named_groups: bool = True,
    group_names: list[str] | tuple[str, ...] = (),
    target_field: str | None = None,
    preserve_original: bool = True,
    ignore_errors: bool = False,
) -> Step:
    """Add the groups of the first match as fields; a row without a match stays as it is.

    With ``named_groups=False`` groups are named by position from ``group_names``, the rest
    ``group<n>``. Under ``target_field`` all groups are kept, also those without a value.
    ``ignore_errors`` is accepted for compatibility: matching text cannot fail per row.
    """
    if not pattern:
        raise ValueError("Regular expression pattern is required")
    compiled = regex.compile_pattern(pattern)
    if named_groups:
        names = [g.name for g in compiled.groups]
    else:
        if compiled.groups and not group_names:
            raise ValueError(
                f"When named_groups is False, group_names must be provided for {len(compiled.groups)} capturing groups"
            )
        count = len(compiled.groups)
        names = [group_names[i] if i < len(group_names) else f"group{i + 1}" for i in range(count)]
    return Step(
        "regex",
        finish=lambda df: _extract(df, field, [(compiled, names)], target_field, preserve_original, True),
    )


def extract_grok(
    patterns: list[str] | tuple[str, ...],
    field: str = "raw_data",
    custom_patterns: dict[str, str] | None = None,
    target_field: str | None = None,
    preserve_original: bool = True,
    ignore_errors: bool = False,
    break_on_match: bool = True,
) -> Step:
    """Add the named parts of grok patterns as fields.

    Patterns are tried in order and the first match counts; with ``break_on_match=False``
    every match counts and later ones override. ``ignore_errors`` as in ``extract_regex``.
    """
    if not patterns:
        raise ValueError("At least one Grok pattern is required")
    compiled = []
    for text in patterns:
        try:
            one = regex.compile_pattern(grok_patterns.expand(text, custom_patterns))
        except ValueError as error:
            raise ValueError(f"Invalid Grok pattern '{text}': {error}") from error
        compiled.append((one, [g.name for g in one.groups]))
    return Step(
        "grok",
        finish=lambda df: _extract(df, field, compiled, target_field, preserve_original, break_on_match),
    )


def _extract(
    df: DataFrame,
    field: str,
    patterns: list[tuple[regex.Pattern, list[str | None]]],
    target: str | None,
    preserve: bool,
    first_only: bool,
) -> DataFrame:
    # One column of matched groups per pattern: each pattern runs once per row however many
    # fields it feeds.
    columns = [f"_match{i}" for i in range(len(patterns))]
    text = Fields(df).parser_input(field)
    df = once(df, "_text", text) if is_open(df) else df.withColumn("_text", text)
    source = F.col("_text")
    if first_only:
        for i, (pattern, _) in enumerate(patterns):
            groups = regex.match_groups(source, pattern)
            if i:
                earlier = reduce(or_, [regex.matched(F.col(c)) for c in columns[:i]])
                groups = F.when(~earlier, groups)
            df = once(df, columns[i], groups)
    else:
        for column, (pattern, _) in zip(columns, patterns):
            df = once(df, column, regex.match_groups(source, pattern))
    hits = [regex.matched(F.col(c)) for c in columns]
    found = [_named(F.col(c), p, names) for c, (p, names) in zip(columns, patterns)]
    if target:
        df = _put_struct(df, target, hits, found)
    else:
        # Later patterns first: with first_only at most one of them has values.
        values: dict[str, list[Column]] = {}
        for named in reversed(found):
            for name, value in named.items():
                values.setdefault(name, []).append(value)
        order = list(dict.fromkeys(n for named in found for n in named))
        merged = {n: values[n][0] if len(values[n]) == 1 else F.coalesce(*values[n]) for n in order}
        df = put(df, merged, WHERE_FOUND)
    if not preserve and field != "raw_data" and field != target:
        df = remove(df, [field], reduce(or_, hits))
    return df.drop(*columns, "_text")


def _named(groups: Column, pattern: regex.Pattern, names: list[str | None]) -> dict[str, Column]:
    """Value per name; among groups of one name the first that took part counts."""
    parts: dict[str, list[Column]] = {}
    for i, name in enumerate(names, start=1):
        if name:
            parts.setdefault(name, []).append(regex.group_value(groups, pattern, i))
    return {n: cols[0] if len(cols) == 1 else F.coalesce(*cols) for n, cols in parts.items()}


def _put_struct(df: DataFrame, target: str, hits: list[Column], found: list[dict[str, Column]]) -> DataFrame:
    """The last matching pattern's groups as one value under ``target``."""
    names = list(dict.fromkeys(n for named in found for n in named))
    open_layout = is_open(df)
    choice = None
    for hit, named in zip(reversed(hits), reversed(found)):
        listed = list(named) if open_layout else names
        members = [named.get(n, F.lit(None).cast("string")).alias(n) for n in listed]
        if not members and not open_layout:
            continue
        value = F.to_variant_object(F.struct(*members)) if open_layout and members else (
            F.parse_json(F.lit("{}")) if open_layout else F.struct(*members)
        )
        choice = F.when(hit, value) if choice is None else choice.when(hit, value)
    return df if choice is None else put(df, {target: choice}, reduce(or_, hits))
