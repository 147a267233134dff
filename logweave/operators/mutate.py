"""Field changes: add, remove, rename, change case, convert, substitute, merge, split, strip."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logweave.functions import regex, text as tx
from logweave.functions.once import once
from logweave.model import WHERE_FOUND, Fields, literal, note, put, quoted, remove
from logweave.operators.base import Step, chain

# Accepted spellings of true, and of date-times (T..Z with or without
# fraction, then dashes or slashes with a blank).
TRUE_WORDS = ("true", "yes", "y", "1")
_CLOCK = r"[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
TIME_SHAPE = (
    rf"^(?:[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}T{_CLOCK}(?:\.[0-9]{{1,6}})?Z"
    rf"|[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}} {_CLOCK}"
    rf"|[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}} {_CLOCK})$"
)
_BLANKS = r"(?U)[\s\x1c-\x1f]*"


def add_fields(values: dict[str, Any]) -> Step:
    """Set constant fields."""

    def run(df: DataFrame) -> DataFrame:
        return put(df, {name: literal(value) for name, value in values.items()})

    return Step("add_fields", finish=run)


def remove_fields(names: list[str]) -> Step:
    return Step("remove_fields", finish=lambda df: remove(df, list(names)))


def rename_fields(names: dict[str, str]) -> Step:
    """Rename one after the other; an existing target is overwritten where the source exists."""

    def run(df: DataFrame) -> DataFrame:
        for old, new in names.items():
            fields = Fields(df)
            if not fields.open and old not in fields.types:
                continue
            if not fields.open and old != new and new not in fields.types:
                df = df.withColumnRenamed(old, new)
                continue
            if old != new:
                df = put(df, {new: fields.value(old)}, fields.present(old))
            df = remove(df, [old])
        return df

    return Step("rename_fields", finish=run)


def _map_strings(name: str, names: list[str], change) -> Step:
    """Apply ``change`` to those fields that hold a string."""

    def run(df: DataFrame) -> DataFrame:
        fields = Fields(df)
        if fields.open:
            targets = {n: change(n, fields.string(n)) for n in names}
            return put(df, targets, {n: fields.is_text(n) for n in names})
        strings = [n for n in names if isinstance(fields.kind(n), T.StringType)]
        return df.withColumns({n: change(n, quoted(n)) for n in strings})

    return Step(name, finish=run)


def uppercase_fields(names: list[str]) -> Step:
    return _map_strings("uppercase_fields", names, lambda _, c: F.upper(c))


def lowercase_fields(names: list[str]) -> Step:
    return _map_strings("lowercase_fields", names, lambda _, c: F.lower(c))


def strip_fields(names: list[str]) -> Step:
    return _map_strings("strip_fields", names, lambda _, c: tx.strip(c))


def gsub_fields(rules: dict[str, list[str]]) -> Step:
    """Replace every match: ``{field: [pattern, replacement]}`` with group references by number or name."""
    compiled = {}
    for name, rule in rules.items():
        if not isinstance(rule, (list, tuple)) or len(rule) != 2:
            raise ValueError(f"gsub_fields.{name} must be a list with [pattern, replacement]")
        try:
            pattern = regex.compile_pattern(rule[0])
            compiled[name] = (pattern.java, regex.replacement(rule[1], pattern))
        except ValueError as error:
            raise ValueError(f"Invalid regex pattern for gsub_fields.{name}: {error}") from error
    return _map_strings(
        "gsub_fields", list(compiled), lambda n, c: F.regexp_replace(c, F.lit(compiled[n][0]), F.lit(compiled[n][1]))
    )


def split_fields(rules: dict[str, list]) -> Step:
    """Cut strings into lists: ``{field: [separator, limit]}``; at most ``limit`` cuts, -1 for all."""
    compiled = {}
    for name, rule in rules.items():
        if not isinstance(rule, (list, tuple)) or len(rule) != 2:
            raise ValueError(f"split_fields.{name} must be a list with [separator, limit]")
        try:
            limit = int(rule[1])
        except (ValueError, TypeError) as error:
            raise ValueError(f"split_fields.{name}[1] must be an integer") from error
        if not rule[0]:
            raise ValueError(f"split_fields.{name}[0] must not be empty")
        compiled[name] = (re.escape(rule[0]), -1 if limit < 0 else limit + 1)
    return _map_strings("split_fields", list(compiled), lambda n, c: F.split(c, *compiled[n]))


def merge_fields(rules: dict[str, list[str]]) -> Step:
    """Join the texts of the present sources with blanks; empty ones at the start add none."""

    def run(df: DataFrame) -> DataFrame:
        for target, sources in rules.items():
            fields = Fields(df)
            texts = [fields.text(s) for s in sources]
            starts = []
            for i, head in enumerate(texts):
                tail = [F.coalesce(F.concat(F.lit(" "), t), F.lit("")) for t in texts[i + 1 :]]
                starts.append(F.when(head != "", F.concat(head, *tail)))
            if starts:
                df = put(df, {target: F.coalesce(*starts)}, WHERE_FOUND)
        return df

    return Step("merge_fields", finish=run)


def convert_fields(types: dict[str, str]) -> Step:
    """Convert to int, float, str, bool, list or timestamp.

    A value that does not convert leaves ``convert_error_<field>`` in the metadata. It stays
    as it is in the open layout; a typed column has one type only, so there it reads NULL.
    """

    def run(df: DataFrame) -> DataFrame:
        for name, target in types.items():
            fields = Fields(df)
            if not fields.open and name not in fields.types:
                continue
            value, kind = fields.value(name), fields.kind(name)
            present = fields.present(name) & ~F.is_variant_null(value) if fields.open else fields.present(name)
            message = F.concat(
                F.lit("Error converting value '"), fields.text(name), F.lit(f"' to {target}")
            )
            if target not in _CONVERTERS:
                df = note(df, f"convert_error_{name}", message, present)
                continue
            converted = _CONVERTERS[target](value, kind)
            if converted is None:  # already of that type
                continue
            df = once(df, "_converted", converted)  # feeds the field and the error
            done = F.col("_converted").isNotNull()
            if target in ("int", "float", "timestamp"):
                df = note(df, f"convert_error_{name}", message, present & ~done)
            if fields.open:
                df = put(df, {name: F.col("_converted")}, present & done)
            else:
                df = df.withColumn(name, F.col("_converted"))
            df = df.drop("_converted")
        return df

    return Step("convert_fields", finish=run)


def _by_variant_type(value: Column, text: Column, other: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", text).otherwise(other)


def _variant_string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _to_int(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        return _by_variant_type(value, tx.text_to_long(_variant_string(value)), F.try_variant_get(value, "$", "bigint"))
    if isinstance(kind, T.StringType):
        return tx.text_to_long(value)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.try_cast("bigint")
    return F.lit(None).cast("bigint")


def _to_float(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        return _by_variant_type(value, tx.text_to_double(_variant_string(value)), F.try_variant_get(value, "$", "double"))
    if isinstance(kind, T.StringType):
        return tx.text_to_double(value)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    return F.lit(None).cast("double")


def _to_str(value: Column, kind: T.DataType) -> Column:
    return tx.value_text(value, kind)


def _to_bool(value: Column, kind: T.DataType) -> Column | None:
    def words(text: Column) -> Column:
        return F.lower(text).isin(*TRUE_WORDS)

    if isinstance(kind, T.BooleanType):
        return None
    if isinstance(kind, T.VariantType):
        number = F.try_variant_get(value, "$", "double")
        other = F.coalesce(number != 0, ~_variant_string(value).isin("[]", "{}"))
        return _by_variant_type(value, words(_variant_string(value)), other)
    if isinstance(kind, T.StringType):
        return words(value)
    if isinstance(kind, T.NumericType):
        return value != 0
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.size(value) > 0
    return F.when(value.isNotNull(), F.lit(True))


def _to_list(value: Column, kind: T.DataType) -> Column | None:
    def items(text: Column) -> Column:
        return F.split(tx.strip(text), f"{_BLANKS},{_BLANKS}", -1)

    if isinstance(kind, T.ArrayType):
        return None
    if isinstance(kind, T.VariantType):
        listed = F.when(F.schema_of_variant(value).startswith("ARRAY"), value).otherwise(
            F.to_variant_object(F.array(value))
        )
        return _by_variant_type(value, F.to_variant_object(items(_variant_string(value))), listed)
    if isinstance(kind, T.StringType):
        return items(value)
    return F.when(value.isNotNull(), F.array(value))


def _to_timestamp(value: Column, kind: T.DataType) -> Column | None:
    def parsed(text: Column) -> Column:
        # Shape first, then a plain cast: no per-row formatter, no exceptions inside.
        plain = F.translate(text, "/TZ", "- ")
        return F.when(text.rlike(TIME_SHAPE), plain.try_cast("timestamp"))

    if isinstance(kind, T.VariantType):
        number = F.timestamp_seconds(F.try_variant_get(value, "$", "double"))
        numeric = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        other = F.when(numeric, number.cast("variant")).otherwise(value)
        return _by_variant_type(value, parsed(_variant_string(value)).cast("variant"), other)
    if isinstance(kind, T.StringType):
        return parsed(value)
    if isinstance(kind, (T.IntegralType, T.FractionalType)):
        return F.timestamp_seconds(value)
    return None


_CONVERTERS = {
    "int": _to_int,
    "float": _to_float,
    "str": _to_str,
    "bool": _to_bool,
    "list": _to_list,
    "timestamp": _to_timestamp,
}

# The order in which one ``mutate`` applies its parts.
ORDER = (
    ("add_fields", add_fields),
    ("remove_fields", remove_fields),
    ("rename_fields", rename_fields),
    ("uppercase_fields", uppercase_fields),
    ("lowercase_fields", lowercase_fields),
    ("convert_fields", convert_fields),
    ("gsub_fields", gsub_fields),
    ("merge_fields", merge_fields),
    ("split_fields", split_fields),
    ("strip_fields", strip_fields),
)


def mutate(**config: Any) -> Step:
    """All configured parts in their fixed order, whatever the order of the arguments."""
    unknown = set(config) - {name for name, _ in ORDER}
    if unknown:
        raise ValueError(f"Unknown mutate settings: {sorted(unknown)}")
    return chain("mutate", *(build(config[name]) for name, build in ORDER if config.get(name)))

