"""The log event and its two layouts.

*Open* layout: the envelope columns below with ``fields MAP<STRING, VARIANT>``; keys may
differ from row to row. *Typed* layout: every field is a column of its own and a field is
present where its column is not NULL. Operators address fields through ``Fields`` and
change them through ``put`` / ``remove`` / ``note`` and so serve both layouts.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logweave.functions import text as tx
from logweave.functions.once import once
from logweave.session import last_key_wins

ENVELOPE = ("id", "timestamp", "source_type", "source_name", "raw_data", "fields", "metadata", "tags")
OPEN_MAP = "map<string,variant>"
# Prefix of helper columns that hold the double reading of a field.
NUMBER = "_number_"

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("raw_data", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.VariantType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.VariantType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)


def quoted(name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def empty_map() -> Column:
    return F.create_map().cast(OPEN_MAP)


def is_open(df: DataFrame) -> bool:
    kind = df.schema["fields"].dataType if "fields" in df.columns else None
    return isinstance(kind, T.MapType) and isinstance(kind.valueType, T.VariantType)


def literal(value: Any) -> Column:
    """A configuration value as a column; objects and lists become variants."""
    if value is None or isinstance(value, (str, bool, int, float)):
        return F.lit(value)
    return F.parse_json(F.lit(json.dumps(value)))


def as_variant(df: DataFrame, value: Column) -> Column:
    """The value as a variant; NULL becomes a JSON null so that its key still exists."""
    kind = df.select(value.alias("v")).schema[0].dataType
    null = F.parse_json(F.lit("null"))
    if isinstance(kind, T.NullType):
        return null
    if isinstance(kind, T.VariantType):
        return F.coalesce(value, null)
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.coalesce(F.to_variant_object(value), null)
    return F.coalesce(value.cast("variant"), null)


class Fields:
    """Read access to the fields of a DataFrame in either layout."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.open = is_open(df)
        self.types = {f.name: f.dataType for f in df.schema}

    def kind(self, name: str) -> T.DataType:
        return T.VariantType() if self.open else self.types.get(name, T.NullType())

    def value(self, name: str) -> Column:
        if self.open:
            return F.try_element_at(F.col("fields"), F.lit(name))
        return quoted(name) if name in self.types else F.lit(None)

    def present(self, name: str) -> Column:
        if self.open:
            return F.map_contains_key(F.col("fields"), name)
        return quoted(name).isNotNull() if name in self.types else F.lit(False)

    def is_text(self, name: str) -> Column:
        """Whether the present value is a string; string-only operators skip the rest."""
        if self.open:
            return F.coalesce(F.schema_of_variant(self.value(name)) == "STRING", F.lit(False))
        return F.lit(isinstance(self.kind(name), T.StringType)) & self.present(name)

    def text(self, name: str) -> Column:
        """Text of the value, NULL where the field is absent."""
        kind = self.kind(name)
        if isinstance(kind, T.NullType):
            return F.lit(None).cast("string")
        return tx.value_text(self.value(name), kind)

    def string(self, name: str) -> Column:
        """The value where it is a string, else NULL."""
        if self.open:
            return F.when(self.is_text(name), F.try_variant_get(self.value(name), "$", "string"))
        return self.value(name).cast("string") if self.kind(name) == T.StringType() else F.lit(None).cast("string")

    def parser_input(self, name: str) -> Column:
        """Text a parser reads: NULL for a missing or empty value, a zero or false."""
        if name == "raw_data":
            return F.nullif(F.col("raw_data"), F.lit(""))
        kind, value = self.kind(name), self.value(name)
        if isinstance(kind, T.VariantType):
            shape, plain = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
            return (
                F.when(shape == "STRING", F.nullif(plain, F.lit("")))
                .when(shape == "BOOLEAN", F.when(plain == "true", F.lit("True")))
                .when(shape.rlike("^(?:ARRAY|OBJECT)"), F.when(~plain.isin("[]", "{}"), plain))
                .when(F.try_variant_get(value, "$", "double") != 0, plain)
            )
        text = self.source(name)
        if isinstance(kind, T.NumericType):
            return F.when(value != 0, text)
        if isinstance(kind, T.BooleanType):
            return F.when(value, text)
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.when(F.size(value) > 0, text)
        return F.nullif(text, F.lit(""))

    def source(self, name: str) -> Column:
        """Text of the event's raw line or of a field, NULL if there is none."""
        if name == "raw_data":
            return F.col("raw_data")
        if self.open:
            value = self.value(name)
            return F.when(~F.is_variant_null(value), tx.variant_text(value))
        return self.text(name)

    def number(self, name: str) -> Column:
        """Double reading of the value, NULL where absent or not numeric."""
        if NUMBER + name in self.types:
            return quoted(NUMBER + name)
        kind = self.kind(name)
        value = self.value(name)
        if isinstance(kind, T.VariantType):
            text = F.try_variant_get(value, "$", "string")
            return F.when(
                F.schema_of_variant(value) == "STRING", tx.text_to_double(text)
            ).otherwise(F.try_variant_get(value, "$", "double"))
        if isinstance(kind, T.StringType):
            return tx.text_to_double(value)
        if isinstance(kind, (T.NumericType, T.BooleanType)):
            return value.cast("double")
        return F.lit(None).cast("double")


# Condition of ``put``: set each field where its value is not NULL.
WHERE_FOUND = "where found"


def put(
    df: DataFrame, values: dict[str, Column], when: dict[str, Column] | Column | str | None = None
) -> DataFrame:
    """Set fields, for the rows that satisfy ``when``.

    ``when`` is one condition, one per field, or ``WHERE_FOUND``.
    """
    if not values:
        return df
    if isinstance(when, str):
        if not is_open(df):
            return df.withColumns({name: _choose(df, name, value, WHERE_FOUND) for name, value in values.items()})
        when = {name: value.isNotNull() for name, value in values.items()}
    conditions = when if isinstance(when, dict) else dict.fromkeys(values, when)
    if not is_open(df):
        chosen = {name: _choose(df, name, value, conditions.get(name)) for name, value in values.items()}
        for name in values:
            if conditions.get(name) is not None and name in df.columns:
                # Reads the column it replaces more than once.
                df = once(df, name, chosen.pop(name))
        return df.withColumns(chosen) if chosen else df
    additions = []
    for name, value in values.items():
        entry = F.create_map(F.lit(name), as_variant(df, value))
        condition = conditions.get(name)
        additions.append(entry if condition is None else F.when(condition, entry).otherwise(empty_map()))
    return once(df, "fields", overlay(df, F.col("fields"), *additions))


def overlay(df: DataFrame, base: Column, *maps: Column) -> Column:
    """The base map with the entries of the others set; a later map wins.

    With the session's last-key-wins setting this is one compiled expression. Without it
    the keys to come are taken out of the map before.
    """
    if last_key_wins(df.sparkSession):
        return F.map_concat(base, *maps)
    for entries in maps:
        base = F.map_concat(_without(base, entries), entries)
    return base


def _without(base: Column, entries: Column) -> Column:
    return F.map_filter(base, lambda key, _: ~F.map_contains_key(entries, key))


def _choose(df: DataFrame, name: str, value: Column, condition: Column | str | None) -> Column:
    if condition is None:
        return value
    where_found = isinstance(condition, str)
    if name not in df.columns:
        return value if where_found else F.when(condition, value)
    new = df.select(value.alias("v")).schema[0].dataType
    old = quoted(name)
    if df.schema[name].dataType != new:
        old = tx.value_text(old, df.schema[name].dataType) if isinstance(new, T.StringType) else old.try_cast(new)
    return F.coalesce(value, old) if where_found else F.when(condition, value).otherwise(old)


def remove(df: DataFrame, names: list[str], when: Column | None = None) -> DataFrame:
    """Delete fields; envelope columns are not fields and stay."""
    if is_open(df):
        doomed = (lambda k: k.isin(names)) if when is None else (lambda k: k.isin(names) & when)
        return once(df, "fields", F.map_filter("fields", lambda k, _: ~doomed(k)))
    present = [n for n in names if n in df.columns]
    if when is None:
        return df.drop(*(quoted(n) for n in present))
    return df.withColumns({n: F.when(~when, quoted(n)) for n in present})


def note(df: DataFrame, key: str, message: Column, when: Column | None = None) -> DataFrame:
    """Set a metadata entry, for the rows that satisfy ``when``."""
    if "metadata" not in df.columns:
        df = df.withColumn("metadata", empty_map())
    value_type = df.schema["metadata"].dataType.valueType
    value = as_variant(df, message) if isinstance(value_type, T.VariantType) else message.cast(value_type)
    known = F.coalesce(F.col("metadata"), F.create_map().cast(df.schema["metadata"].dataType))
    added = overlay(df, known, F.create_map(F.lit(key), value))
    return once(df, "metadata", added if when is None else F.when(when, added).otherwise(known))


def add_field(df: DataFrame, name: str, value: Any) -> DataFrame:
    """Add or overwrite one field."""
    return put(df, {name: value if isinstance(value, Column) else literal(value)})


def add_metadata(df: DataFrame, key: str, value: Any) -> DataFrame:
    """Add or overwrite one metadata entry."""
    return note(df, key, value if isinstance(value, Column) else literal(value))


def add_tag(df: DataFrame, tag: str | Column) -> DataFrame:
    """Add a tag unless the event already has it."""
    value = tag if isinstance(tag, Column) else F.lit(tag)
    none = F.array().cast("array<string>")
    known = F.coalesce(F.col("tags"), none) if "tags" in df.columns else none
    return once(df, "tags", F.when(F.array_contains(known, value), known).otherwise(F.array_append(known, value)))


def event_columns(df: DataFrame, **given: Column) -> list[Column]:
    """Envelope columns, defaults filled in for whatever is not given."""
    defaults = {
        "id": F.uuid(),
        "timestamp": F.current_timestamp(),
        "source_type": F.lit(None).cast("string"),
        "source_name": F.lit(None).cast("string"),
        "raw_data": F.lit(None).cast("string"),
        "fields": empty_map(),
        "metadata": empty_map(),
        "tags": F.array().cast("array<string>"),
    }
    return [
        (F.coalesce(given[n], defaults[n]) if n in given else defaults[n]).alias(n) for n in ENVELOPE
    ]


def to_events(df: DataFrame, *keep: str, **given: Column) -> DataFrame:
    """Open-layout events out of any rows; ``given`` maps envelope names to columns, ``keep`` names columns to go along."""
    fields = given.get("fields")
    if "fields" in given:  # built once, however many later conditions read it
        given["fields"] = F.col("_fields")
        df = once(df, "_fields", fields)
    return df.select(*event_columns(df, **given), *keep)


def fields_object(df: DataFrame) -> Column:
    """All fields of the event: the map itself, or a struct of the typed columns."""
    if is_open(df):
        return F.col("fields")
    return F.struct(*(quoted(n).alias(n) for n in df.columns if n not in ENVELOPE))


def event_document(df: DataFrame) -> Column:
    """The event as one JSON document with an ISO timestamp."""
    def own(name: str, default: Column) -> Column:
        return (F.col(name) if name in df.columns else default).alias(name)

    none = F.lit(None).cast("string")
    stamp = tx.iso_text(F.col("timestamp")) if "timestamp" in df.columns else none
    document = F.struct(
        own("id", none), stamp.alias("timestamp"), own("source_type", none), own("source_name", none),
        own("raw_data", none), fields_object(df).alias("fields"), own("metadata", empty_map()),
        own("tags", F.array().cast("array<string>")),
    )
    # A typed column that is NULL is an absent field, an open-layout null is a value.
    return F.to_json(document, {"ignoreNullFields": "false" if is_open(df) else "true"})


def from_documents(df: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """Events out of their JSON documents; a missing id or time gets its default. ``keep`` names columns to go along."""
    doc = F.from_json(
        F.col(column),
        "id string, timestamp string, source_type string, source_name string, raw_data string, "
        "fields variant, metadata variant, tags array<string>",
    )
    df = df.select(doc.alias("d"), *keep)
    return to_events(
        df,
        *keep,
        id=F.nullif(F.col("d.id"), F.lit("")),
        timestamp=F.col("d.timestamp").try_cast("timestamp"),
        source_type=F.col("d.source_type"),
        source_name=F.col("d.source_name"),
        raw_data=F.col("d.raw_data"),
        fields=F.col("d.fields").try_cast(OPEN_MAP),
        metadata=F.col("d.metadata").try_cast(OPEN_MAP),
        tags=F.col("d.tags"),
    )
