"""JSON text parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logweave.functions import jsontext
from logweave.functions.once import once
from logweave.model import OPEN_MAP, WHERE_FOUND, Fields, is_open, note, overlay, put, remove
from logweave.operators.base import Step, Verdict

_PARSED = "_parsed_json"
_INPUT = "_json_text"


def parse_json(
    field: str = "raw_data",
    target_field: str | None = "parsed",
    preserve_original: bool = True,
    ignore_errors: bool = False,
    schema: str | T.StructType | None = None,
) -> Step:
    """Parse a JSON text into ``target_field``, or into the event itself if that is empty.

    ``schema`` types the members one by one; a member that does not fit reads NULL and the
    row stays. Without it the value is a variant. Merging into a typed layout needs it.
    Empty or missing input passes unchanged. Invalid JSON drops the row, or with
    ``ignore_errors`` leaves ``json_error`` in the metadata.
    """
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def prepare(df: DataFrame) -> DataFrame:
        df = df.withColumn(_INPUT, Fields(df).parser_input(field))
        return jsontext.with_parsed(df, F.col(_INPUT), _PARSED)

    def invalid() -> Column:
        return F.col(_INPUT).isNotNull() & F.col(_PARSED).isNull()

    def judge(df: DataFrame) -> Verdict:
        return Verdict(F.col(_PARSED).isNotNull() | F.col(_INPUT).isNull(), message="invalid JSON")

    def finish(df: DataFrame) -> DataFrame:
        if ignore_errors:
            df = note(df, "json_error", F.lit("invalid JSON"), invalid())
        if target_field:
            value = F.struct(*(_member(f).alias(f.name) for f in struct.fields)) if struct else jsontext.value(_PARSED)
            df = put(df, {target_field: value}, F.col(_PARSED).isNotNull())
        elif is_open(df):
            df = _merge_object(df)
        elif struct is None:
            raise ValueError("merging JSON into typed columns needs a schema")
        else:
            df = put(df, {f.name: _member(f) for f in struct.fields}, WHERE_FOUND)
        df = df.drop(_PARSED, _INPUT)
        if not preserve_original and field != "raw_data":
            df = df if field == target_field else remove(df, [field])
        return df

    return Step("json", prepare, None if ignore_errors else judge, finish)


def _member(f: T.StructField) -> Column:
    # The name is one member, dots included. A path can hold one kind of quotes; a name with both is looked up in the object.
    mark = "'" if "'" not in f.name else '"'
    if mark not in f.name and "\\" not in f.name:
        return F.try_variant_get(F.col(_PARSED), f"$[0][{mark}{f.name}{mark}]", f.dataType.simpleString())
    return F.try_variant_get(F.try_element_at(jsontext.value(_PARSED, OPEN_MAP), F.lit(f.name)), "$", f.dataType.simpleString())


def _merge_object(df: DataFrame) -> DataFrame:
    """New keys win; a JSON value that is no object adds nothing."""
    members = "_json_members"
    df = once(df, members, F.coalesce(jsontext.value(_PARSED, OPEN_MAP), F.create_map().cast(OPEN_MAP)))
    return once(df, "fields", overlay(df, F.col("fields"), F.col(members))).drop(members)
