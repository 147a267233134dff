"""Text forms of values: whitespace stripping, number and time rendering, safe casts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Every character Unicode and the log formats treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends; scans only the ends of the text."""
    return F.btrim(col, F.lit(WHITESPACE))


def iso_text(ts: Column) -> Column:
    """ISO-8601 text: no fraction for whole seconds, six digits otherwise."""
    text = F.translate(ts.cast("string"), " ", "T")
    return F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)


def float_text(col: Column) -> Column:
    """Shortest decimal text of a double: ``1.0``, ``10000000.0``, ``1e+16``, ``1.5e-05``."""
    x = col.cast("double")
    java = x.cast("string")
    size = F.abs(x)
    # Plain notation from 1e-4 up to 1e16; the decimal is built from the shortest text.
    plain = F.regexp_replace(
        java.try_cast("decimal(38,20)").cast("string"),
        r"(\.\d+?)0+$",
        "$1",
    )
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    power = F.substring_index(java, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(power).cast("string"),
    )
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(size == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(((size >= 1e-3) & (size < 1e7)) | (size == 0), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def value_text(col: Column, kind: T.DataType) -> Column:
    """Text of a typed value; NULL stays NULL."""
    if isinstance(kind, T.StringType):
        return col
    if isinstance(kind, T.BooleanType):
        return F.when(col, F.lit("True")).when(~col, F.lit("False"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(col.isNotNull(), float_text(col))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.translate(iso_text(col), "T", " ")
    if isinstance(kind, T.VariantType):
        return variant_text(col)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col)
    return col.cast("string")


def variant_text(col: Column, booleans: bool = True) -> Column:
    """Text of a variant; a JSON null reads ``None``, an absent (NULL) variant stays NULL."""
    text = F.try_variant_get(col, "$", "string")
    if booleans:
        text = F.when(F.schema_of_variant(col) == "BOOLEAN", F.initcap(text)).otherwise(text)
    return F.when(F.is_variant_null(col), F.lit("None")).otherwise(text)


_DIGITS = "[0-9]+(?:_[0-9]+)*"
NUMBER_SHAPE = (
    rf"^\s*[+-]?(?:(?:{_DIGITS}(?:[.](?:{_DIGITS})?)?|[.]{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|(?i:inf(?:inity)?|nan))\s*$"
)


def text_to_double(text: Column) -> Column:
    """Numeric reading of a text, NULL when it is none; single underscores may group digits.

    The shape is checked first: a failing cast costs far more, and some forms that Java
    accepts (``1d``, hex) are none.
    """
    return F.when(text.rlike(NUMBER_SHAPE), F.translate(text, "_", "").try_cast("double"))


def text_to_long(text: Column) -> Column:
    """Whole-number reading of a text, NULL when it is none (``3.7`` is none)."""
    shape = r"^\s*[+-]?[0-9]+(?:_[0-9]+)*\s*$"
    return F.when(text.rlike(shape), F.translate(text, "_", "").try_cast("bigint"))
