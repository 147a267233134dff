"""Row filters written as one-line conditions.

A missing field makes every comparison false, the negative ones included; ``negate`` then
turns it true. Conditions are therefore built as ``present AND comparison``, which is
two-valued and still translates to scan filters.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logweave.functions import regex
from logweave.functions.once import once
from logweave.functions.text import variant_text
from logweave.model import NUMBER, Fields
from logweave.operators.base import Step, Verdict

_COMPARISON = re.compile(r"(\w+)\s*(==|!=|>=|<=|>|<|=~|!~|not in|in)\s*(.*)")
_INTEGER = re.compile(r"0|-?[1-9][0-9]*")
_LONG = range(-(2**63), 2**63)


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object = None

    def holds(self, fields: Fields) -> Column:
        """Two-valued result of the condition."""
        present = fields.present(self.field)
        if self.op == "exists":
            return present
        if self.op == "missing":
            return ~present
        if isinstance(fields.kind(self.field), T.NullType):
            return F.lit(False)
        if self.op in _NUMERIC:
            return present & F.coalesce(self._number_test(fields), F.lit(False)) if fields.open else (
                present & self._number_test(fields)
            )
        if self.op in ("=~", "!~"):
            hit = regex.found(fields.text(self.field), self.value)
            return present & (hit if self.op == "=~" else ~hit)
        values = list(self.value) if self.op in ("in", "not in") else [self.value]
        hit = self._equals_any(fields, values)
        return present & (hit if self.op in ("==", "in") else ~hit)

    def fails(self, fields: Fields) -> Column | None:
        """Rows on which the condition cannot be evaluated; they are dropped as errors."""
        if self.op not in _NUMERIC or isinstance(fields.kind(self.field), T.NullType):
            return None
        present = fields.present(self.field)
        if self.value is None:
            return present
        if isinstance(fields.kind(self.field), (T.NumericType, T.BooleanType)):
            return None
        return present & fields.number(self.field).isNull()

    def _equals_any(self, fields: Fields, values: list[str]) -> Column:
        kind, col = fields.kind(self.field), fields.value(self.field)
        if isinstance(kind, T.IntegralType):  # compare natively: the scan can use it
            numbers = [int(v) for v in values if _INTEGER.fullmatch(v) and int(v) in _LONG]
            return col.isin(numbers) if numbers else F.lit(False)
        if isinstance(kind, T.BooleanType):
            flags = [v == "True" for v in values if v in ("True", "False")]
            return col.isin(flags) if flags else F.lit(False)
        text = fields.text(self.field)
        if fields.open and not any(v in ("True", "False", "true", "false") for v in values):
            text = variant_text(col, booleans=False)  # no listed value can equal a boolean
        return text == F.lit(values[0]) if len(values) == 1 else text.isin(values)

    def _number_test(self, fields: Fields) -> Column:
        kind, bound = fields.kind(self.field), self.value
        if bound is None or math.isnan(bound):
            return F.lit(False)
        if isinstance(kind, T.IntegralType) and math.isfinite(bound) and abs(bound) < 2**62:
            # Round towards the side that keeps the comparison exact on whole numbers.
            whole = math.floor(bound) if self.op in (">", "<=") else math.ceil(bound)
            return _NUMERIC[self.op](fields.value(self.field), F.lit(whole))
        number = fields.value(self.field) if isinstance(kind, T.FractionalType) else fields.number(self.field)
        test = _NUMERIC[self.op](number, F.lit(float(bound)))
        if self.op in (">", ">=") and not isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType)):
            test = test & ~F.isnan(number)  # NaN compares false, though it sorts last
        return test


_NUMERIC = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}


def parse_condition(text: str) -> Condition:
    """Read ``exists:f``, ``missing:f`` or ``field op value``."""
    for op in ("exists", "missing"):
        if text.startswith(op + ":"):
            return Condition(text[len(op) + 1 :].strip(), op)
    match = _COMPARISON.match(text)
    if not match:
        raise ValueError(f"Invalid condition format: {text}")
    field, op, rest = match.groups()
    if op in ("in", "not in"):
        if not (rest.startswith("[") and rest.endswith("]")) or re.search(r"[\[\]]", rest[1:-1]):
            raise ValueError(f"Invalid list format in condition: {text}")
        return Condition(field, op, tuple(_unquote(item.strip()) for item in rest[1:-1].split(",")))
    value = rest.strip("\"'")
    if op in ("=~", "!~"):
        return Condition(field, op, regex.compile_pattern(value))
    if op in _NUMERIC:
        return Condition(field, op, _number(value))
    return Condition(field, op, value)


def _unquote(item: str) -> str:
    return item[1:-1] if len(item) >= 2 and item[0] == item[-1] and item[0] in "\"'" else item


def _number(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def filter_events(
    condition: str | None = None,
    conditions: list[str] | tuple[str, ...] = (),
    mode: str = "any",
    negate: bool = False,
) -> Step:
    """Keep the rows for which any / all of the conditions hold (none, with ``negate``)."""
    texts = [*conditions, *([condition] if condition is not None else [])]
    if not texts:
        raise ValueError("At least one condition is required")
    if mode not in ("any", "all"):
        raise ValueError(f"Invalid mode: {mode}")
    parsed = [parse_condition(t) for t in texts]
    compared = list(dict.fromkeys(c.field for c in parsed if c.op in _NUMERIC))

    def prepare(df: DataFrame) -> DataFrame:
        # Numbers that must be read out of a text or variant are read once per row.
        for name in compared:
            if isinstance(Fields(df).kind(name), (T.StringType, T.VariantType)):
                df = once(df, NUMBER + name, Fields(df).number(name))
        return df

    def judge(df: DataFrame) -> Verdict:
        fields = Fields(df)
        result = reduce(or_ if mode == "any" else and_, [c.holds(fields) for c in parsed])
        keep = ~result if negate else result
        failures = [f for f in (c.fails(fields) for c in parsed) if f is not None]
        if not failures:
            return Verdict(keep)
        error = reduce(or_, failures)
        # A comparison that holds has been evaluated; only the others need the check.
        needs_check = negate or len(parsed) > 1
        return Verdict(keep & ~error if needs_check else keep, error, "not a number")

    def finish(df: DataFrame) -> DataFrame:
        return df.drop(*(NUMBER + name for name in compared))

    return Step("filter", prepare, judge, finish) if compared else Step("filter", judge=judge)
