"""Semantics of calculated measures as column builders.

Users write measures as Spark column or SQL aggregate expressions; these helpers carry the rules
that differ from plain SQL (missing text is empty, comparison with nothing is false, rounding to a
multiple). Division by zero and failed conversions give NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def truth(condition: Column) -> Column:
    """Two-valued logic: an unknown condition is false."""
    return F.coalesce(condition, F.lit(False))


def if_(condition: Column, then: Column, other: Column | None = None) -> Column:
    out = F.when(truth(condition), then)
    return out if other is None else out.otherwise(other)


def is_null(value: Column) -> Column:
    return value.isNull() | (value.cast("string") == "")


def round_to(value: Column, step: float = 1.0) -> Column:
    """Nearest multiple of ``step``, halves going up; a zero step counts as 1."""
    step = float(step or 1.0)
    return F.floor(value.try_cast("double") / F.lit(step) + F.lit(0.5)) * F.lit(step)


def modulo(value: Column, by: Column) -> Column:
    """Remainder with the dividend's sign; NULL for a zero divisor."""
    return F.when(by != 0, value % by)


def text(value: Column) -> Column:
    """Text of a value, nothing being empty text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def left(value: Column, n: int) -> Column:
    return F.substring(text(value), 1, n) if n > 0 else F.lit("")


def right(value: Column, n: int) -> Column:
    return F.right(text(value), F.lit(n)) if n > 0 else F.lit("")


def length(value: Column) -> Column:
    return F.length(text(value))


def upper(value: Column) -> Column:
    return F.upper(text(value))


def lower(value: Column) -> Column:
    return F.lower(text(value))


def trim(value: Column) -> Column:
    return F.trim(text(value))


def year(value: Column) -> Column:
    return F.year(F.try_to_date(value.cast("string"), "yyyy-MM-dd"))


def month(value: Column) -> Column:
    return F.month(F.try_to_date(value.cast("string"), "yyyy-MM-dd"))


def range_sum(*values: Column) -> Column:
    """Sum ignoring what is missing or not a number; 0 of nothing."""
    total = F.lit(0.0)
    for value in values:
        total = total + F.coalesce(value.try_cast("double"), F.lit(0.0))
    return total


def number(value: Column) -> Column:
    """Number at the start of a text, NULL when there is none."""
    return F.nullif(F.regexp_extract(value, NUMBER_PREFIX, 1), F.lit("")).try_cast("double")


def arithmetic(a: Column, op: str, b: Column) -> Column:
    """+ - * / on numbers or numeric text; NULL when a side is missing or the divisor is 0."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[op]()


def compare(a: Column, op: str, b: Column) -> Column:
    """Comparison; equality holds as number or as text."""
    if op in ("=", "<>"):
        same = (a.cast("string") == b.cast("string")) | truth(a.try_cast("double") == b.try_cast("double"))
        return same if op == "=" else ~same
    x, y = a.try_cast("double"), b.try_cast("double")
    return {"<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[op]()


def both(a: Column, b: Column) -> Column:
    return truth(a) & truth(b)


def either(a: Column, b: Column) -> Column:
    return truth(a) | truth(b)


def negate(a: Column) -> Column:
    return ~truth(a)


# --- aggregates -------------------------------------------------------------------------------


def sum_(value: Column) -> Column:
    """Sum, 0 over nothing."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def sum_if(condition: Column, value: Column) -> Column:
    return sum_(F.when(truth(condition), value))


def count_distinct(value: Column) -> Column:
    return F.count_distinct(value)


def mode(value: Column) -> Column:
    """Most frequent value, the smallest one among equals."""
    return F.mode(value, True)


def only(value: Column) -> Column:
    """The value when all rows share it, else NULL."""
    return F.when(F.min(value) == F.max(value), F.max(value))


def ratio(top: Column, bottom: Column) -> Column:
    """Ratio of two aggregates, NULL for a zero or missing denominator."""
    return F.try_divide(top, bottom)


@dataclass(frozen=True)
class Measure:
    """A named calculated measure of one source: an aggregate expression, or a measure of mergeable parts."""

    name: str
    source: str
    build: Callable[[], Any]

    def column(self) -> Column:
        built = self.build()
        return (built if isinstance(built, Column) else built.column()).alias(self.name)


class MeasureBook:
    """Calculated measures by name; each is analysed against its source when it is registered."""

    def __init__(self) -> None:
        self._measures: dict[str, Measure] = {}

    def register(self, name: str, source: str, rows: DataFrame, build: Callable[[], Any]) -> Measure:
        if name in self._measures:
            raise ValueError(f"measure {name!r} exists already")
        measure = Measure(name, source, build)
        rows.agg(measure.column())  # raises AnalysisException on an unknown field or a bad nesting
        self._measures[name] = measure
        return measure

    def columns(self, *names: str) -> list[Column]:
        return [self._measures[n].column() for n in names]

    def __iter__(self):
        return iter(self._measures.values())


def with_total(rows: DataFrame, keys: list[str], name: str, value: Column) -> DataFrame:
    """Cell sums next to the total over all rows (the documented meaning of TOTAL)."""
    total = rows.agg(sum_(value).alias("total")).scalar()
    return rows.groupBy(*keys).agg(sum_(value).alias(name)).withColumn(f"{name}_total", total)
