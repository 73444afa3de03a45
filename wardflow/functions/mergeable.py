"""Calculated measures that merge: each is a function of parts, and a part's state of a total is merged from its cells.

A part is a sum, count, minimum, maximum, something told by the counts of values (distinct, mode, median), or an amount of
another source that counts once however many rows of a cell carry it (once). A pivot
computes the states of its cells once, merges them up to every total, and only then applies the measures' functions. So a
ratio's total is the ratio of the totals, and no source row is read once per total.

    per_day = ratio(total(F.col("acts")), total(F.col("days")))
    share = apply(lambda a, b: 100 * a / b, total_if(F.col("full"), F.col("days")), total(F.col("days")))
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardflow.functions.measures import truth

ADDITIVE, OF_VALUES, OF_OWNERS = ("sum", "count", "min", "max"), ("distinct", "mode", "median"), ("once",)


@dataclass(frozen=True)
class Part:
    """``kind`` of a row expression; a NULL value takes no part. ``owner`` names the row of another source it belongs to."""

    kind: str
    value: Column
    owner: Column | None = None

    def __post_init__(self) -> None:
        if self.kind not in ADDITIVE + OF_VALUES + OF_OWNERS or (self.owner is None) == (self.kind in OF_OWNERS):
            raise ValueError(f"no mergeable state for {self.kind!r}")


@dataclass(frozen=True)
class Calculated:
    """A measure: its parts, and the column it makes of their merged states."""

    parts: tuple[Part, ...]
    build: Callable[[list[Column]], Column]

    def column(self) -> Column:
        """The measure as one plain aggregate expression, for a single ``groupBy``."""
        if any([p.kind in OF_OWNERS for p in self.parts]):
            raise ValueError("an amount that counts once per owner needs a pivot")
        return self.build([_PLAIN[p.kind](p.value) for p in self.parts])


_PLAIN = {
    "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "distinct": F.count_distinct, "mode": lambda v: F.mode(v, True), "median": F.median,
}


def _of(kind: str, value: Column, finish: Callable[[Column], Column] = lambda c: c) -> Calculated:
    return Calculated((Part(kind, value),), lambda c: finish(c[0]))


def apply(function: Callable[..., Column], *measures: Calculated) -> Calculated:
    """Any column function of measures."""
    sizes = [len(m.parts) for m in measures]

    def build(columns: list[Column]) -> Column:
        cuts = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
        return function(*[m.build(columns[a:b]) for m, a, b in zip(measures, cuts[:-1], cuts[1:], strict=True)])

    return Calculated(tuple(p for m in measures for p in m.parts), build)


def total(value: Column) -> Calculated:
    """Sum, 0 over nothing."""
    return _of("sum", value, lambda c: F.coalesce(c, F.lit(0.0)))


def total_known(value: Column) -> Calculated:
    """Sum, NULL over nothing."""
    return _of("sum", value)


def total_if(condition: Column, value: Column) -> Calculated:
    """Sum over the rows where the condition holds, an unknown condition being false."""
    return total(F.when(truth(condition), value))


def count(value: Column) -> Calculated:
    return _of("count", value, lambda c: F.coalesce(c, F.lit(0)))


def count_known(value: Column) -> Calculated:
    """Count, NULL over nothing."""
    return _of("count", value, lambda c: F.nullif(c, F.lit(0)))


def mean(value: Column) -> Calculated:
    return apply(F.try_divide, total_known(value), count(value))


def least(value: Column) -> Calculated:
    return _of("min", value)


def greatest(value: Column) -> Calculated:
    return _of("max", value)


def distinct(value: Column) -> Calculated:
    """Number of different values, 0 over nothing."""
    return _of("distinct", value, lambda c: F.coalesce(c, F.lit(0)))


def mode(value: Column) -> Calculated:
    """Most frequent value, the smallest one among equals."""
    return _of("mode", value)


def median(value: Column) -> Calculated:
    """Exact; the mean of the middle two of an even number."""
    return _of("median", value)


def only(value: Column) -> Calculated:
    """The value when all rows share it, else NULL."""
    return apply(lambda a, b: F.when(a == b, b), least(value), greatest(value))


def once(value: Column, owner: Column) -> Calculated:
    """Sum over the different owners of a cell's rows, each owner's value once; a NULL owner takes no part."""
    return Calculated((Part("once", value, owner),), lambda c: c[0])


def ratio(top: Calculated, bottom: Calculated) -> Calculated:
    """NULL for a zero or missing denominator."""
    return apply(F.try_divide, top, bottom)
