"""Row predicates offered to explorers: text with wildcards, numeric, value sets, axis and exclusions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardflow.functions.derive import EMPTY, HOSPITALISATION_GROUP


def wildcard_pattern(text: str, whole: bool) -> str:
    """Regular expression of a text with ``*`` (any run) and ``?`` (one character)."""
    body = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in text)
    return f"(?s)^{body}$" if whole else f"(?s){body}"


def text_filter(column: Column, op: str, wanted: str) -> Column:
    """Case-insensitive ``=``, ``<>`` or ``contains``; the blank value is ``(vide)``, no text no filter."""
    wanted = wanted.strip()
    if not wanted:
        return F.lit(True)
    value = F.lower(F.coalesce(F.nullif(column.cast("string"), F.lit("")), F.lit(EMPTY)))
    wanted = wanted.lower()
    hit = value.rlike(wildcard_pattern(wanted, whole=op != "contains"))
    return ~hit if op == "<>" else hit


def number_filter(column: Column, op: str, *bounds: float, scale: float = 1.0) -> Column:
    """``between``, ``=``, ``>=``, ``<=`` or ``in`` on a scaled number; NULL never matches."""
    value = column.try_cast("double") * F.lit(scale)
    tests = {
        "between": lambda: value.between(bounds[0], bounds[1]),
        "=": lambda: value == bounds[0],
        ">=": lambda: value >= bounds[0],
        "<=": lambda: value <= bounds[0],
        "in": lambda: value.isin(*bounds),
    }
    return F.coalesce(tests[op](), F.lit(False))


def value_set_filter(column: Column, values: Iterable[str]) -> Column:
    """Value in a ticked list where a blank value is ``(vide)``."""
    shown = F.coalesce(F.nullif(column.cast("string"), F.lit("")), F.lit(EMPTY))
    return shown.isin(*list(values))


def axis_filter(name: str, value: str | Iterable[str]) -> Column:
    """One axis value, a merged hospitalisation type, or a user group of units."""
    if name == "type_hospitalisation":
        codes = [k for k, v in HOSPITALISATION_GROUP.items() if v == value]
        return F.col(name).isin(*(codes or [value]))
    if isinstance(value, str):
        return F.col(name) == value
    return F.col(name).isin(*sorted(value))


@dataclass(frozen=True)
class ExclusionRule:
    """Rows of one establishment and year to leave out, by record version."""

    finess: str
    year: int
    versions: tuple[str, ...] = field(default_factory=tuple)

    def matches(self) -> Column:
        hit = (F.col("finess_epmsi") == self.finess) & (F.col("iso_year") == self.year)
        if self.versions:
            hit = hit & F.col("version_format_rhs_groupe").isin(*self.versions)
        return F.coalesce(hit, F.lit(False))


def keep_rows(rules: Iterable[ExclusionRule] = ()) -> Column:
    """True for rows no exclusion rule matches; without rules every row stays."""
    out = F.lit(True)
    for rule in rules:
        out = out & ~rule.matches()
    return out


def period_overlap(entry: Column, leave: Column, start: Column, end: Column) -> Column:
    """Stay overlaps a period; an open stay has no leave date."""
    return (entry <= end) & (leave.isNull() | (leave >= start))
