"""Joins between sources of different grain without fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_other_source(
    base: DataFrame, other: DataFrame, keys: list[str], base_year: str, base_week: str,
    other_year: str, other_week: str, order: list[str], picked: list[str],
) -> DataFrame:
    """One row of another source per base row: same year and week, else same year, else nothing.

    A base row without a year takes the stay's first row. The candidates are reduced to the first one per (stay, year,
    week) and packed in order into one row per stay, at most one entry per week of the calendar; so one join serves the
    three rules and no base row is multiplied. Result: base columns, the picked columns (prefixed ``o_``) and ``matched``.
    """
    packed, place = F.struct(*[F.col(c) for c in picked]), F.struct(*[F.col(c) for c in order])
    first = other.groupBy(*keys, F.col(other_year).alias("_wy"), F.col(other_week).alias("_ww")).agg(
        F.min(place).alias("place"), F.min_by(packed, place).alias("row")
    )
    per_stay = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", F.col("_wy").alias("y"), F.col("_ww").alias("w"), "row"))).alias("_c"))
    year, week = F.col(base_year), F.col(base_week)
    in_year = F.filter("_c", lambda c: c["y"] == year)
    found = base.join(per_stay, keys, "left").withColumn("_y", F.when(F.col("_c").isNotNull(), in_year))
    chosen = F.coalesce(
        F.get(F.filter("_y", lambda c: c["w"] == week), F.lit(0))["row"], F.get("_y", F.lit(0))["row"], F.when(year.isNull(), F.get("_c", F.lit(0))["row"]),
    )
    return found.select(*base.columns, chosen.alias("_o")).select(
        *base.columns, *[F.col(f"_o.{c}").alias(f"o_{c}") for c in picked], F.col("_o").isNotNull().alias("matched")
    )


def keep_if_any_match(base: DataFrame, other: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Base rows of which any row of the stay in another source passes a filter."""
    return base.join(other.where(condition).select(*keys), keys, "left_semi")


def count_once_per_cell(
    base: DataFrame, other: DataFrame, keys: list[str], cell: list[str], other_id: str, *aggregates: Column
) -> DataFrame:
    """Aggregate another source's rows per cell of the base, each foreign row once per cell.

    The base is reduced to distinct (cell, stay) pairs first; the join then meets every foreign row
    at most once per cell.
    """
    pairs = base.select(*cell, *keys).distinct()
    return pairs.join(other, keys).groupBy(*cell).agg(*aggregates)


def sources_side_by_side(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Measures each counted on its own source's rows, over the union of all keys.

    Every part is aggregated already; union and re-aggregate replaces a chain of full outer joins.
    """
    names = [c for df in parts.values() for c in df.columns if c not in keys]
    stacked = None
    for df in parts.values():
        stacked = df if stacked is None else stacked.unionByName(df, allowMissingColumns=True)
    return stacked.groupBy(*keys).agg(*[F.max(n).alias(n) for n in names])
