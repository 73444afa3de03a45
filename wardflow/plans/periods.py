"""Reporting periods: comparable year-to-date weeks per establishment, and filters on them.

A period is a row (finess_epmsi, iso_year, min_week, max_week, start, end, month, label). There are
as many as establishments times years. Stored periods have a known size; if it is small they are
broadcast, so that the fact tables are not shuffled on a handful of establishments.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.functions import calendar as cal
from wardflow.functions.filters import ExclusionRule, keep_rows, period_overlap
from wardflow.operators.size import small


def _rows(years: DataFrame, min_week: Column, max_week: Column) -> DataFrame:
    y = F.col("iso_year")
    out = years.withColumns({"min_week": min_week, "max_week": max_week})
    return out.withColumns({
        "start": cal.iso_monday(y, F.col("min_week")),
        "end": cal.week_sunday(y, F.col("max_week")),
        "label": F.format_string("%d (semaines %02d–%02d)", y, F.col("min_week"), F.col("max_week")),
    })


def reporting_periods(weeks: DataFrame, years: Iterable[int] | None = None, month: int | None = None) -> DataFrame:
    """Year-to-date periods: the latest year's last month sets where all years end.

    A year whose first week comes after week 2 is left out; ``years`` restricts the choice and
    ``month`` replaces the latest year's month.
    """
    seen = weeks.where("iso_year is not null and week is not null").groupBy("finess_epmsi", "iso_year").agg(
        F.min("week").alias("first_week"), F.max("week").alias("last_week")
    )
    if years is not None:
        seen = seen.where(F.col("iso_year").isin(*[int(y) for y in years]))
    latest = Window.partitionBy("finess_epmsi")
    target = F.max_by(F.struct("iso_year", "last_week"), "iso_year").over(latest)
    tagged = seen.withColumn("target", target).withColumn(
        "month",
        F.lit(month) if month is not None
        else F.month(cal.iso_date(F.col("target.iso_year"), F.col("target.last_week"), F.lit(4))),
    )
    kept = tagged.where("first_week <= 2").select("finess_epmsi", "iso_year", "month")
    out = _rows(kept, F.lit(1), cal.last_week_of_month(F.col("iso_year"), F.col("month")))
    return out.select("finess_epmsi", "iso_year", "min_week", "max_week", "start", "end", "month", "label")


def custom_periods(years: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Periods from one (day, month) to another in each (finess_epmsi, iso_year)."""
    y = F.col("_year")  # an aggregate: the condition on the weeks is not pushed down to every record
    week = [cal.week_of_day(y, F.lit(m), F.lit(d)) for d, m in (first, last)]
    out = _rows(years.groupBy("finess_epmsi", "iso_year").agg(F.max("iso_year").alias("_year")), *week)
    return out.where("min_week <= max_week").select(
        "finess_epmsi", "iso_year", "min_week", "max_week", "start", "end", F.lit(last[1]).alias("month"), "label"
    )


def weeks_in_period(
    weeks: DataFrame, periods: DataFrame, rules: Iterable[ExclusionRule] = ()
) -> DataFrame:
    """Weekly records inside a period of their establishment and year, minus the excluded ones."""
    bounds = periods.select("finess_epmsi", "iso_year", "min_week", "max_week")
    hit = weeks.join(small(bounds), ["finess_epmsi", "iso_year"]).where("week between min_week and max_week")
    return hit.where(keep_rows(rules)).drop("min_week", "max_week")


def stays_in_period(admin: DataFrame, periods: DataFrame, entry: str = "date_entree", leave: str = "date_sortie") -> DataFrame:
    """Administrative stays overlapping a period, tagged with the first such period's year.

    A stay counts once, under the earliest year it overlaps.
    """
    bounds = periods.select("finess_epmsi", "iso_year", "start", "end")
    hit = admin.join(small(bounds), "finess_epmsi").where(
        period_overlap(F.to_date(entry), F.to_date(leave), F.col("start"), F.col("end"))
    )
    first = hit.groupBy("finess_epmsi", "stay").agg(F.min("iso_year").alias("periode_annee"))
    return admin.join(first, ["finess_epmsi", "stay"])


def campaigns_in_period(valuation: DataFrame, periods: DataFrame) -> DataFrame:
    """Valuation rows whose campaign is a period year."""
    years = periods.select("finess_epmsi", F.col("iso_year").alias("campagne"))
    return valuation.join(small(years), ["finess_epmsi", "campagne"], "left_semi")


def establishments(*tables: DataFrame) -> DataFrame:
    """Establishments of several tables."""
    out = tables[0].select("finess_epmsi")
    for table in tables[1:]:
        out = out.union(table.select("finess_epmsi"))
    return out.where(F.coalesce(F.col("finess_epmsi"), F.lit("")) != "").distinct()


def available_years(weeks: DataFrame) -> DataFrame:
    """Years with a weekly record, per establishment."""
    return weeks.where("iso_year is not null").select("finess_epmsi", "iso_year").distinct()
