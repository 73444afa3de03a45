"""Weekly records to presence: week calendar, one profile per stay and week, calendar days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.functions import calendar as cal
from wardflow.functions.derive import day_flags, hospitalisation_group, present_days, stay_key

STAY = ["finess_epmsi", "stay"]


def with_week(records: DataFrame) -> DataFrame:
    """Add stay key, ISO week parts, Monday, campaign year, flags and day count to weekly records.

    A week its year does not have leaves ``monday`` NULL; such a record yields no calendar day.
    A stored table that already has ``stay``, ``iso_year`` and ``week`` as real columns keeps them, so
    filters and join keys reach the scan as plain columns.
    """
    code = F.col("numero_semaine")
    parsed = {
        "stay": stay_key(F.col("numero_admin_sejour")), "week": cal.week_of_code(code), "iso_year": cal.year_of_code(code),
    }
    missing = {name: value for name, value in parsed.items() if name not in records.columns}
    return records.withColumns({
        **missing, "flags": day_flags(F.col("jours_hors_weekend"), F.col("jours_weekend")),
    }).withColumns({
        "monday": cal.iso_monday(F.col("iso_year"), F.col("week")),
        "n_days": present_days(F.col("flags")),
    }).withColumn("sunday", F.date_add("monday", 6)).withColumn("sunday_year", F.year("sunday"))


def expand_days(weeks: DataFrame, *keep: str) -> DataFrame:
    """One row per present day of each record: (keep…, day). The same day may occur twice."""
    offsets = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: F.substring(F.col("flags"), i + 1, F.lit(1)) == "1")
    return (
        weeks.where(F.col("monday").isNotNull())
        .select(*keep, "monday", F.explode(offsets).alias("_d"))
        .select(*keep, F.expr("date_add(monday, _d)").alias("day"))
    )


def week_profile(weeks: DataFrame, order: tuple[str, ...] = ("source_file", "line_no"), by_unit: bool = True) -> DataFrame:
    """Day entries per stay, ISO week, unit and hospitalisation type, with the stay's totals.

    Two records of a stay may flag the same day: both count as entries, and the day belongs to the
    unit of the later record by ``order`` (a number giving the processing order). ``days`` holds
    the entries of the seven days the row owns; ``n_week``, ``n_campaign`` and ``n_stay`` are the
    entries of the week, of the campaign year and of the whole stay; ``first`` marks one row per
    stay.

    Records are first aggregated with map-side combine to at most one row per stay, week and unit,
    so the windows by stay that follow are bounded by the calendar however many records there are.

    What shows neither unit nor type asks for ``by_unit=False``: one row per stay and week with all entries of its days
    and ``unit`` and ``hosp`` NULL, from counts alone.
    """
    def flag(i: int) -> Column:
        return F.substring("flags", i + 1, 1) == "1"

    units = ["unit", "hosp"]
    week = [*STAY, "iso_year", "week"]
    valid = weeks.where(F.col("monday").isNotNull() & F.col("stay").isNotNull()).withColumns({
        "unit": F.col("numero_unite_medicale"), "hosp": hospitalisation_group(F.col("type_hospitalisation")),
    })
    # the unit breaks a last tie, so exactly one row owns a day
    last = F.struct(*order, *[F.coalesce(u, F.lit("")).alias(f"_{u}") for u in units])
    stay = Window.partitionBy(*STAY)
    y, w = F.col("iso_year"), F.col("week")
    totals = {
        "n_stay": F.sum("n").over(stay),
        "n_campaign": F.sum("n").over(Window.partitionBy(*STAY, "sunday_year")),
        "first": F.row_number().over(stay.orderBy("iso_year", "week", *units)) == 1,
    }
    if not by_unit:
        counted = valid.groupBy(*week).agg(F.sum("n_days").alias("n"), *[F.count_if(flag(i)).alias(f"c{i}") for i in range(7)])
        none = [F.lit(None).cast("string").alias(u) for u in units]
        entries = F.array(*[F.col(f"c{i}").cast("int") for i in range(7)])
        return counted.select(
            *week, *none, "n", entries.alias("days"), F.col("n").alias("n_week"), cal.iso_monday(y, w).alias("monday"), cal.sunday_year(y, w).alias("sunday_year"),
        ).withColumns(totals).drop("n")
    grouped = valid.groupBy(*week, *units).agg(
        F.sum("n_days").alias("n"),
        *[F.count_if(flag(i)).alias(f"c{i}") for i in range(7)],
        *[F.max(F.when(flag(i), last)).alias(f"m{i}") for i in range(7)],
    ).repartition(*STAY)
    in_week = Window.partitionBy(*week)
    owned = F.array(*[
        F.when(F.col(f"m{i}") == F.max(f"m{i}").over(in_week), F.sum(f"c{i}").over(in_week)).otherwise(F.lit(0)).cast("int")
        for i in range(7)
    ])
    return grouped.select(
        *week, *units, "n", owned.alias("days"), F.sum("n").over(in_week).alias("n_week"),
        cal.iso_monday(y, w).alias("monday"), cal.sunday_year(y, w).alias("sunday_year"),
    ).withColumns(totals).drop("n")


def stay_totals(weeks: DataFrame) -> DataFrame:
    """(stay, n_stay, campaigns): the entries of a stay and, as an array, of its campaign years, over the profile's records."""
    per_year = weeks.where(F.col("monday").isNotNull() & F.col("stay").isNotNull()).groupBy(*STAY, "sunday_year").agg(F.sum("n_days").alias("n"))
    return per_year.groupBy(*STAY).agg(F.sum("n").alias("n_stay"), F.collect_list(F.struct("sunday_year", "n")).alias("campaigns"))


def profile_days(profile: DataFrame, *keep: str) -> DataFrame:
    """Calendar days of a week profile: (stay, keep…, day, entries, unit, hosp)."""
    return (
        profile.select(*STAY, *keep, "monday", "unit", "hosp", F.posexplode("days").alias("_pos", "entries"))
        .where("entries > 0")
        .select(*STAY, *keep, F.expr("date_add(monday, _pos)").alias("day"), "entries", "unit", "hosp")
    )


def entries_between(first: Column, last: Column) -> Column:
    """Entries of the days ``first`` to ``last`` (0 to 6, what lies outside the week counts nothing) of a profile's week."""
    out = F.lit(0).cast("bigint")
    for i in range(7):
        out = out + F.when((first <= i) & (last >= i), F.col("days")[i]).otherwise(F.lit(0))
    return out


def last_presence(weeks: DataFrame) -> DataFrame:
    """Sunday of the last recorded week per stay, with or without a present day."""
    return weeks.where("monday is not null").groupBy(*STAY).agg(F.max("sunday").alias("last_sunday"))


def last_unit(weeks: DataFrame, year_aware: bool = True) -> DataFrame:
    """Unit of the stay's last week.

    ``year_aware=False`` compares the week number alone, as a stay over New Year was once read.
    """
    order = (["iso_year"] if year_aware else []) + ["week", "source_file", "line_no"]
    known = weeks.where(F.coalesce(F.col("numero_unite_medicale"), F.lit("")) != "")
    at = F.struct(*[F.col(c) for c in order])
    return known.groupBy(*STAY).agg(F.max_by("numero_unite_medicale", at).alias("last_unit"))


def last_week_of_year(weeks: DataFrame) -> DataFrame:
    """Last recorded week per stay and ISO year."""
    return weeks.groupBy(*STAY, "iso_year").agg(F.max("week").alias("last_week"))
