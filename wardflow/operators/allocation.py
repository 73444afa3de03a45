"""Exact proration of stay amounts to calendar days, and of stay amounts to units or weeks.

The amount of a stay is spread over day entries in one of four ways:

* 4 - several rows in the campaign (weekly part-time billing): each row over its own week;
* 2 - one row and one campaign: over every day of the stay, whatever the year;
* 1 - one row, several campaigns: over the days whose week ends in the campaign's year;
* 3 - case 2 without any day: the whole amount on the administrative entry date.

Amounts that find no day in cases 1 and 4 are dropped.

Amounts stay decimal: one entry's part is rounded to 12 places, sums of parts are exact, and money is rounded once,
where it is shown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.functions import calendar as cal
from wardflow.functions.derive import official_amount_rows
from wardflow.operators.presence import STAY, profile_days, stay_totals, week_profile


def part_of(amount: Column, n: Column) -> Column:
    """``amount / n`` to 12 places; the quotient is taken to 20 first, which no rounding tie can fall between."""
    return F.round(amount.cast("decimal(30,12)") / n.cast("decimal(7,0)"), 12)


def billed_amounts(valuation: DataFrame) -> DataFrame:
    """Official non-zero amounts by (stay, campaign, week code); rows of one week are added up.

    At most one row per week and campaign is left, so what follows is bounded per stay by the
    calendar.
    """
    rows = valuation.where((F.col("montant_br_sej") != 0) & official_amount_rows())
    return rows.groupBy(*STAY, "campagne", "numero_semaine").agg(
        F.sum("montant_br_sej").cast("decimal(18,2)").alias("amount"), F.count(F.lit(1)).alias("n_rows")
    )


def tag_cases(amounts: DataFrame) -> DataFrame:
    """Add the billing case: number of rows in the campaign, then number of campaigns of the stay."""
    campaign = Window.partitionBy(*STAY, "campagne")
    by_campaign = Window.partitionBy(*STAY).orderBy("campagne")
    stay = Window.partitionBy(*STAY)
    return (
        amounts.withColumn("_rows", F.sum("n_rows").over(campaign))
        .withColumn("_rank", F.dense_rank().over(by_campaign))
        .withColumn("_campaigns", F.max("_rank").over(stay))
        .withColumn("billing_case", F.when(F.col("_rows") > 1, 4).when(F.col("_campaigns") == 1, 2).otherwise(1))
        .drop("_rows", "_rank", "_campaigns")
    )


def amounts_per_stay(cases: DataFrame) -> DataFrame:
    """One row per stay with its amounts as an array (at most 53 per campaign)."""
    item = F.struct(
        "billing_case", "campagne", "amount",
        cal.valuation_year(F.col("numero_semaine")).alias("y"), cal.valuation_week(F.col("numero_semaine")).alias("w"),
    )
    return cases.groupBy(*STAY).agg(F.collect_list(item).alias("amounts"))


RATE = "decimal(31,12)"


def weekly_value(weeks: DataFrame, valuation: DataFrame, admin: DataFrame, by_unit: bool = True) -> DataFrame:
    """Prorated value per stay, campaign and week, without a row per day.

    Result: (finess_epmsi, stay, campagne, billing_case, monday, unit, hosp, days, rate); ``days`` holds the entries of
    the seven days and ``rate`` the value of one entry. An amount on the administrative entry date is a week with that
    one entry. Weekly records are aggregated per stay, week and unit and joined once to one row per stay with its amounts
    and the entries of the stay and of its campaign years, which are aggregates: no fan-out and no window by stay. ``by_unit=False`` leaves ``unit``
    and ``hosp`` NULL, for values that show neither (``week_profile``).
    """
    profile = week_profile(weeks, by_unit=by_unit).drop("n_stay", "n_campaign", "first")
    entry = admin.where("date_entree is not null").groupBy(*STAY).agg(F.max(F.to_date("date_entree")).alias("day"))
    per_stay = amounts_per_stay(tag_cases(billed_amounts(valuation))).join(stay_totals(weeks), STAY, "left").join(entry, STAY, "left")

    applies = F.filter("amounts", lambda a: (
        (a["billing_case"] == 2)
        | ((a["billing_case"] == 1) & (a["campagne"] == F.col("sunday_year")))
        | ((a["billing_case"] == 4) & (a["y"] == F.col("iso_year")) & (a["w"] == F.col("week")))
    ))
    in_campaign = F.get(F.filter("campaigns", lambda c: c["sunday_year"] == F.col("sunday_year")), F.lit(0))["n"]
    spread = (
        profile.where("n_week > 0").join(per_stay, STAY)
        .select(*STAY, "monday", "unit", "hosp", "days", "n_week", "n_stay", in_campaign.alias("n_campaign"), F.explode(applies).alias("a"))
        .withColumn("rate", part_of(F.col("a.amount"), F.when(F.col("a.billing_case") == 4, F.col("n_week"))
                                    .when(F.col("a.billing_case") == 2, F.col("n_stay")).otherwise(F.col("n_campaign"))))
    )
    spread = spread.select(*STAY, "a.campagne", "a.billing_case", "monday", "unit", "hosp", "days", F.col("rate").cast(RATE).alias("rate"))

    place = F.weekday("day")
    on_entry = per_stay.where("(campaigns is null or n_stay = 0) and day is not null").select(
        *STAY, "day", F.explode(F.filter("amounts", lambda a: a["billing_case"] == 2)).alias("a")
    ).select(
        *STAY, F.col("a.campagne").alias("campagne"), F.lit(3).alias("billing_case"), F.date_sub("day", place).alias("monday"),
        F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("hosp"),
        F.array(*[(place == i).cast("int") for i in range(7)]).alias("days"), F.col("a.amount").cast(RATE).alias("rate"),
    )
    return spread.unionByName(on_entry)


def value_of(entries: Column) -> Column:
    """Exact value of a number of entries of a weekly row."""
    return (F.col("rate") * entries.cast("decimal(5,0)")).cast("decimal(38,12)")


def daily_value(weeks: DataFrame, valuation: DataFrame, admin: DataFrame) -> DataFrame:
    """Prorated value per stay, campaign and calendar day.

    Result: (finess_epmsi, stay, campagne, billing_case, day, entries, unit, hosp, value), where
    ``value`` covers all entries of the day.
    """
    return days_of(weekly_value(weeks, valuation, admin))


def days_of(weekly: DataFrame) -> DataFrame:
    """The days of ``weekly_value``."""
    days = profile_days(weekly, "campagne", "billing_case", "rate")
    return days.select(*STAY, "campagne", "billing_case", "day", "entries", "unit", "hosp", value_of(F.col("entries")).alias("value"))


def unit_shares(weeks: DataFrame, last_units: DataFrame) -> DataFrame:
    """Share of each unit in a stay's day entries; a stay without a day belongs to its last unit.

    Shares of a stay add up to 1, so any split by unit adds up to the total; ``n`` of ``n_stay`` is
    the share exactly. The whole stay counts, whatever the period shown.
    """
    profile = week_profile(weeks)
    entries = F.aggregate("days", F.lit(0).cast("bigint"), lambda total, d: total + d)
    per_unit = profile.groupBy(*STAY, F.col("unit").alias("unite")).agg(F.sum(entries).alias("n")).where("n > 0")
    total = Window.partitionBy(*STAY)
    with_days = per_unit.withColumn("n_stay", F.sum("n").over(total)).withColumn("share", F.col("n") / F.col("n_stay"))
    one = F.lit(1).cast("bigint")
    without = last_units.join(with_days.select(*STAY).distinct(), STAY, "left_anti").select(
        *STAY, F.col("last_unit").alias("unite"), one.alias("n"), one.alias("n_stay"), F.lit(1.0).alias("share")
    )
    return with_days.unionByName(without)


def presence_weighted(
    records: DataFrame, owners: list[str], weight: str, amount: str, order: list[str], name: str = "allocated"
) -> DataFrame:
    """Spread each owner's amount over its records in proportion to ``weight``.

    Without any weight the whole amount goes to the owner's last record by ``order``.
    """
    return with_share(records, owners, weight, order, "_share", "inner").withColumn(name, F.col(amount) * F.col("_share")).drop("_share")


def with_share(records: DataFrame, owners: list[str], weight: str, order: list[str], name: str, how: str = "left") -> DataFrame:
    """Add each record's share in its owner's ``weight``; without any weight the last record by ``order`` has it all.

    Totals per owner come from an aggregate joined back, so a hot owner is not one task's window. A record without an
    owner (a NULL in the key) has no share, and is left out by ``how="inner"``.
    """
    owned = records.where(reduce(lambda a, b: a & b, [F.col(o).isNotNull() for o in owners]))
    totals = owned.groupBy(*owners).agg(F.sum(weight).alias("_total"), F.max(F.struct(*order)).alias("_last"))
    last = (F.struct(*order) == F.col("_last")).cast("double")
    share = F.when(F.col("_total") > 0, F.col(weight) / F.col("_total")).otherwise(last)
    return records.join(totals, owners, how).withColumn(name, share).drop("_total", "_last")
