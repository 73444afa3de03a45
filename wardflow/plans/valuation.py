"""Valuation: official, comparable and split amounts, supplements, unvalued stays and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.functions.derive import HOSPITALISATION_TO_VALUATION, lookup, official_amount_rows
from wardflow.operators.allocation import part_of, unit_shares, value_of
from wardflow.operators.ordered import join_groups
from wardflow.operators.presence import STAY, entries_between, last_unit, last_week_of_year, week_profile
from wardflow.operators.size import small
from wardflow.session import run_folder

PERIOD = ["finess_epmsi", "iso_year"]

# Causes of an unvalued stay in order of precedence, and their labels.
UNVALUED_CAUSES = [
    ("nv_chain", "Chaînage (NV_CHAIN)"),
    ("nv_attente_dts", "En attente de droits (NV_ATTENTE_DTS)"),
    ("nv_nonfactam", "Non facturable à l'AM (NV_NONFACTAM)"),
    ("erreur_groupage", "Erreur de groupage (GME 9096Z)"),
    ("en_cours", "Séjour en cours, pas encore clos (<90j)"),
]
GROUPING_ERROR = "9096ZZ0"  # fixed value: group code of an ungrouped stay


def campaign_amount(valuation: DataFrame) -> DataFrame:
    """Official amount per campaign, net of transport."""
    rows = valuation.where(F.col("montant_br_tot").isNotNull() & official_amount_rows())
    net = F.col("montant_br_tot") - F.coalesce("montant_br_trans", F.lit(0).cast("decimal(18,2)"))
    return rows.groupBy("finess_epmsi", "campagne").agg(F.sum(net).alias("montant"))


def comparable_rows(valuation: DataFrame, weeks: DataFrame, periods: DataFrame, official: bool = True) -> DataFrame:
    """Valuation rows of stays whose recorded weeks of the campaign year end within the period."""
    rows = valuation.where(F.col("montant_br_tot").isNotNull())
    if official:
        rows = rows.where(official_amount_rows())
    closed = last_week_of_year(weeks).join(small(periods.select(*PERIOD, "max_week")), PERIOD).where("last_week <= max_week")
    return rows.withColumn("iso_year", F.col("campagne")).join(closed.select(*STAY, "iso_year"), [*STAY, "iso_year"])


def comparable_amount(valuation: DataFrame, weeks: DataFrame, periods: DataFrame) -> DataFrame:
    """Amount per period with and without the blocked rows; the difference is the lost revenue."""
    rows = comparable_rows(valuation, weeks, periods, official=False)
    amount = F.col("montant_br_sej")
    official = F.when(official_amount_rows(), amount)
    zero = F.lit(0).cast("decimal(18,2)")
    return rows.groupBy(*PERIOD).agg(
        F.coalesce(F.sum(official), zero).alias("montant_br_tot"), F.sum(amount).alias("montant_br_tot_sans_filtre"),
    ).withColumn("montant_br_non_fact", F.col("montant_br_tot_sans_filtre") - F.col("montant_br_tot"))


def amount_by_hospitalisation(valuation: DataFrame, weeks: DataFrame, periods: DataFrame) -> DataFrame:
    """Comparable amount by hospitalisation type; the types add up to the total."""
    rows = comparable_rows(valuation, weeks, periods)
    return rows.groupBy(*PERIOD, "type_hospitalisation").agg(F.sum("montant_br_sej").alias("montant"))


def valuation_type(record_type: Column) -> Column:
    """Valuation code of a record's hospitalisation type."""
    return lookup(HOSPITALISATION_TO_VALUATION, record_type)


def amount_by_unit(valuation: DataFrame, weeks: DataFrame, periods: DataFrame, year_aware: bool = True) -> DataFrame:
    """Comparable amount by unit, in proportion to the stay's days there; the units add up to the total."""
    shares = unit_shares(weeks, last_unit(weeks, year_aware))
    rows = comparable_rows(valuation, weeks, periods).groupBy(*STAY, "iso_year").agg(
        F.sum("montant_br_sej").alias("montant")
    )
    part = part_of(F.col("montant").cast("decimal(18,2)") * F.col("n").cast("decimal(7,0)"), F.col("n_stay"))
    return rows.join(shares, STAY).groupBy(*PERIOD, "unite").agg(F.sum(part).alias("montant"))


def supplements(valuation: DataFrame, weeks: DataFrame, periods: DataFrame) -> DataFrame:
    """Transport, drugs and oncology supplements of the comparable stays."""
    zero = F.lit(0).cast("decimal(18,2)")
    def total(name: str) -> Column:
        return F.sum(F.coalesce(F.col(name), zero))
    return comparable_rows(valuation, weeks, periods).groupBy(*PERIOD).agg(
        total("montant_br_trans").alias("transport"), total("montant_am_med").alias("molecules_onereuses"),
        total("montant_br_supp_cancero").alias("supp_cancero"),
    ).withColumn("total", F.col("transport") + F.col("molecules_onereuses") + F.col("supp_cancero"))


def row_cause() -> Column:
    """First cause of one unpaid valuation row."""
    out = None
    for flag in ("nv_chain", "nv_attente_dts", "nv_nonfactam"):
        test = F.coalesce(F.col(flag), F.lit(0)) != 0
        out = F.when(test, F.lit(flag)) if out is None else out.when(test, F.lit(flag))
    return out.when(F.col("code_gme") == GROUPING_ERROR, F.lit("erreur_groupage")).otherwise(F.lit("en_cours"))


def unvalued_stays(valuation: DataFrame, weeks: DataFrame, periods: DataFrame, order: tuple[str, ...] = ("numero_rha",)) -> DataFrame:
    """Stays closed by the period's end and without any paid row, counted by the first row's cause."""
    closed = last_week_of_year(weeks).join(small(periods.select(*PERIOD, "max_week")), PERIOD).where("last_week <= max_week")
    rows = valuation.withColumn("iso_year", F.col("campagne")).join(closed.select(*STAY, "iso_year"), [*STAY, "iso_year"])
    per_stay = rows.groupBy(*STAY, "iso_year").agg(
        F.bool_or(F.coalesce(F.col("montant_br_sej") != 0, F.lit(False))).alias("paid"),
        F.min_by(row_cause(), F.struct(*order)).alias("cause"),
    )
    rank = {c: str(i) for i, (c, _) in enumerate(UNVALUED_CAUSES)}
    return (
        per_stay.where("not paid").groupBy(*PERIOD, "cause").agg(F.count(F.lit(1)).alias("effectif"))
        .withColumn("libelle", lookup(dict(UNVALUED_CAUSES), F.col("cause")))
        .withColumn("rang", lookup(rank, F.col("cause")).cast("int"))
    )


def clean_open_stays(valuation: DataFrame, weeks: DataFrame) -> DataFrame:
    """Stays active in a year, never billed and without a blocking flag: (stay, iso_year)."""
    settled = valuation.where(F.col("montant_br_tot").isNotNull() | ~official_amount_rows()).select(*STAY)
    active = weeks.where("iso_year is not null").select(*STAY, "iso_year").distinct()
    return active.join(settled, STAY, "left_anti")


def open_stay_estimate(valuation: DataFrame, weeks: DataFrame, periods: DataFrame, price_per_day: DataFrame) -> DataFrame:
    """Revenue expected from clean open stays: their days in the period at the observed daily price.

    ``price_per_day`` is (finess_epmsi, iso_year, pmjt).
    """
    stays = clean_open_stays(valuation, weeks).join(small(periods.select(*PERIOD, "start", "end")), PERIOD)
    profile = week_profile(weeks, by_unit=False).where("monday is not null").select(*STAY, "monday", "days")
    entries = entries_between(F.datediff("start", "monday"), F.datediff("end", "monday"))
    counted = (
        stays.join(profile, STAY).where("start <= date_add(monday, 6) and end >= monday")
        .groupBy(*STAY, "iso_year").agg(F.sum(entries).alias("n")).where("n > 0")
        .groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("nb_sejours"), F.sum("n").alias("nb_journees"))
    )
    return price_per_day.join(counted, PERIOD, "left").select(
        *PERIOD, F.coalesce("nb_sejours", F.lit(0)).alias("nb_sejours"), F.coalesce("nb_journees", F.lit(0)).alias("nb_journees"),
        (F.coalesce("nb_journees", F.lit(0)) * F.coalesce("pmjt", F.lit(0.0))).alias("montant"),
    )


def value_per_year(weekly: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Prorated value per calendar year of the days; a week over New Year is cut in two."""
    to_new_year = F.datediff(F.make_date(F.year("monday"), F.lit(12), F.lit(31)), "monday")
    year = F.year("monday")
    parts = F.array(*[
        F.struct((year + later).alias("annee"), value_of(entries_between(*ends)).alias("value"), entries_between(*ends).alias("n"))
        for later, ends in ((0, (F.lit(0), to_new_year)), (1, (to_new_year + 1, F.lit(6))))
    ])
    rows = weekly.select("finess_epmsi", *(by or []), F.explode(F.filter(parts, lambda p: p["n"] > 0)).alias("p"))
    return rows.groupBy("finess_epmsi", "p.annee", *(by or [])).agg(F.sum("p.value").alias("montant_br_pt"))


def running_value(weekly: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(finess_epmsi, by…, day, running, entries): the value and entries of all days up to a day, on every day from the
    first to the last.

    The seven days of a week are summed side by side per establishment, with map-side combine; only those sums, which are
    stored so that the stays are read once, become days. A series is as long as the calendar, whatever the number of stays.
    """
    keys = ["finess_epmsi", *(by or [])]
    per_week = weekly.groupBy(*keys, "monday").agg(
        F.array(*[F.struct(F.sum(F.when(F.col("days")[i] != 0, value_of(F.col("days")[i]))).alias("value"), F.sum(F.col("days")[i]).alias("n")) for i in range(7)]).alias("values")
    )
    path = run_folder(weekly.sparkSession, "running")
    per_week.write.parquet(path)
    per_week = weekly.sparkSession.read.schema(per_week.schema).parquet(path)
    ends = per_week.groupBy(*keys).agg(F.min("monday").alias("_first"), F.max("monday").alias("_last"))
    calendar = ends.select(*keys, F.explode(F.expr("sequence(_first, date_add(_last, 6))")).alias("day"))
    on_day = per_week.select(*keys, "monday", F.posexplode("values").alias("_pos", "v")).select(
        *keys, F.expr("date_add(monday, _pos)").alias("day"), "v.value", "v.n"
    )
    days = join_groups(calendar, on_day, [*keys, "day"], "left")
    along = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row per calendar day
    return days.select(
        *keys, "day", F.sum(F.coalesce("value", F.lit(0).cast("decimal(38,12)"))).over(along).alias("running"),
        F.sum(F.coalesce("n", F.lit(0))).over(along).alias("entries"),
    )


def value_in_period(weekly: DataFrame, periods: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Prorated value of the days inside each period: the running total at its end less that before its start.

    A period without a day of value has no row.
    """
    by = by or []
    keys = ["finess_epmsi", *by]
    running = running_value(weekly, by)
    reach = running.groupBy(*keys).agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    asked = reach.join(small(periods.select(*PERIOD, "start", "end")), "finess_epmsi").where("start <= _last and end >= _first and start <= end")
    asked = asked.withColumns({"_to": F.least("end", "_last"), "_before": F.date_sub("start", 1)})
    for place, name in (("_to", "_upper"), ("_before", "_lower")):
        asked = join_groups(asked, running.withColumnsRenamed({"day": place, "running": name, "entries": f"{name}_n"}), [*keys, place], "left")
    upper, lower = (F.coalesce(c, F.lit(0)).cast("decimal(36,12)") for c in ("_upper", "_lower"))  # the difference keeps all places
    value = upper - lower
    asked = asked.where(F.col("_upper_n") > F.coalesce("_lower_n", F.lit(0)))
    return asked.select(*PERIOD, *by, value.alias("montant_br_pt"))


def mean_prices(value: DataFrame, activity: DataFrame, amounts: DataFrame) -> DataFrame:
    """Mean price per stay, week and day next to the official amounts of each period."""
    v = F.coalesce("montant_br_pt", F.lit(0).cast("decimal(38,12)"))
    mean = v.cast("double")
    return activity.join(value, PERIOD, "left").join(amounts, PERIOD, "left").select(
        *PERIOD, v.alias("montant_br_pt"),
        F.try_divide(mean, F.col("nb_ssr")).alias("pmct"), F.try_divide(mean, F.col("nb_rhs")).alias("pmst"),
        F.try_divide(mean, F.col("nb_journees")).alias("pmjt"),
        *[F.coalesce(c, F.lit(0).cast("decimal(18,2)")).alias(c) for c in
          ("montant_br_tot", "montant_br_tot_sans_filtre", "montant_br_non_fact")],
    )
