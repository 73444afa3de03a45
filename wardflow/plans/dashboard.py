"""Dashboard sections: one plan per section for all establishments and years at once.

``by`` holds the section's key, (finess_epmsi, iso_year) and, for secondary dashboards, an axis
column such as a unit or a user group of units. ``records`` are weekly records inside the periods.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.functions.derive import (
    STRUCTURE_CODES,
    age_years,
    blank_to_null,
    hospitalisation_group,
    structure_bucket,
    structure_label,
    sum_of_known,
)
from wardflow.operators.size import small
from wardflow.operators.latest import cap_identical
from wardflow.operators.ordered import top_per_group
from wardflow.operators.presence import STAY
from wardflow.plans.valuation import PERIOD, comparable_rows

GAP_DAYS = 21  # fixed value: records going on longer than this after the exit are a finding
GROUP_LENGTH = {"CM": 2, "GN": 4, "GME": 7}  # fixed values: code length by ranking level


def _ratio(top: Column, bottom: Column, factor: float = 1.0) -> Column:
    """Ratio shown as 0 when the denominator is 0."""
    return F.when(bottom != 0, F.lit(factor) * top / bottom).otherwise(F.lit(0.0))


def with_axis(records: DataFrame, axis: str, groups: dict[str, Iterable[str]] | None = None, values: Iterable[str] | None = None) -> DataFrame:
    """Add ``axis_value``: the unit or hospitalisation type, or every user group the unit is in.

    A record of two groups counts in both, as each group's dashboard is a view of its own.
    """
    value = hospitalisation_group(F.col(axis)) if axis == "type_hospitalisation" else F.col(axis)
    rows = records.where(blank_to_null(F.col(axis)).isNotNull())
    if groups:
        member = F.array_compact(F.array(*[
            F.when(value.isin(*list(units)), F.lit(name)) for name, units in groups.items()
        ]))
        return rows.withColumn("axis_value", F.explode(member))
    rows = rows.withColumn("axis_value", value)
    return rows.where(F.col("axis_value").isin(*list(values))) if values else rows


AXES = ["axis", "axis_value"]


def with_axes(records: DataFrame, groups: dict[str, Iterable[str]] | None = None, unit: str = "numero_unite_medicale", hosp: Column | None = None) -> DataFrame:
    """Every record once for each secondary dashboard it belongs to: its unit, its hospitalisation type, its unit's groups.

    One scan of these rows feeds all sections of all secondary dashboards, with (axis, axis_value) in their keys.
    """
    kind = hospitalisation_group(F.col("type_hospitalisation")) if hosp is None else hosp
    member = lambda axis, value, test: F.when(test, F.struct(F.lit(axis).alias("axis"), value.alias("axis_value")))
    known = lambda c: blank_to_null(c).isNotNull()
    memberships = [member("unit", F.col(unit), known(F.col(unit))), member("hosp", kind, known(kind))]
    memberships += [member("group", F.lit(name), F.col(unit).isin(*list(units))) for name, units in (groups or {}).items()]
    return records.withColumn("_m", F.explode(F.array_compact(F.array(*memberships)))).select("*", "_m.axis", "_m.axis_value").drop("_m")


def stay_activity(records: DataFrame, history: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Stays, records, days, days per stay in the period and over the whole stay, mean beds, % without error."""
    by = by or PERIOD
    per_stay = records.groupBy(*by, "numero_admin_sejour").agg(
        F.count(F.lit(1)).alias("rhs"), F.sum("n_days").alias("days"),
        F.count_if(blank_to_null(F.col("indicateur_erreur")).isNull()).alias("ok"),
    )
    whole = history.groupBy("finess_epmsi", "numero_admin_sejour").agg(F.sum("n_days").alias("all_days"))
    totals = per_stay.join(whole, ["finess_epmsi", "numero_admin_sejour"], "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("nb_ssr"), F.sum("rhs").alias("nb_rhs"), F.sum("days").alias("nb_journees"),
        F.sum("all_days").alias("nb_journees_pleines"), F.sum("ok").alias("nb_ok"),
    )
    weeks = records.groupBy(*by, "numero_semaine").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count("one").alias("nb_semaines"))
    return totals.join(weeks, by).select(
        *by, "nb_ssr", "nb_rhs", "nb_journees", "nb_journees_pleines", "nb_semaines",
        _ratio(F.col("nb_journees"), F.col("nb_ssr")).alias("dmh"),
        _ratio(F.col("nb_journees_pleines"), F.col("nb_ssr")).alias("dms_vraie"),
        _ratio(F.col("nb_journees"), F.col("nb_semaines") * 7).alias("nb_lits_moy"),
        _ratio(F.col("nb_ok"), F.col("nb_rhs"), 100.0).alias("exh"),
    )


def patients(
    admin: DataFrame, periods: DataFrame, last_sunday: DataFrame, order: list[str], stays: DataFrame | None = None, by: list[str] | None = None
) -> DataFrame:
    """Distinct patients by sex and mean age over stays, per period.

    A stay runs from its entry to the later of its exit (the period's end when open) and its last
    recorded week, and counts where it overlaps the period. A patient has the sex of the first row
    seen, ages are averaged over stays. ``stays`` restricts to the stays of an axis value; with ``by`` it has the
    section's keys for each stay of a period.
    """
    keys = by or PERIOD
    start = F.coalesce(F.to_date("date_entree"), F.to_date("date_hospitalisation"))
    rows = admin.withColumn("debut", start).where("debut is not null")
    if stays is not None and by is None:
        rows = rows.join(stays, STAY, "left_semi")
    rows = rows.join(last_sunday, STAY, "left").join(small(periods.select(*PERIOD, "start", "end")), "finess_epmsi")
    leave = F.greatest(F.coalesce(F.to_date("date_sortie"), F.col("end")), "last_sunday", "debut")
    seen = rows.where((leave >= F.col("start")) & (F.col("debut") <= F.col("end")))
    if stays is not None and by is not None:
        seen = seen.join(stays.select(*by, "stay").distinct(), [*PERIOD, "stay"])
    age = age_years(F.to_date("date_naissance_beneficiaire"), F.to_date("date_entree"))
    sex = F.col("sexe_beneficiaire")
    per_patient = seen.groupBy(*keys, "numero_ipp").agg(
        F.min_by(sex, F.struct(*order)).alias("sexe"),
        *[F.sum(F.when(sex == s, age)).alias(f"age_{n}") for s, n in (("2", "f"), ("1", "m"))],
        *[F.count(F.when(sex == s, age)).alias(f"n_{n}") for s, n in (("2", "f"), ("1", "m"))],
    )
    out = per_patient.groupBy(*keys).agg(
        F.count_if(F.col("sexe") == "2").alias("f"), F.count_if(F.col("sexe") == "1").alias("m"),
        *[F.sum(c).alias(c) for c in ("age_f", "age_m", "n_f", "n_m")],
    )
    total = F.col("f") + F.col("m")
    ages = F.coalesce("age_f", F.lit(0.0)) + F.coalesce("age_m", F.lit(0.0))
    return out.select(
        *keys, "f", "m", total.alias("total"), _ratio(F.col("f"), total, 100.0).alias("pct_f"),
        _ratio(F.col("m"), total, 100.0).alias("pct_m"), F.try_divide("age_f", "n_f").alias("age_f"),
        F.try_divide("age_m", "n_m").alias("age_m"), F.try_divide(ages, F.col("n_f") + F.col("n_m")).alias("age_total"),
    )


def days_per_week(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Present days per ISO week of each period."""
    by = by or PERIOD
    return records.groupBy(*by, "week").agg(F.sum("n_days").alias("nb_journees"))


def children_of(children: DataFrame, records: DataFrame, by: list[str] | None = None, *keep: str) -> DataFrame:
    """Act or diagnosis rows of the given records, with the section key."""
    by = by or PERIOD
    return children.join(records.select("rhs_id", *by, *keep).hint("merge"), "rhs_id")  # never broadcast: as many rows as records


def indicators(records: DataFrame, csarr: DataFrame, csar: DataFrame, das: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Dependence scores, capped act counts, distinct diagnoses and means per record and day."""
    by = by or PERIOD
    physical = sum_of_known(*[F.col(f"dependance_{x}") for x in ("habillage_toilette", "deplacement", "alimentation", "continence")])
    cognitive = sum_of_known(*[F.col(f"dependance_{x}") for x in ("comportement", "relation")])
    acts = cap_identical(csarr, "seq").select("rhs_id", "nombre_realisations").unionByName(cap_identical(csar, "seq").select("rhs_id", "nombre_realisations"))
    codes = das.where("code_das is not null").select("rhs_id", F.trim("code_das").alias("code")).distinct()
    per_record = acts.select("rhs_id", F.coalesce("nombre_realisations", F.lit(0)).alias("a"), F.lit(0).alias("d")).unionByName(
        codes.select("rhs_id", F.lit(0).alias("a"), F.lit(1).alias("d"))
    ).groupBy("rhs_id").agg(F.sum("a").alias("nb_acts"), F.sum("d").alias("nb_diag"))  # children are few per record: one row each
    out = records.join(per_record.hint("merge"), "rhs_id", "left").groupBy(*by).agg(
        F.avg(physical).alias("avq_phys_moy"), F.avg(cognitive).alias("avq_cogn_moy"),
        F.count(F.lit(1)).alias("nb_rhs"), F.sum("n_days").alias("nb_journees"),
        F.avg(F.coalesce("n1_nb_das", F.lit(0))).alias("nb_das_moy_rhs"), F.sum("nb_acts").alias("nb_acts"), F.sum("nb_diag").alias("nb_diag"),
    )
    total = F.coalesce("nb_acts", F.lit(0))
    return out.select(
        *by, "avq_phys_moy", "avq_cogn_moy", total.alias("nb_csarr"),
        F.coalesce("nb_diag", F.lit(0)).alias("nb_diag_approx"), "nb_das_moy_rhs",
        _ratio(total, F.col("nb_rhs")).alias("nb_moy_interv_rhs"), _ratio(total, F.col("nb_journees")).alias("nb_moy_csarr_j"),
    )


def staff_activity(records: DataFrame, csarr: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Realisations per staff type, no capping, with the label or the bare code."""
    by = by or PERIOD
    rows = children_of(csarr.where("code_intervenant is not null"), records, by)
    counts = rows.groupBy(*by, F.col("code_intervenant").alias("code")).agg(F.sum("nombre_realisations").alias("n"))
    return counts.join(labels, "code", "left").select(*by, "code", F.coalesce("libelle", "code").alias("libelle"), "n")


def staff_table(activity: DataFrame, scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Staff types with count and rounded scores, and a total row over all scores.

    The total includes scores without a staff type of their own (medical acts). Rounding is
    half-even, after the noise of summing in another order is dropped.
    """
    by = by or PERIOD
    def whole(value: Column) -> Column:
        return F.bround(F.round(F.coalesce(value, F.lit(0.0)), 6), 0)
    lines = activity.join(scores.drop("n"), [*by, "code"], "left").select(
        *by, "code", "libelle", "n",
        *[whole(F.col(c)).alias(c) for c in ("globale", "specialisee")],
    )
    counts = activity.groupBy(*by).agg(F.sum("n").alias("n"))
    sums = scores.groupBy(*by).agg(*[whole(F.sum(c)).alias(c) for c in ("globale", "specialisee")])
    total = counts.join(sums, by, "full_outer").select(
        *by, F.lit("Total").alias("code"), F.lit("Total").alias("libelle"), F.coalesce("n", F.lit(0)).alias("n"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("globale", "specialisee")],
    )
    return lines.unionByName(total)


def error_activity(records: DataFrame, csarr: DataFrame, csar: DataFrame, das: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Stays, records, diagnoses and acts carried by records in error."""
    by = by or PERIOD
    wrong = records.where(blank_to_null(F.col("indicateur_erreur")).isNotNull())
    base = wrong.groupBy(*by, "numero_admin_sejour").agg(F.count(F.lit(1)).alias("k")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("nb_sejours_erreur"), F.sum("k").alias("nb_rhs_erreur")
    )
    codes = das.where("code_das is not null").select("rhs_id", F.trim("code_das").alias("code")).distinct()
    parts = [
        (children_of(codes, wrong, by), F.count(F.lit(1)), "nb_diag_erreur"),
        (children_of(csarr, wrong, by), F.sum("nombre_realisations"), "nb_csarr_erreur"),
        (children_of(csar, wrong, by), F.sum("nombre_realisations"), "nb_csar_erreur"),
    ]
    out = base
    for rows, agg, name in parts:
        out = out.join(rows.groupBy(*by).agg(agg.alias(name)), by, "left")
    return out.select(*by, "nb_sejours_erreur", "nb_rhs_erreur", *[F.coalesce(n, F.lit(0)).alias(n) for _, _, n in parts])


def records_without_acts(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Stays and records without any act, their days and their share."""
    by = by or PERIOD
    acts = F.coalesce("n2_nb_csarr", F.lit(0))
    per_stay = records.groupBy(*by, "numero_admin_sejour").agg(
        F.sum(acts).alias("acts"), F.count(F.lit(1)).alias("rhs"), F.count_if(acts == 0).alias("rhs0"),
        F.sum(F.when(acts == 0, F.col("n_days")).otherwise(F.lit(0))).alias("days0"),
    )
    return per_stay.groupBy(*by).agg(
        F.count_if(F.col("acts") == 0).alias("nb_ssr_sans_acte"), F.sum("rhs0").alias("nb_rhs_sans_acte"),
        F.sum("days0").alias("nb_jrs_sans_acte"), _ratio(F.sum("rhs0"), F.sum("rhs"), 100.0).alias("pct_rhs_sans_acte"),
    )


def grouping_errors(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct stays and records per grouping-error code."""
    by = by or PERIOD
    rows = records.where(F.coalesce("indicateur_erreur", F.lit("")) != "")
    return rows.groupBy(*by, F.col("indicateur_erreur").alias("code"), "numero_admin_sejour").agg(
        F.count(F.lit(1)).alias("k")
    ).groupBy(*by, "code").agg(F.count(F.lit(1)).alias("nb_ssr"), F.sum("k").alias("nb_rhs"))


def reconciliation(weeks: DataFrame, admin: DataFrame, order: list[str]) -> DataFrame:
    """Stays recorded weekly without an administrative row, or recorded long after their exit."""
    per_stay = weeks.where("numero_admin_sejour is not null").groupBy("finess_epmsi", "numero_admin_sejour").agg(
        F.max("sunday").alias("derniere_semaine"), F.max(F.to_date("date_fin_sejour")).alias("fin")
    ).where("derniere_semaine is not null")
    latest = admin.groupBy("finess_epmsi", "numero_admin_sejour").agg(
        F.max_by(F.struct("date_entree", "date_hospitalisation", "date_sortie", "numero_immatriculation_assure"), F.struct(*order)).alias("v")
    )
    joined = per_stay.join(latest, ["finess_epmsi", "numero_admin_sejour"], "left")
    gap = F.datediff(F.coalesce("fin", "derniere_semaine"), F.to_date("v.date_sortie"))
    finding = F.when(F.col("v").isNull(), F.lit("sans_vid_hosp")).when(gap > GAP_DAYS, F.lit("non_cloture"))
    return joined.withColumn("type", finding).where("type is not null").select(
        "finess_epmsi", "numero_admin_sejour", "type", F.col("v.numero_immatriculation_assure").alias("nir"),
        F.coalesce("v.date_entree", "v.date_hospitalisation").alias("entree"), F.col("v.date_sortie").alias("sortie"),
        F.col("derniere_semaine"),
    )


def stay_groups(records: DataFrame, length: int, by: list[str] | None = None, name: str = "code") -> DataFrame:
    """Group code of each stay's last coded week in the period, cut to a level's length."""
    by = by or PERIOD
    coded = records.where(F.coalesce("code_gme", F.lit("")) != "")
    at = F.struct("week", "source_file", "line_no")
    return coded.groupBy(*by, "stay").agg(F.max_by(F.substring("code_gme", 1, length), at).alias(name))


def _effectif_and_value(groups: DataFrame, amounts: DataFrame, keys: list[str]) -> DataFrame:
    per_stay = amounts.groupBy(*PERIOD, "stay").agg(F.sum("montant_br_sej").alias("montant"))
    return groups.join(per_stay, [*PERIOD, "stay"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("effectif"), F.coalesce(F.sum("montant"), F.lit(0).cast("decimal(18,2)")).alias("valorisation")
    )


def group_ranking(
    records: DataFrame, valuation: DataFrame, weeks: DataFrame, periods: DataFrame, labels: DataFrame,
    kind: str = "CM", top_n: int = 5, by: list[str] | None = None,
) -> DataFrame:
    """Top groups of an establishment over all its periods, with count, value and shares per year.

    Shares are of all groups of the year, not only of the top. Equal counts are ordered by code.
    """
    by = by or PERIOD
    over_years = [k for k in by if k != "iso_year"]
    groups = stay_groups(records, GROUP_LENGTH[kind], by)
    table = _effectif_and_value(groups, comparable_rows(valuation, weeks, periods), [*by, "code"])
    totals = table.groupBy(*over_years, "code").agg(F.sum("effectif").alias("n"))
    top = top_per_group(totals, over_years, [F.col("n").desc(), F.col("code")], top_n, "rang").select(*over_years, "code", "rang")
    year = Window.partitionBy(*by)
    shares = table.withColumns({
        "pct_effectif": _ratio(F.col("effectif"), F.sum("effectif").over(year), 100.0),
        "pct_valorisation": _ratio(F.col("valorisation").cast("double"), F.sum("valorisation").over(year).cast("double"), 100.0),
    })
    names = labels.where(F.col("kind") == kind).select("code", F.coalesce(F.nullif("libelle_long", F.lit("")), F.nullif("libelle_court", F.lit("")), "code").alias("libelle"))
    return shares.join(top, [*over_years, "code"]).join(names, "code", "left").withColumn("libelle", F.coalesce("libelle", "code"))


def group_structure(records: DataFrame, valuation: DataFrame, weeks: DataFrame, periods: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Stays and value by rehabilitation type, heaviness and severity, with a subtotal per block."""
    by = by or PERIOD
    groups = stay_groups(records, 7, by)
    blocks = F.array(*[F.struct(F.lit(b).alias("bloc"), structure_bucket(F.col("code"), b).alias("code")) for b in STRUCTURE_CODES])
    tagged = groups.select(*by, "stay", F.explode(blocks).alias("b")).select(*by, "stay", "b.*")
    cells = _effectif_and_value(tagged, comparable_rows(valuation, weeks, periods), [*by, "bloc", "code"])
    keys = [*by, "bloc", "code"]
    rolled = cells.groupingSets([keys, keys[:-1]], *keys).agg(
        F.sum("effectif").alias("effectif"), F.sum("valorisation").alias("valorisation")
    )
    label = F.lit("Sous-total")
    for block in STRUCTURE_CODES:
        label = F.when((F.col("bloc") == block) & F.col("code").isNotNull(), structure_label(block, F.col("code"))).otherwise(label)
    whole = Window.partitionBy(*by, "bloc")
    def share(name: str) -> Column:
        value = F.col(name).cast("double")
        return _ratio(value, F.max(F.when(F.col("code").isNull(), value)).over(whole), 100.0)
    return rolled.withColumns({
        "libelle": label, "pct_effectif": share("effectif"), "pct_valorisation": share("valorisation"),
    })


def axis_values(records: DataFrame, axis: str) -> DataFrame:
    """Distinct units, or merged hospitalisation types, per establishment."""
    value = hospitalisation_group(F.col(axis)) if axis == "type_hospitalisation" else F.col(axis)
    return records.where(blank_to_null(F.col(axis)).isNotNull()).select("finess_epmsi", value.alias("axis_value")).distinct()
