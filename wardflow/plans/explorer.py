"""Explorer: sources with dimensions, filtered lists, value lists, stay sheets."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions import calendar as cal
from wardflow.functions import derive as d
from wardflow.functions import mergeable as mg
from wardflow.functions.mergeable import Calculated
from wardflow.operators.allocation import with_share
from wardflow.operators.crossgrain import keep_if_any_match, match_other_source
from wardflow.operators.hierarchy import with_prefix_label
from wardflow.operators.pivot import PivotMeasure, hide_empty, pivot
from wardflow.plans import periods as per


@dataclass
class Source:
    """Rows of one file family with named dimensions and measures.

    ``period`` says how rows are restricted to periods: week, dates or campaign.
    """

    name: str
    rows: DataFrame
    period: str
    dims: dict[str, Column] = field(default_factory=dict)
    measures: dict[str, Column] = field(default_factory=dict)
    calculated: dict[str, Calculated] = field(default_factory=dict)

    def in_periods(self, periods: DataFrame) -> Source:
        restrict: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
            "week": per.weeks_in_period, "dates": per.stays_in_period, "campaign": per.campaigns_in_period,
        }
        return replace(self, rows=restrict[self.period](self.rows, periods))

    def filtered(self, condition: Column) -> Source:
        return replace(self, rows=self.rows.where(condition))

    def filtered_by(self, other: Source, condition: Column) -> Source:
        """Rows of stays with any matching row in another source."""
        rows = keep_if_any_match(self.rows, other.rows, ["finess_epmsi", "stay"], condition)
        return replace(self, rows=rows)

    def calculating(self, **measures: Calculated) -> Source:
        """The source with further calculated measures."""
        return replace(self, calculated=self.calculated | measures)

    def shown(self, *dims: str) -> DataFrame:
        """Rows plus the display value of the asked dimensions."""
        return self.rows.withColumns({f"d_{x}": d.shown(self.dims[x]) for x in dims})

    def pivot(
        self, rows: list[str], cols: list[str], measures: list[tuple[str, str]],
        row_subtotals: bool = False, col_subtotals: bool = False, skip_empty: bool = False,
    ) -> DataFrame:
        """Pivot over named dimensions; ``measures`` are (measure, how), with ``calc`` for a calculated one, under its own name."""
        r, c = [f"d_{x}" for x in rows], [f"d_{x}" for x in cols]
        data = self.shown(*rows, *cols)
        if skip_empty:
            data = hide_empty(data, r + c)
        asked = [PivotMeasure(m, how, self.calculated[m]) if how == "calc" else PivotMeasure(f"{m}_{how}", how, self.measures[m]) for m, how in measures]
        return pivot(data, r, c, asked, row_subtotals, col_subtotals)


def records_with_labels(
    records: DataFrame, groups: DataFrame, errors: DataFrame, diagnoses: DataFrame
) -> DataFrame:
    """Weekly records with the labels of their group levels, grouping error and two diagnoses."""
    out = records
    for kind, length, name in (("GME", 7, "lib_gme"), ("GN", 4, "lib_gn"), ("CM", 2, "lib_cm")):
        labels = groups.where(F.col("kind") == kind).select(F.col("code").alias(f"_{kind}"), F.col("libelle_long").alias(name))
        out = out.join(labels, F.substring("code_gme", 1, length) == F.col(f"_{kind}"), "left").drop(f"_{kind}")
    err = errors.select(F.col("code").alias("_e"), F.col("libelle").alias("lib_erreur"), F.col("type").alias("type_erreur"))
    out = out.join(err, d.error_code(F.col("code_retour_groupage")) == F.col("_e"), "left").drop("_e")
    for column, name in (("manifestation_morbide_principale", "lib_dp"), ("affection_etiologique", "lib_ae")):
        labels = diagnoses.select(F.col("code").alias("_d"), F.col("libelle_complet").alias(name))
        out = out.join(labels, F.col(column) == F.col("_d"), "left").drop("_d")
    return out


def acts_with_headings(acts: DataFrame, catalogue: DataFrame, headings: DataFrame) -> DataFrame:
    """CSARR acts with label, chapter (two characters) and sub-chapter (five) of their heading."""
    labels = catalogue.select(F.col("code").alias("code_principal"), F.col("libelle").alias("lib_csarr"), "parent_code")
    out = acts.join(labels, "code_principal", "left")
    out = with_prefix_label(out, headings, "parent_code", 2, "chapitre", "csarr_chapitre")
    return with_prefix_label(out, headings, "parent_code", 5, "sous_chapitre", "csarr_sous_chapitre")


def diagnosis_source(records: DataFrame, das: DataFrame) -> DataFrame:
    """The three diagnosis roles under one another, tagged."""
    keep = ["finess_epmsi", "numero_admin_sejour", "stay", "numero_semaine", "iso_year", "week", "type_hospitalisation"]
    def role(name: str, column: str) -> DataFrame:
        return records.where(d.blank_to_null(F.col(column)).isNotNull()).select(
            *keep, F.lit(name).alias("type_diag"), F.col(column).alias("code_diag")
        )
    associated = das.join(records.select("rhs_id", *keep), "rhs_id").select(
        *keep, F.lit("DAS").alias("type_diag"), F.col("code_das").alias("code_diag")
    )
    return role("MMP", "manifestation_morbide_principale").unionByName(role("AE", "affection_etiologique")).unionByName(associated)


def act_source(records: DataFrame, csarr: DataFrame, csar: DataFrame, ccam: DataFrame) -> DataFrame:
    """The three act nomenclatures under one another, tagged; the union is joined to its records once."""
    def acts(df: DataFrame, name: str, code: str) -> DataFrame:
        return df.select("rhs_id", F.lit(name).alias("type_acte"), F.col(code).alias("code_acte"), "date_realisation", "nombre_realisations")
    union = acts(csarr, "CSARR", "code_principal").unionByName(acts(csar, "CSAR", "code_principal")).unionByName(acts(ccam, "CCAM", "code_ccam"))
    keep = ["finess_epmsi", "numero_admin_sejour", "stay", "numero_semaine", "iso_year", "week", "type_hospitalisation"]
    return union.join(records.select("rhs_id", *keep), "rhs_id").drop("rhs_id")


def record_source(records: DataFrame) -> Source:
    """Weekly records with their dimensions and measures."""
    parts = d.group_parts(F.col("code_gme"))
    label, _ = cal.week_dimension(F.col("numero_semaine"))
    age = d.age_years(F.to_date("date_naissance"), F.to_date("date_debut_sejour"))
    dims = {
        "finess": F.col("finess_epmsi"), "nda": F.col("numero_admin_sejour"),
        "sexe": d.code_label("sexe", F.col("sexe")),
        "type_hosp": d.code_label("type_hospitalisation", F.col("type_hospitalisation")),
        "tranche_age": d.age_band(age), "departement": d.department(F.col("code_postal_residence")),
        "annee_periode": F.col("iso_year"), "semaine": label, "gme": F.col("code_gme"), **parts,
        "erreur": F.col("code_retour_groupage"), "mmp": F.col("manifestation_morbide_principale"),
        "ae": F.col("affection_etiologique"), "unite_medicale": F.col("numero_unite_medicale"),
        **cal.date_dimensions(F.to_date("date_debut_sejour"), "date_debut_sejour"),
    }
    dependence = [f"dependance_{x}" for x in ("habillage_toilette", "deplacement", "alimentation", "continence", "comportement", "relation")]
    measures = {
        "nb_rhs": F.lit(1), "nb_sejours": F.struct("finess_epmsi", "numero_admin_sejour"), "nb_journees": F.col("n_days"),
        "avq_phys": d.sum_of_known(*[F.col(x) for x in dependence[:4]]),
        "avq_cogn": d.sum_of_known(*[F.col(x) for x in dependence[4:]]),
        "nb_das": F.col("n1_nb_das"), "nb_csarr": F.col("n2_nb_csarr"), "nb_csar": F.col("n3_nb_csar"), "nb_ccam": F.col("n4_nb_ccam"),
        **{x: F.col(x).try_cast("double") for x in dependence},
    }
    return Source("rhs", records, "week", dims, measures)


def admin_source(admin: DataFrame) -> Source:
    """Administrative stays; amounts are stored in cents."""
    age = d.age_years(F.to_date("date_naissance_beneficiaire"), F.to_date("date_entree"))
    dims = {
        "finess": F.col("finess_epmsi"), "nda": F.col("numero_admin_sejour"), "sexe_b": F.col("sexe_beneficiaire"),
        "tranche_age": d.age_band(age),
        **cal.date_dimensions(F.to_date("date_entree"), "date_entree"),
        **cal.date_dimensions(F.to_date("date_sortie"), "date_sortie"),
    }
    measures = {
        "nb_lignes": F.lit(1), "nb_patients": F.col("numero_ipp"), "age_moyen": age,
        "mnt_tm": d.from_cents(F.col("montant_facturer_tm")),
    }
    return Source("vidhosp", admin, "dates", dims, measures)


def valuation_source(valuation: DataFrame) -> Source:
    """Valuation rows in the official amount."""
    dims = {
        "finess": F.col("finess_epmsi"), "nda": F.col("numero_admin_sejour"), "campagne": F.col("campagne"),
        "type_hosp": d.code_label("type_hospitalisation_valo", F.col("type_hospitalisation")),
        "gme": F.col("code_gme"), **{k: v for k, v in d.group_parts(F.col("code_gme")).items() if k != "gl"},
    }
    amounts = ["montant_br_tot", "montant_br_sej", "montant_br_gmt", "montant_br_gmth", "montant_br_trans", "montant_am_med", "montant_br_supp_cancero"]
    measures = {"nb_lignes": F.lit(1), "nb_sejours": F.struct("finess_epmsi", "stay"), **{a: F.col(a) for a in amounts}}
    return Source("valo", valuation.where(d.official_amount_rows()), "campaign", dims, measures)


def child_source(name: str, records: DataFrame, children: DataFrame, code: str, count: str | None = None) -> Source:
    """Rows of one block (diagnoses or acts of one nomenclature) with the dimensions of their records."""
    keep = ["finess_epmsi", "numero_admin_sejour", "stay", "numero_semaine", "iso_year", "week", "numero_unite_medicale", "type_hospitalisation", "code_gme", "sexe"]
    return act_rows_source(name, children.join(records.select("rhs_id", *keep), "rhs_id"), code, count)


def act_rows_source(name: str, rows: DataFrame, code: str, count: str | None = None) -> Source:
    """A source over rows that carry their record's columns: a block, or a union of blocks."""
    label, _ = cal.week_dimension(F.col("numero_semaine"))
    dims = {
        "finess": F.col("finess_epmsi"), "nda": F.col("numero_admin_sejour"), "annee_periode": F.col("iso_year"), "semaine": label, "code": F.col(code),
        "type_hosp": d.code_label("type_hospitalisation", F.col("type_hospitalisation")),
    }
    extra = {"unite_medicale": F.col("numero_unite_medicale"), "sexe": d.code_label("sexe", F.col("sexe")), "type": F.col(f"type_{name}")}
    needs = {"unite_medicale": "numero_unite_medicale", "sexe": "sexe", "type": f"type_{name}"}
    dims |= {k: v for k, v in extra.items() if needs[k] in rows.columns}
    if "code_gme" in rows.columns:
        dims |= d.group_parts(F.col("code_gme"))
    measures = {"nb_lignes": F.lit(1), "nb_sejours": F.struct("finess_epmsi", "stay")} | ({"nb_realisations": F.col(count)} if count else {})
    return Source(name, rows, "week", dims, measures)


def with_valuation(base: Source, valuation: DataFrame, amounts: list[str], weight: str = "n_days") -> Source:
    """Records with measures of the valuation: ``valo_<amount>`` counts a billed row once in every cell and total, and
    ``jours_<amount>`` spreads it over the records in proportion to their days, so that cells add up to totals.
    """
    rows = valuation.where(d.official_amount_rows()).withColumn("htp", F.col("numero_semaine_htp").try_cast("int"))
    order = ["numero_rha", "campagne"]
    linked = match_other_source(base.rows, rows, ["finess_epmsi", "stay"], "iso_year", "week", "campagne", "htp", order, [*order, *amounts])
    owners = ["finess_epmsi", "stay", *[f"o_{c}" for c in order]]
    known = reduce(lambda a, b: a & b, [F.col(o).isNotNull() for o in owners])
    shared = with_share(linked.where(~F.col("matched") | known), owners, weight, ["iso_year", "week", "line_no"], "_share")
    both = shared.withColumns({f"jours_{a}": F.col(f"o_{a}") * F.col("_share") for a in amounts})
    owner = F.when(F.col("matched"), F.struct(*owners))
    measures = {f"valo_{a}": mg.once(F.col(f"o_{a}"), owner) for a in amounts} | {f"jours_{a}": mg.total_known(F.col(f"jours_{a}").cast("decimal(18,6)")) for a in amounts}
    return replace(base, rows=both).calculating(**measures)


def with_stays(base: Source, admin: DataFrame, amounts: dict[str, Column], order: list[str]) -> Source:
    """Any source with measures of the administrative stays: ``vidhosp_<name>`` counts a stay once in every cell and total."""
    key = ["finess_epmsi", "stay"]
    packed = F.struct(*[v.alias(f"v_{n}") for n, v in amounts.items()])
    first = admin.groupBy(*key).agg(F.min_by(packed, F.struct(*order)).alias("_v"))
    rows = base.rows.join(first, key, "left")
    owner = F.when(F.col("_v").isNotNull(), F.struct(*key))
    return replace(base, rows=rows).calculating(**{f"vidhosp_{n}": mg.once(F.col("_v")[f"v_{n}"], owner) for n in amounts})


def value_list(rows: DataFrame, code: Column, label: Column | None = None, cap: int | None = None) -> DataFrame:
    """Distinct values with their label, sorted; at most ``cap`` if one is given."""
    shown = rows.select(d.shown(code, mode="code").alias("valeur"), *([label.alias("libelle")] if label is not None else []))
    ordered = shown.distinct().orderBy("valeur")
    return ordered if cap is None else ordered.limit(cap)


def filtered_list(rows: DataFrame, columns: Iterable[str], order: list[Column], cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows in order, one-row total); at most ``cap`` rows if one is given, the total counts all."""
    ordered = rows.select(*columns).orderBy(*order)
    return ordered if cap is None else ordered.limit(cap), rows.agg(F.count(F.lit(1)).alias("total"))


def stay_sheet(
    stays: DataFrame, weeks: DataFrame, admin: DataFrame, valuation: DataFrame, children: dict[str, DataFrame]
) -> DataFrame:
    """Everything known of the chosen stays (finess_epmsi, stay): header, weeks, children, valuation.

    The choice is applied to every table before anything is put together.
    """
    key = ["finess_epmsi", "stay"]
    chosen = weeks.join(stays, key, "left_semi")
    week = F.struct("numero_semaine", "numero_unite_medicale", "flags", "n_days", "code_gme")
    out = stays.join(
        chosen.groupBy(*key).agg(
            F.array_sort(F.collect_list(F.struct("iso_year", "week", "numero_unite_medicale", week.alias("record")))).alias("weeks"),
            F.sum("n_days").alias("n_days"),
        ), key, "left",
    )
    for name, child in children.items():
        rows = child.join(chosen.select("rhs_id", *key), "rhs_id")
        out = out.join(rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*child.columns))).alias(name)), key, "left")
    heads = admin.join(stays, key, "left_semi").select(*key, F.struct("date_entree", "date_sortie", "numero_ipp").alias("admin"))
    money = valuation.join(stays, key, "left_semi").groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("campagne", "numero_rha", "montant_br_sej"))).alias("valuation"),
        F.sum("montant_br_sej").alias("montant_br_sej"),
    )
    return out.join(heads, key, "left").join(money, key, "left")
