"""Secondary dashboards (E54): every section by unit, hospitalisation type and user group of units, from one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.bindings import q_dashboard as qd
from wardflow.bindings import q_scores as qs
from wardflow.bindings.oracle import by_axis
from wardflow.bindings.q_valuation import cents, r
from wardflow.bindings.registry import query
from wardflow.bindings.tables import UNIT_GROUPS, Tables
from wardflow.plans import dashboard as dash
from wardflow.plans import scores as sc
from wardflow.plans import valuation as val
from wardflow.plans.valuation import PERIOD

BY = [*PERIOD, *dash.AXES]


def _section(name: str, sql: str):
    return query(f"e54_{name}", by_axis(sql))


@query("e54_stay_activity", qd._ACTIVITY.format(k=", ".join(BY), src="v_axis"))
def _(t: Tables) -> DataFrame:
    return qd._rounded_activity(dash.stay_activity(t.axis_rows, t.weeks, BY))


_PATIENTS = by_axis(qd._PATIENTS.format(where="")).replace(
    "seen as (select * from st where fin >= ps and debut <= pe)",
    f"seen as (select st.*, x.axis, x.axis_value from st join (select distinct {', '.join(BY)}, stay from v_axis) x on x.finess_epmsi = st.finess_epmsi and x.stay = st.stay and x.iso_year = st.iso_year where fin >= ps and debut <= pe)",
)


@query("e54_patients", _PATIENTS)
def _(t: Tables) -> DataFrame:
    return qd._rounded_patients(dash.patients(t.admin, t.periods, t.last_sunday, ["line_no"], t.axis_rows, BY))


@_section("days_per_week", "select finess_epmsi, iso_year, week, cast(sum(n_days) as bigint) nb_journees from v_in_period group by all")
def _(t: Tables) -> DataFrame:
    return dash.days_per_week(t.axis_rows, BY)


@_section("indicators", qd._INDICATORS)
def _(t: Tables) -> DataFrame:
    out = dash.indicators(t.axis_rows, t.csarr, t.csar, t.das, BY)
    return out.withColumns({c: r(c, 6) for c in ("avq_phys_moy", "avq_cogn_moy", "nb_das_moy_rhs", "nb_moy_interv_rhs", "nb_moy_csarr_j")})


@_section("staff_activity", """
select finess_epmsi, iso_year, code_intervenant code, coalesce(any_value(libelle), code_intervenant) libelle, cast(sum(nombre_realisations) as bigint) n
from v_csarr join v_in_period using (rhs_id) left join v_staff_labels l on l.code = code_intervenant where code_intervenant is not null group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    return dash.staff_activity(t.axis_rows, t.csarr, t.staff_labels, BY)


@_section("staff_scores", f"with {qs._ALL} select finess_epmsi, iso_year, code, cast(n as bigint) n, round(globale, 4) globale, round(specialisee, 4) specialisee from sc")
def _(t: Tables) -> DataFrame:
    acts = [dash.children_of(x, t.axis_rows, BY, "stay") for x in (t.csarr, t.csar, t.ccam)]
    out = sc.staff_scores(*acts, dash.stay_groups(t.axis_rows, 4, BY, name="gn"), t.score_tables, BY)
    return out.withColumns({"globale": r("globale", 4), "specialisee": r("specialisee", 4)})


@_section("ignored_acts", f"""
with {qs._TRANS} select finess_epmsi, iso_year, numero_admin_sejour, date_realisation, code_principal code_csar, code_intervenant, case when coll <> 0 then 'Collectif' else 'Individuel' end modalite, cast(coalesce(nullif(nombre_realisations, 0), 1) as int) n
from tx join v_in_period using (rhs_id) where code_csarr is null""")
def _(t: Tables) -> DataFrame:
    acts = dash.children_of(t.csar, t.axis_rows, BY, "numero_admin_sejour")
    return sc.ignored_acts(acts, t.score_tables.transcoding).select(
        *BY, "numero_admin_sejour", "date_realisation", F.col("code_principal").alias("code_csar"), "code_intervenant", "modalite", "n"
    )


@query("e54_value_in_period", """
with d as (select v.*, unit, hosp from v_daily v join v_day_axis a on a.finess_epmsi = v.finess_epmsi and a.stay = v.stay and a."day" = v."day" and billing_case <> 3),
x as (select *, 'unit' axis, unit axis_value from d where coalesce(trim(unit), '') <> '' union all select *, 'hosp', hosp from d where coalesce(trim(hosp), '') <> ''
  union all select d.*, 'group', g.name from d join (values ('court', 'A'), ('court', 'N'), ('retour', 'R'), ('retour', 'N')) g(name, u) on g.u = unit)
select p.finess_epmsi, p.iso_year, axis, axis_value, cast(round(sum(amount), 2) as double) montant_br_pt from x join v_periods p on p.finess_epmsi = x.finess_epmsi and x."day" between p."start" and p."end" group by all""")
def _(t: Tables) -> DataFrame:
    """Days belong to the unit and type of the record that owns them; an amount on the entry date to none."""
    rows = dash.with_axes(t.weekly_value, UNIT_GROUPS, "unit", F.col("hosp"))
    return val.value_in_period(rows, t.periods, dash.AXES).withColumn("montant_br_pt", cents("montant_br_pt"))


def _ranking(t: Tables, kind: str) -> DataFrame:
    out = dash.group_ranking(t.axis_rows, t.valuation, t.weeks, t.periods, t.groups, kind, by=BY)
    return out.withColumns({"valorisation": F.col("valorisation").cast("double"), "pct_effectif": r("pct_effectif", 6), "pct_valorisation": r("pct_valorisation", 6)})


@_section("ranking_cm", qd._RANK.format(n=2, kind="CM"))
def _(t: Tables) -> DataFrame:
    return _ranking(t, "CM")


@_section("ranking_gn", qd._RANK.format(n=4, kind="GN"))
def _(t: Tables) -> DataFrame:
    return _ranking(t, "GN")


@_section("group_structure", qd._STRUCTURE)
def _(t: Tables) -> DataFrame:
    out = dash.group_structure(t.axis_rows, t.valuation, t.weeks, t.periods, BY)
    return out.withColumns({"valorisation": F.col("valorisation").cast("double"), "pct_effectif": r("pct_effectif", 6), "pct_valorisation": r("pct_valorisation", 6)})


@_section("error_activity", qd._ERRORS)
def _(t: Tables) -> DataFrame:
    return dash.error_activity(t.axis_rows, t.csarr, t.csar, t.das, BY)


@_section("records_without_acts", qd._WITHOUT)
def _(t: Tables) -> DataFrame:
    return dash.records_without_acts(t.axis_rows, BY).withColumn("pct_rhs_sans_acte", r("pct_rhs_sans_acte", 6))


@_section("grouping_errors", """
select finess_epmsi, iso_year, indicateur_erreur code, count(distinct numero_admin_sejour) nb_ssr, count(*) nb_rhs from v_in_period where coalesce(indicateur_erreur, '') <> '' group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    return dash.grouping_errors(t.axis_rows, BY)
