"""Dashboard section queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.bindings.q_valuation import r, text
from wardflow.bindings.registry import query
from wardflow.bindings.tables import UNIT_GROUPS, Tables
from wardflow.functions import calendar as cal
from wardflow.functions.filters import ExclusionRule, axis_filter, keep_rows
from wardflow.operators.latest import copy_over_group
from wardflow.plans import dashboard as dash
from wardflow.plans import periods as per
from wardflow.sources import nomenclatures as nom

P = ["finess_epmsi", "iso_year"]


@query("e28_reporting_periods", """
select finess_epmsi, iso_year, cast(max_week as int) max_week, cast("start" as varchar) "start", cast("end" as varchar) "end", "month" from v_periods""")
def _(t: Tables) -> DataFrame:
    return t.periods.select(*P, "max_week", text("start").alias("start"), text("end").alias("end"), F.col("month").cast("bigint").alias("month"))


@query("e28_periods_chosen", """
select y.finess_epmsi, y.iso_year, cast(max(c.week) as int) max_week from v_year_weeks y join v_calendar c on c.iso_year = y.iso_year and c.mo = 6
where y.iso_year in (1998, 2000) and first_week <= 2 group by 1, 2""")
def _(t: Tables) -> DataFrame:
    return per.reporting_periods(t.weeks, years=[1998, 2000], month=6).select(*P, "max_week")


@query("c8_custom_periods", """
with y as (select distinct finess_epmsi, iso_year from v_weeks),
w as (select *, case when isoyear(make_date(iso_year, 1, 3)) = iso_year then week(make_date(iso_year, 1, 3)) end a, case when isoyear(make_date(iso_year, 9, 15)) = iso_year then week(make_date(iso_year, 9, 15)) end b from y)
select finess_epmsi, iso_year, cast(a as int) min_week, cast(b as int) max_week from w where a <= b""")
def _(t: Tables) -> DataFrame:
    return per.custom_periods(t.weeks, (3, 1), (15, 9)).select(*P, "min_week", "max_week")


@query("c7_last_week_of_month", """
select iso_year, "month", cast(max(c.week) as int) last_week from (select distinct cast(year(l_shipdate) as int) iso_year, cast(month(l_shipdate) as int) "month" from lineitem) m
join v_calendar c using (iso_year) where c.mo = m."month" group by 1, 2""")
def _(t: Tables) -> DataFrame:
    months = t.raw("lineitem").select(F.year("l_shipdate").alias("iso_year"), F.month("l_shipdate").alias("month")).distinct()
    return months.withColumn("last_week", cal.last_week_of_month(F.col("iso_year"), F.col("month")))


@query("c9_weeks_in_period", "select rhs_id, iso_year, cast(week as int) AS week from v_in_period")
def _(t: Tables) -> DataFrame:
    return t.in_period.select("rhs_id", "iso_year", "week")


@query("c10_c12_stays_in_period", """
select a.finess_epmsi, a.stay, min(p.iso_year) periode_annee from v_admin a join v_periods p on p.finess_epmsi = a.finess_epmsi
  and cast(date_entree as date) <= p."end" and (date_sortie is null or cast(date_sortie as date) >= p."start") group by 1, 2""")
def _(t: Tables) -> DataFrame:
    return per.stays_in_period(t.admin, t.periods).select("finess_epmsi", "stay", "periode_annee")


@query("c11_campaigns_in_period", """
select v.finess_epmsi, campagne, count(*) n from v_valuation v where exists (select 1 from v_periods p where p.finess_epmsi = v.finess_epmsi and p.iso_year = v.campagne) group by 1, 2""")
def _(t: Tables) -> DataFrame:
    return per.campaigns_in_period(t.valuation, t.periods).groupBy("finess_epmsi", "campagne").agg(F.count(F.lit(1)).alias("n"))


@query("c13_axis_filter", """
select finess_epmsi, count(*) filter (type_hospitalisation in ('2', '3')) n_htp, count(*) filter (numero_unite_medicale = 'A') n_a, count(*) filter (numero_unite_medicale in ('A', 'R')) n_ar from v_in_period group by 1""")
def _(t: Tables) -> DataFrame:
    return t.in_period.groupBy("finess_epmsi").agg(
        F.count_if(axis_filter("type_hospitalisation", "2")).alias("n_htp"), F.count_if(axis_filter("numero_unite_medicale", "A")).alias("n_a"),
        F.count_if(axis_filter("numero_unite_medicale", ["R", "A"])).alias("n_ar"),
    )


@query("c14_exclusion_rules", """
select finess_epmsi, iso_year, version_format_rhs_groupe, count(*) n from v_weeks
where not (finess_epmsi = '680000003' and iso_year = 1998 and version_format_rhs_groupe in ('M1C', 'M1B')) and not (finess_epmsi = '680000001' and iso_year = 1995) group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    rules = [ExclusionRule("680000003", 1998, ("M1C", "M1B")), ExclusionRule("680000001", 1995)]
    return t.weeks.where(keep_rows(rules)).groupBy(*P, "version_format_rhs_groupe").agg(F.count(F.lit(1)).alias("n"))


_ACTIVITY = """
with whole as (select finess_epmsi, numero_admin_sejour, sum(n_days) all_days from v_weeks group by 1, 2),
s as (select {k}, numero_admin_sejour, count(*) rhs, sum(n_days) AS nd, count(*) filter (coalesce(trim(indicateur_erreur), '') = '') ok from {src} group by all),
w as (select {k}, count(distinct numero_semaine) nb_semaines from {src} group by all)
select {k}, count(*) nb_ssr, cast(sum(rhs) as bigint) nb_rhs, cast(sum(nd) as bigint) nb_journees, cast(sum(all_days) as bigint) nb_journees_pleines, any_value(nb_semaines) nb_semaines,
  round(sum(nd) / count(*), 6) dmh, round(sum(all_days) / count(*), 6) dms_vraie, round(sum(nd) / (any_value(nb_semaines) * 7), 6) nb_lits_moy, round(100.0 * sum(ok) / sum(rhs), 6) exh
from s join whole using (finess_epmsi, numero_admin_sejour) join w using ({k}) group by {k}"""


def _rounded_activity(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r(c, 6) for c in ("dmh", "dms_vraie", "nb_lits_moy", "exh")})


@query("e1_e2_stay_activity", _ACTIVITY.format(k="finess_epmsi, iso_year", src="v_in_period"))
def _(t: Tables) -> DataFrame:
    return _rounded_activity(dash.stay_activity(t.in_period, t.weeks))


_AXIS = "(select *, numero_unite_medicale axis_value from v_in_period)"
_GROUP_AXIS = "(select *, g.axis_value from v_in_period join (values ('court', 'A'), ('court', 'N'), ('retour', 'R'), ('retour', 'N')) g(axis_value, u) on u = numero_unite_medicale)"


@query("e54_activity_per_unit", _ACTIVITY.format(k="finess_epmsi, iso_year, axis_value", src=_AXIS))
def _(t: Tables) -> DataFrame:
    rows = dash.with_axis(t.in_period, "numero_unite_medicale")
    return _rounded_activity(dash.stay_activity(rows, t.weeks, [*P, "axis_value"]))


@query("e54_activity_per_unit_group", _ACTIVITY.format(k="finess_epmsi, iso_year, axis_value", src=_GROUP_AXIS))
def _(t: Tables) -> DataFrame:
    rows = dash.with_axis(t.in_period, "numero_unite_medicale", UNIT_GROUPS)
    return _rounded_activity(dash.stay_activity(rows, t.weeks, [*P, "axis_value"]))


_PATIENTS = """
with st as (select a.*, greatest(coalesce(cast(date_sortie as date), p."end"), last_sunday, cast(coalesce(date_entree, date_hospitalisation) as date)) fin, cast(coalesce(date_entree, date_hospitalisation) as date) debut, p.iso_year, p."start" ps, p."end" pe,
    date_diff('day', cast(date_naissance_beneficiaire as date), cast(date_entree as date)) / 365.25 age
  from v_admin a left join (select finess_epmsi, stay, max(sunday) last_sunday from v_weeks group by 1, 2) l using (finess_epmsi, stay) join v_periods p on p.finess_epmsi = a.finess_epmsi {where}),
seen as (select * from st where fin >= ps and debut <= pe),
pat as (select finess_epmsi, iso_year, numero_ipp, arg_min(sexe_beneficiaire, line_no) s from seen group by all),
h as (select finess_epmsi, iso_year, count(*) filter (s = '2') f, count(*) filter (s = '1') m from pat group by all),
g as (select finess_epmsi, iso_year, avg(age) filter (sexe_beneficiaire = '2') age_f, avg(age) filter (sexe_beneficiaire = '1') age_m, avg(age) filter (sexe_beneficiaire in ('1', '2')) age_total from seen group by all)
select finess_epmsi, iso_year, f, m, f + m total, round(100.0 * f / (f + m), 6) pct_f, round(100.0 * m / (f + m), 6) pct_m, round(age_f, 6) age_f, round(age_m, 6) age_m, round(age_total, 6) age_total from h join g using (finess_epmsi, iso_year)"""


def _rounded_patients(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r(c, 6) for c in ("pct_f", "pct_m", "age_f", "age_m", "age_total")})


@query("e3_d9_patients", _PATIENTS.format(where=""))
def _(t: Tables) -> DataFrame:
    return _rounded_patients(dash.patients(t.admin, t.periods, t.last_sunday, ["line_no"]))


@query("d8_patients_of_unit", _PATIENTS.format(where="where exists (select 1 from v_in_period w where w.finess_epmsi = a.finess_epmsi and w.stay = a.stay and w.numero_unite_medicale = 'A')"))
def _(t: Tables) -> DataFrame:
    stays = t.in_period.where(axis_filter("numero_unite_medicale", "A")).select("finess_epmsi", "stay")
    return _rounded_patients(dash.patients(t.admin, t.periods, t.last_sunday, ["line_no"], stays))


@query("e4_days_per_week", "select finess_epmsi, iso_year, week, cast(sum(n_days) as bigint) nb_journees from v_in_period group by all")
def _(t: Tables) -> DataFrame:
    return dash.days_per_week(t.in_period)


_INDICATORS = """
with b as (select finess_epmsi, iso_year, count(*) nb_rhs, sum(n_days) nb_journees, avg(n1_nb_das) nb_das_moy_rhs,
    avg(case when coalesce(dependance_habillage_toilette, dependance_deplacement, dependance_alimentation, dependance_continence) is not null then coalesce(cast(dependance_habillage_toilette as int), 0) + coalesce(cast(dependance_deplacement as int), 0) + coalesce(cast(dependance_alimentation as int), 0) + coalesce(cast(dependance_continence as int), 0) end) avq_phys_moy,
    avg(case when coalesce(dependance_comportement, dependance_relation) is not null then coalesce(cast(dependance_comportement as int), 0) + coalesce(cast(dependance_relation as int), 0) end) avq_cogn_moy
  from v_in_period group by 1, 2),
k as (select rhs_id, nombre_realisations from v_csarr qualify row_number() over (partition by rhs_id, code_principal, code_modulateur_lieu, code_intervenant, nombre_realisations, nombre_reel_patients, date_realisation order by seq) <= 2
  union all select rhs_id, nombre_realisations from v_csar qualify row_number() over (partition by rhs_id, code_principal, code_modulateur_lieu, code_modulateur_temps, code_intervenant, modalite_collective, nombre_realisations, date_realisation order by seq) <= 2),
a as (select finess_epmsi, iso_year, cast(sum(nombre_realisations) as bigint) n from k join v_in_period using (rhs_id) group by 1, 2),
d as (select finess_epmsi, iso_year, count(distinct rhs_id || '|' || trim(code_das)) n from v_das join v_in_period using (rhs_id) group by 1, 2)
select finess_epmsi, iso_year, round(avq_phys_moy, 6) avq_phys_moy, round(avq_cogn_moy, 6) avq_cogn_moy, coalesce(a.n, 0) nb_csarr, coalesce(d.n, 0) nb_diag_approx, round(nb_das_moy_rhs, 6) nb_das_moy_rhs,
  round(coalesce(a.n, 0) / nb_rhs, 6) nb_moy_interv_rhs, round(coalesce(a.n, 0) / nb_journees, 6) nb_moy_csarr_j from b left join a using (finess_epmsi, iso_year) left join d using (finess_epmsi, iso_year)"""


@query("e5_indicators", _INDICATORS)
def _(t: Tables) -> DataFrame:
    out = dash.indicators(t.in_period, t.csarr, t.csar, t.das)
    return out.withColumns({c: r(c, 6) for c in ("avq_phys_moy", "avq_cogn_moy", "nb_das_moy_rhs", "nb_moy_interv_rhs", "nb_moy_csarr_j")})


@query("e6_staff_activity", """
select finess_epmsi, iso_year, code_intervenant code, coalesce(any_value(libelle), code_intervenant) libelle, cast(sum(nombre_realisations) as bigint) n
from v_csarr join v_in_period using (rhs_id) left join v_staff_labels l on l.code = code_intervenant where code_intervenant is not null group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    return dash.staff_activity(t.in_period, t.csarr, t.staff_labels)


_ERRORS = """
with w as (select * from v_in_period where coalesce(trim(indicateur_erreur), '') <> ''),
b as (select finess_epmsi, iso_year, count(distinct numero_admin_sejour) s, count(*) n from w group by 1, 2),
d as (select finess_epmsi, iso_year, count(distinct rhs_id || '|' || trim(code_das)) n from v_das join w using (rhs_id) group by 1, 2),
a as (select finess_epmsi, iso_year, cast(sum(nombre_realisations) as bigint) n from v_csarr join w using (rhs_id) group by 1, 2),
c as (select finess_epmsi, iso_year, cast(sum(nombre_realisations) as bigint) n from v_csar join w using (rhs_id) group by 1, 2)
select b.finess_epmsi, b.iso_year, s nb_sejours_erreur, b.n nb_rhs_erreur, coalesce(d.n, 0) nb_diag_erreur, coalesce(a.n, 0) nb_csarr_erreur, coalesce(c.n, 0) nb_csar_erreur
from b left join d using (finess_epmsi, iso_year) left join a using (finess_epmsi, iso_year) left join c using (finess_epmsi, iso_year)"""


@query("e12_error_activity", _ERRORS)
def _(t: Tables) -> DataFrame:
    return dash.error_activity(t.in_period, t.csarr, t.csar, t.das)


_WITHOUT = """
with s as (select finess_epmsi, iso_year, numero_admin_sejour, sum(n2_nb_csarr) a, count(*) rhs, count(*) filter (n2_nb_csarr = 0) r0, coalesce(sum(n_days) filter (n2_nb_csarr = 0), 0) d0 from v_in_period group by 1, 2, 3)
select finess_epmsi, iso_year, count(*) filter (a = 0) nb_ssr_sans_acte, cast(sum(r0) as bigint) nb_rhs_sans_acte, cast(sum(d0) as bigint) nb_jrs_sans_acte, round(100.0 * sum(r0) / sum(rhs), 6) pct_rhs_sans_acte from s group by 1, 2"""


@query("e13_records_without_acts", _WITHOUT)
def _(t: Tables) -> DataFrame:
    return dash.records_without_acts(t.in_period).withColumn("pct_rhs_sans_acte", r("pct_rhs_sans_acte", 6))


@query("e14_grouping_errors", """
select finess_epmsi, iso_year, indicateur_erreur code, count(distinct numero_admin_sejour) nb_ssr, count(*) nb_rhs from v_in_period where coalesce(indicateur_erreur, '') <> '' group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    return dash.grouping_errors(t.in_period)


@query("d15_reconciliation", """
with w as (select finess_epmsi, numero_admin_sejour, max(sunday) derniere_semaine, max(cast(date_fin_sejour as date)) fin from v_weeks group by 1, 2)
select w.finess_epmsi, w.numero_admin_sejour, case when a.stay is null then 'sans_vid_hosp' else 'non_cloture' end "type", numero_immatriculation_assure nir, coalesce(date_entree, date_hospitalisation) entree, date_sortie sortie, cast(derniere_semaine as varchar) derniere_semaine
from w left join v_admin a using (finess_epmsi, numero_admin_sejour) where a.stay is null or date_diff('day', cast(date_sortie as date), coalesce(fin, derniere_semaine)) > 21""")
def _(t: Tables) -> DataFrame:
    return dash.reconciliation(t.weeks, t.admin, ["line_no"]).withColumn("derniere_semaine", text("derniere_semaine"))


@query("f2_stay_group", "select finess_epmsi, iso_year, stay, substr(code, 1, 4) code from v_stay_code")
def _(t: Tables) -> DataFrame:
    return dash.stay_groups(t.in_period, 4)


_RANK = """
with st as (select finess_epmsi, iso_year, stay, substr(code, 1, {n}) code from v_stay_code),
v as (select finess_epmsi, iso_year, stay, sum(montant_br_sej) m from v_comparable group by 1, 2, 3),
c as (select finess_epmsi, iso_year, code, count(*) effectif, cast(coalesce(sum(m), 0) as double) valorisation from st left join v using (finess_epmsi, iso_year, stay) group by 1, 2, 3),
t as (select finess_epmsi, code, row_number() over (partition by finess_epmsi order by sum(effectif) desc, code) rang from c group by 1, 2 qualify rang <= 5),
s as (select *, 100.0 * effectif / sum(effectif) over y pe, 100.0 * valorisation / nullif(sum(valorisation) over y, 0) pv from c window y as (partition by finess_epmsi, iso_year))
select s.finess_epmsi, s.iso_year, s.code, cast(rang as int) rang, effectif, valorisation, round(pe, 6) pct_effectif, round(coalesce(pv, 0), 6) pct_valorisation, coalesce(nullif(libelle_long, ''), nullif(libelle_court, ''), s.code) libelle
from s join t using (finess_epmsi, code) left join v_groups g on g.code = s.code and g.kind = '{kind}'"""


def _ranking(t: Tables, kind: str) -> DataFrame:
    out = dash.group_ranking(t.in_period, t.valuation, t.weeks, t.periods, t.groups, kind)
    return out.withColumns({"valorisation": F.col("valorisation").cast("double"), "pct_effectif": r("pct_effectif", 6), "pct_valorisation": r("pct_valorisation", 6)})


@query("e26_ranking_cm", _RANK.format(n=2, kind="CM"))
def _(t: Tables) -> DataFrame:
    return _ranking(t, "CM")


@query("e26_ranking_gn", _RANK.format(n=4, kind="GN"))
def _(t: Tables) -> DataFrame:
    return _ranking(t, "GN")


@query("g4_top_codes", """
select finess_epmsi, substr(code, 1, 2) code, count(*) n, cast(row_number() over (partition by finess_epmsi order by count(*) desc, substr(code, 1, 2)) as int) rang from v_stay_code group by 1, 2 qualify rang <= 3""")
def _(t: Tables) -> DataFrame:
    from wardflow.operators.ordered import top_per_group

    totals = dash.stay_groups(t.in_period, 2).groupBy("finess_epmsi", "code").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(totals, ["finess_epmsi"], [F.col("n").desc(), F.col("code")], 3, "rang")


_STRUCTURE = """
with st as (select *, case when substr(code, 5, 1) in ('P', 'S', 'T', 'U', 'H', 'I', 'J', 'K', 'L') then 1 end okg from v_stay_code),
b as (select finess_epmsi, iso_year, stay, 'gr' bloc, case when okg = 1 then substr(code, 5, 1) else 'ERR' end c from st
  union all select finess_epmsi, iso_year, stay, 'gl', case when okg = 1 and substr(code, 6, 1) in ('A', 'B', 'C') then substr(code, 6, 1) else 'ERR' end from st
  union all select finess_epmsi, iso_year, stay, 'sev', case when okg = 1 and substr(code, 7, 1) in ('0', '1', '2') then substr(code, 7, 1) else 'ERR' end from st),
v as (select finess_epmsi, iso_year, stay, sum(montant_br_sej) m from v_comparable group by 1, 2, 3),
k as (select finess_epmsi, iso_year, bloc, c code, count(*) effectif, cast(coalesce(sum(m), 0) as double) valorisation from b left join v using (finess_epmsi, iso_year, stay) group by 1, 2, 3, 4
  union all select finess_epmsi, iso_year, bloc, null, count(*), cast(coalesce(sum(m), 0) as double) from b left join v using (finess_epmsi, iso_year, stay) group by 1, 2, 3),
names(bloc, code, l) as (values ('gr', 'P', 'Pédiatrique (HC)'), ('gr', 'S', 'Spécialisée (HC)'), ('gr', 'T', 'Globale (HC)'), ('gr', 'U', 'Autre (HC)'), ('gr', 'H', 'Pédiatrique (HTP)'), ('gr', 'I', 'Très intensive (HTP)'),
  ('gr', 'J', 'Intensive (HTP)'), ('gr', 'K', 'Modérée (HTP)'), ('gr', 'L', 'Indifférenciée (HTP)'), ('gl', 'A', 'Niveau A'), ('gl', 'B', 'Niveau B'), ('gl', 'C', 'Niveau C'), ('sev', '0', 'HTP'), ('sev', '1', 'HC sans sévérité'), ('sev', '2', 'HC avec sévérité'))
select k.finess_epmsi, k.iso_year, k.bloc, k.code, effectif, valorisation, case when k.code is null then 'Sous-total' else coalesce(l, 'Erreur de groupage') end libelle,
  round(100.0 * effectif / max(effectif) over w, 6) pct_effectif, round(coalesce(100.0 * valorisation / nullif(max(valorisation) over w, 0), 0), 6) pct_valorisation
from k left join names n on n.bloc = k.bloc and n.code = k.code window w as (partition by k.finess_epmsi, k.iso_year, k.bloc)"""


@query("c24_e27_group_structure", _STRUCTURE)
def _(t: Tables) -> DataFrame:
    out = dash.group_structure(t.in_period, t.valuation, t.weeks, t.periods)
    return out.withColumns({"valorisation": F.col("valorisation").cast("double"), "pct_effectif": r("pct_effectif", 6), "pct_valorisation": r("pct_valorisation", 6)})


@query("e29_axis_values", """
select distinct finess_epmsi, numero_unite_medicale axis_value from v_weeks union all select distinct finess_epmsi, case type_hospitalisation when '3' then '2' else type_hospitalisation end from v_in_period""")
def _(t: Tables) -> DataFrame:
    return dash.axis_values(t.weeks, "numero_unite_medicale").unionByName(dash.axis_values(t.in_period, "type_hospitalisation"))


@query("e29_available_years", "select distinct finess_epmsi, iso_year from v_weeks")
def _(t: Tables) -> DataFrame:
    return per.available_years(t.weeks)


@query("h3_establishments", "select finess_epmsi from v_weeks union select finess_epmsi from v_admin")
def _(t: Tables) -> DataFrame:
    return per.establishments(t.weeks, t.admin)


@query("c25_exit_date_of_stay", """
select rhs_id, l._date_sortie_sej from v_weeks left join (select finess_epmsi, stay, arg_max(date_fin_sejour, line_no) _date_sortie_sej from v_weeks where date_fin_sejour is not null group by 1, 2) l using (finess_epmsi, stay)""")
def _(t: Tables) -> DataFrame:
    return copy_over_group(t.weeks, ["finess_epmsi", "stay"], ["source_file", "line_no"], "date_fin_sejour", "_date_sortie_sej").select("rhs_id", "_date_sortie_sej")


@query("f8_share_of_year", """
with c as (select finess_epmsi, iso_year, numero_unite_medicale u, cast(sum(n_days) as bigint) n from v_in_period group by 1, 2, 3) select finess_epmsi, iso_year, u, n, round(100.0 * n / sum(n) over (partition by finess_epmsi, iso_year), 6) pct from c""")
def _(t: Tables) -> DataFrame:
    from wardflow.operators.ordered import share_of

    cells = t.in_period.groupBy(*P, F.col("numero_unite_medicale").alias("u")).agg(F.sum("n_days").alias("n"))
    return share_of(cells, P, "n", "pct").withColumn("pct", r("pct", 6))
