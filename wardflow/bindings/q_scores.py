"""Rehabilitation score queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.bindings.q_valuation import r
from wardflow.bindings.registry import query
from wardflow.bindings.tables import Tables
from wardflow.operators.latest import cap_identical
from wardflow.plans import dashboard as dash
from wardflow.plans import scores as sc

P = ["finess_epmsi", "iso_year"]


def _acts(t: Tables, children: DataFrame) -> DataFrame:
    return dash.children_of(children, t.in_period, P, "stay")


@query("f4_latest_weight", """
select nomenclature, code, ponderation, mod_hw, mod_lj, mod_xh, mod_l3 from v_weight_act""")
def _(t: Tables) -> DataFrame:
    w = t.score_tables.weights
    both = [sc.latest_weights(w, n).withColumn("nomenclature", F.lit(n)) for n in ("CSARR", "CCAM")]
    return both[0].unionByName(both[1])


@query("f4_latest_weight_by_staff", "select code, intervenant, ponderation, mod_hw, mod_lj, mod_xh, mod_l3 from v_weight_staff")
def _(t: Tables) -> DataFrame:
    return sc.latest_weights(t.score_tables.weights, "CSARR", by_staff=True)


@query("f5_cap_identical_rows", """
select k, staff, n, seq from (select l_orderkey % 500 k, l_suppkey % 4 staff, cast(l_quantity as int) % 3 n, l_orderkey * 10 + l_linenumber seq from lineitem)
qualify row_number() over (partition by k, staff, n order by seq) <= 2""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").selectExpr("l_orderkey % 500 k", "l_suppkey % 4 staff", "cast(l_quantity as int) % 3 n", "l_orderkey * 10 + l_linenumber seq")
    return cap_identical(rows, "seq", 2)


_TRANS = """
tr as (select c.*, case code_intervenant when '80' then '21' when '81' then '21' else code_intervenant end staff, coalesce(modalite_collective, 0) coll from v_csar c where code_intervenant is not null),
tx as (select tr.*, coalesce(e.code_csarr, a.code_csarr) code_csarr from tr left join v_transcoding e on e.code_csar = code_principal and e.intervenant = staff and e.acte_coll = cast(coll as varchar)
  left join v_transcoding a on a.code_csar = code_principal and a.intervenant = staff and a.acte_coll = '2')"""

_CSARR = """
s1 as (select finess_epmsi, iso_year, stay, code_principal act, code_intervenant code, coalesce(nullif(nombre_realisations, 0), 1) n,
  w.ponderation * (1 + case when (code_modulateur_lieu = 'HW' and mod_hw) or (code_modulateur_lieu = 'LJ' and mod_lj) or (code_modulateur_lieu = 'XH' and mod_xh) or (code_modulateur_lieu = 'L3' and mod_l3)
    then coalesce(case when coalesce(nullif(nombre_reel_patients, 0), 1) <= 1 then i else c end, 0) else 0 end / 100.0) * coalesce(nullif(nombre_realisations, 0), 1) score
  from v_csarr join v_in_period using (rhs_id) join v_weight_act w on w.code = code_principal and w.nomenclature = 'CSARR'
  left join (values ('HW', 20.0, 10.0), ('LJ', 15.0, null), ('XH', 30.0, 12.0), ('L3', 5.0, 2.0)) m(k, i, c) on k = code_modulateur_lieu where code_intervenant is not null)"""

_CSAR = f"""
{_TRANS},
s2 as (select finess_epmsi, iso_year, stay, code_csarr act, code_intervenant code, coalesce(nullif(nombre_realisations, 0), 1) n,
  greatest(coalesce(tw, 0), wp) * (1 + case when (code_modulateur_lieu = 'L1' and (hw or lj)) or (code_modulateur_lieu = 'L2' and xh) or (code_modulateur_lieu = 'L3' and l3) then coalesce(case when coll <> 0 then mc else mi end, 0) else 0 end / 100.0)
    * coalesce(nullif(nombre_realisations, 0), 1) score
  from (select tx.*, case when w.code is null then z.ponderation else w.ponderation end wp, case when w.code is null then z.mod_hw else w.mod_hw end hw, case when w.code is null then z.mod_lj else w.mod_lj end lj,
      case when w.code is null then z.mod_xh else w.mod_xh end xh, case when w.code is null then z.mod_l3 else w.mod_l3 end l3
    from tx left join v_weight_staff w on w.code = code_csarr and w.intervenant = staff left join v_weight_staff z on z.code = code_csarr and z.intervenant = '00' where code_csarr is not null) q
  join v_in_period using (rhs_id)
  left join (values ('Vide', 0.0), ('T0', 1.0), ('T1', 5.0), ('T2', 10.0), ('T3', 20.0), ('T4', 0.0)) tt(k, tw) on k = coalesce(code_modulateur_temps, 'Vide')
  left join (values ('L1', 20.0, 10.0), ('L2', 30.0, null), ('L3', 5.0, null)) pl(k2, mi, mc) on k2 = code_modulateur_lieu where wp <> 0)"""

_CCAM = """
s3 as (select finess_epmsi, iso_year, stay, code_ccam act, 'CCAM' code, coalesce(nullif(nombre_realisations, 0), 1) n, w.ponderation * coalesce(nullif(nombre_realisations, 0), 1) score
  from v_ccam join v_in_period using (rhs_id) join v_weight_act w on w.code = code_ccam and w.nomenclature = 'CCAM')"""

_ALL = f"""
{_CSARR}, {_CSAR}, {_CCAM}, s as (select * from s1 union all select * from s2 union all select * from s3),
sc as (select s.finess_epmsi, s.iso_year, s.code, sum(n) n, sum(score) globale, sum(case when p.gn is not null then score else 0 end) specialisee
  from s left join v_stay_code k on k.finess_epmsi = s.finess_epmsi and k.iso_year = s.iso_year and k.stay = s.stay left join v_specialised p on p.gn = substr(k.code, 1, 4) and p.code_acte = s.act group by 1, 2, 3)"""


@query("d11_transcoding", f"with {_TRANS} select rhs_id, seq, code_principal, staff, cast(coll as int) coll, code_csarr from tx")
def _(t: Tables) -> DataFrame:
    out = sc.with_transcoding(t.csar.where("code_intervenant is not null"), t.score_tables.transcoding)
    return out.select("rhs_id", "seq", "code_principal", "staff", "coll", "code_csarr")


@query("e7_csarr_scores", f"with {_CSARR} select finess_epmsi, iso_year, code, cast(sum(n) as bigint) n, round(sum(score), 4) score from s1 group by 1, 2, 3")
def _(t: Tables) -> DataFrame:
    return _summed(sc.csarr_scores(_acts(t, t.csarr), t.score_tables))


@query("d12_e8_csar_scores", f"with {_CSAR} select finess_epmsi, iso_year, code, cast(sum(n) as bigint) n, round(sum(score), 4) score from s2 group by 1, 2, 3")
def _(t: Tables) -> DataFrame:
    return _summed(sc.csar_scores(_acts(t, t.csar), t.score_tables))


@query("e9_ccam_scores", f"with {_CCAM} select finess_epmsi, iso_year, code, cast(sum(n) as bigint) n, round(sum(score), 4) score from s3 group by 1, 2, 3")
def _(t: Tables) -> DataFrame:
    return _summed(sc.ccam_scores(_acts(t, t.ccam), t.score_tables))


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy(*P, F.col("staff_code").alias("code")).agg(F.sum("n").alias("n"), r(F.sum("score"), 4).alias("score"))


def _scores(t: Tables) -> DataFrame:
    groups = dash.stay_groups(t.in_period, 4, name="gn")
    return sc.staff_scores(_acts(t, t.csarr), _acts(t, t.csar), _acts(t, t.ccam), groups, t.score_tables, P)


@query("d13_e10_staff_scores", f"with {_ALL} select finess_epmsi, iso_year, code, cast(n as bigint) n, round(globale, 4) globale, round(specialisee, 4) specialisee from sc")
def _(t: Tables) -> DataFrame:
    return _scores(t).withColumns({"globale": r("globale", 4), "specialisee": r("specialisee", 4)})


@query("e55_staff_table", f"""
with {_ALL}, a as (select finess_epmsi, iso_year, code_intervenant code, coalesce(any_value(libelle), code_intervenant) libelle, cast(sum(nombre_realisations) as bigint) n
  from v_csarr join v_in_period using (rhs_id) left join v_staff_labels l on l.code = code_intervenant where code_intervenant is not null group by 1, 2, 3)
select a.finess_epmsi, a.iso_year, a.code, a.libelle, a.n, round_even(round(coalesce(globale, 0), 6), 0) globale, round_even(round(coalesce(specialisee, 0), 6), 0) specialisee from a left join sc using (finess_epmsi, iso_year, code)
union all select finess_epmsi, iso_year, 'Total', 'Total', coalesce(n, 0), g, p from (select finess_epmsi, iso_year, cast(sum(n) as bigint) n from a group by 1, 2) full join
  (select finess_epmsi, iso_year, round_even(round(sum(globale), 6), 0) g, round_even(round(sum(specialisee), 6), 0) p from sc group by 1, 2) using (finess_epmsi, iso_year)""")
def _(t: Tables) -> DataFrame:
    return dash.staff_table(dash.staff_activity(t.in_period, t.csarr, t.staff_labels), _scores(t))


@query("e11_ignored_acts", f"""
with {_TRANS} select iso_year annee, numero_admin_sejour, date_realisation, code_principal code_csar, code_intervenant, case when coll <> 0 then 'Collectif' else 'Individuel' end modalite, cast(coalesce(nullif(nombre_realisations, 0), 1) as int) n
from tx join v_in_period using (rhs_id) where code_csarr is null""")
def _(t: Tables) -> DataFrame:
    acts = dash.children_of(t.csar, t.in_period, P, "numero_admin_sejour")
    return sc.ignored_acts(acts, t.score_tables.transcoding).select(
        F.col("iso_year").alias("annee"), "numero_admin_sejour", "date_realisation", F.col("code_principal").alias("code_csar"), "code_intervenant", "modalite", "n"
    )
