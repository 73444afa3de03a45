"""Join and union queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.bindings.q_valuation import r, text
from wardflow.bindings.registry import query
from wardflow.bindings.tables import Tables
from wardflow.operators import crossgrain as cg
from wardflow.operators import hierarchy as hi
from wardflow.plans import explorer as ex
from wardflow.plans import tariffs
from wardflow.sources import nomenclatures as nom

ALL = "*"


@query("d1_child_to_parent", """
select finess_epmsi, iso_year, code_das, count(*) n from v_das join v_in_period using (rhs_id) group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    from wardflow.plans.dashboard import children_of

    return children_of(t.das, t.in_period).groupBy("finess_epmsi", "iso_year", "code_das").agg(F.count(ALL).alias("n"))


@query("d2_record_labels", """
select g1.libelle_long lib_gme, g2.libelle_long lib_gn, g3.libelle_long lib_cm, r_name lib_erreur, case when r_regionkey % 2 = 0 then 'B' else 'N' end type_erreur, dp.libelle_complet lib_dp, ae.libelle_complet lib_ae, count(*) n
from v_weeks w left join v_groups g1 on g1.code = code_gme and g1.kind = 'GME' left join v_groups g2 on g2.code = substr(code_gme, 1, 4) and g2.kind = 'GN' left join v_groups g3 on g3.code = substr(code_gme, 1, 2) and g3.kind = 'CM'
left join region on cast(r_regionkey as varchar) = cast(cast(code_retour_groupage as int) as varchar) left join v_diagnoses dp on dp.code = manifestation_morbide_principale left join v_diagnoses ae on ae.code = affection_etiologique group by all""")
def _(t: Tables) -> DataFrame:
    rows = ex.records_with_labels(t.records, t.groups, t.error_table, t.diagnoses)
    return rows.groupBy("lib_gme", "lib_gn", "lib_cm", "lib_erreur", "type_erreur", "lib_dp", "lib_ae").agg(F.count(ALL).alias("n"))


_TITLES = "select distinct h code, case k when 1 then 'chapitre' else 'sous_chapitre' end kind, 'T' || h libelle from (select lpad(cast(p_partkey % 9 as varchar), 2, '0') h, 1 k from part union all select lpad(cast(p_partkey % 9 as varchar), 2, '0') || '.' || lpad(cast(p_partkey % 4 as varchar), 2, '0'), 2 from part)"


def _headings(t: Tables) -> DataFrame:
    parts = t.part.selectExpr("lpad(cast(p % 9 as string), 2, '0') a", "concat(lpad(cast(p % 9 as string), 2, '0'), '.', lpad(cast(p % 4 as string), 2, '0')) b")
    codes = parts.select(F.col("a").alias("code_hier")).union(parts.select("b")).distinct()
    return nom.title_hierarchy(codes.select("code_hier", F.lit("T").alias("typo"), F.concat(F.lit("T"), "code_hier").alias("libelle")))


@query("d3_truncated_heading", f"""
with h as ({_TITLES}), c as (select 'ACT' || lpad(cast(p_partkey % 300 as varchar), 4, '0') code, min(lpad(cast(p_partkey % 9 as varchar), 2, '0') || '.' || lpad(cast(p_partkey % 5 as varchar), 2, '0') || '.01') parent, min(p_name) l from part group by 1)
select h1.code csarr_chapitre, h1.libelle csarr_chapitre_label, h2.code csarr_sous_chapitre, h2.libelle csarr_sous_chapitre_label, l lib_csarr, count(*) n
from v_csarr left join c on c.code = code_principal left join h h1 on h1.code = substr(parent, 1, 2) and h1.kind = 'chapitre' left join h h2 on h2.code = substr(parent, 1, 5) and h2.kind = 'sous_chapitre' group by 1, 2, 3, 4, 5""")
def _(t: Tables) -> DataFrame:
    catalogue = t.part.groupBy(F.expr("concat('ACT', lpad(cast(p % 300 as string), 4, '0'))").alias("code")).agg(
        F.min(F.expr("concat(lpad(cast(p % 9 as string), 2, '0'), '.', lpad(cast(p % 5 as string), 2, '0'), '.01')")).alias("parent_code"),
        F.min("p_name").alias("libelle"),
    )
    rows = ex.acts_with_headings(t.csarr, catalogue, _headings(t))
    return rows.groupBy("csarr_chapitre", "csarr_chapitre_label", "csarr_sous_chapitre", "csarr_sous_chapitre_label", "lib_csarr").agg(F.count(ALL).alias("n"))


_CLOSURE = """
with recursive up as (select code, code ancestor_code, kind ancestor_kind, parent_code nx, 0 hops from v_nodes
  union all select up.code, n.code, n.kind, n.parent_code, hops + 1 from up join v_nodes n on n.code = up.nx where hops < 12)"""


@query("l5_closure", f"{_CLOSURE} select code, ancestor_code, ancestor_kind, hops from up")
def _(t: Tables) -> DataFrame:
    return hi.closure(t.diagnosis_nodes)


@query("d4_ancestor_of_kind", f"""
{_CLOSURE}, chap as (select n.code, (select ancestor_code from up where up.code = n.code and ancestor_kind = 'chapter' order by hops limit 1) c from (select distinct code from v_nodes) n)
select case when e.code is not null then e.c else s.c end chapitre, case when e.code is not null then 'L ' || e.c when s.c is not null then 'L ' || s.c end libelle, count(*) n
from v_weeks left join chap e on e.code = manifestation_morbide_principale left join chap s on s.code = substr(manifestation_morbide_principale, 1, 3) group by 1, 2""")
def _(t: Tables) -> DataFrame:
    rows = hi.with_ancestor(t.records.select("manifestation_morbide_principale"), t.diagnosis_nodes, "manifestation_morbide_principale", "chapter")
    name = "manifestation_morbide_principale_chapter"
    return rows.groupBy(F.col(name).alias("chapitre"), F.col(f"{name}_label").alias("libelle")).agg(F.count(ALL).alias("n"))


@query("d4_geography_ancestor", """
select c_mktsegment, r_name, count(*) n from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1, 2""")
def _(t: Tables) -> DataFrame:
    region = t.raw("region").selectExpr("concat('R', r_regionkey) code", "'region' kind", "cast(null as string) parent_code", "r_name libelle")
    nation = t.raw("nation").selectExpr("concat('N', n_nationkey) code", "'nation' kind", "concat('R', n_regionkey) parent_code", "n_name libelle")
    table = hi.ancestor_of_kind(region.unionByName(nation), "region")
    rows = t.raw("customer").select("c_mktsegment", F.concat(F.lit("N"), "c_nationkey").alias("code")).join(table, "code")
    return rows.groupBy("c_mktsegment", F.col("ancestor_label").alias("r_name")).agg(F.count(ALL).alias("n"))


@query("d14_count_once_per_cell", """
with p as (select distinct substr(code_gme, 1, 2) cm, finess_epmsi, stay from v_weeks where code_gme is not null) select cm, cast(sum(montant_br_sej) as double) montant, count(*) n from p join v_valuation using (finess_epmsi, stay) group by 1""")
def _(t: Tables) -> DataFrame:
    base = t.weeks.where("code_gme is not null").withColumn("cm", F.substring("code_gme", 1, 2))
    return cg.count_once_per_cell(base, t.valuation, ["finess_epmsi", "stay"], ["cm"], "numero_rha",
                                  F.sum("montant_br_sej").cast("double").alias("montant"), F.count(ALL).alias("n"))


@query("e38_sources_side_by_side", """
select finess_epmsi, annee, max(nb_rhs) nb_rhs, max(nb_das) nb_das, max(montant) montant from (
  select finess_epmsi, iso_year annee, count(*) nb_rhs, null nb_das, null montant from v_weeks group by 1, 2
  union all select finess_epmsi, iso_year, null, count(*), null from v_das join v_weeks using (rhs_id) group by 1, 2
  union all select finess_epmsi, campagne, null, null, cast(sum(montant_br_sej) as double) from v_official group by 1, 2) group by 1, 2""")
def _(t: Tables) -> DataFrame:
    from wardflow.functions.derive import official_amount_rows

    key = ["finess_epmsi", "annee"]
    parts = {
        "rhs": t.weeks.groupBy("finess_epmsi", F.col("iso_year").alias("annee")).agg(F.count(ALL).alias("nb_rhs")),
        "das": t.das.groupBy("rhs_id").agg(F.count(ALL).alias("n")).join(t.weeks.select("rhs_id", "finess_epmsi", F.col("iso_year").alias("annee")), "rhs_id").groupBy(*key).agg(F.sum("n").alias("nb_das")),
        "valo": t.valuation.where(official_amount_rows()).groupBy("finess_epmsi", F.col("campagne").alias("annee")).agg(F.sum("montant_br_sej").cast("double").alias("montant")),
    }
    return cg.sources_side_by_side(parts, key)


@query("h1_diagnosis_union", """
select type_diag, substr(code_diag, 1, 1) lettre, count(*) n, count(distinct stay) s from (
  select stay, 'MMP' type_diag, manifestation_morbide_principale code_diag from v_weeks where coalesce(manifestation_morbide_principale, '') <> ''
  union all select stay, 'AE', affection_etiologique from v_weeks where coalesce(affection_etiologique, '') <> ''
  union all select stay, 'DAS', code_das from v_das join v_weeks using (rhs_id)) group by 1, 2""")
def _(t: Tables) -> DataFrame:
    rows = ex.diagnosis_source(t.weeks, t.das).withColumn("lettre", F.substring("code_diag", 1, 1))
    per_stay = rows.groupBy("type_diag", "lettre", "stay").agg(F.count(ALL).alias("k"))
    return per_stay.groupBy("type_diag", "lettre").agg(F.sum("k").alias("n"), F.count(ALL).alias("s"))


@query("h2_act_union", """
select type_acte, finess_epmsi, iso_year, count(*) n, cast(sum(nombre_realisations) as bigint) k from (
  select rhs_id, 'CSARR' type_acte, nombre_realisations from v_csarr union all select rhs_id, 'CSAR', nombre_realisations from v_csar union all select rhs_id, 'CCAM', nombre_realisations from v_ccam)
join v_weeks using (rhs_id) group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    rows = ex.act_source(t.weeks, t.csarr, t.csar, t.ccam)
    return rows.groupBy("type_acte", "finess_epmsi", "iso_year").agg(F.count(ALL).alias("n"), F.sum("nombre_realisations").alias("k"))


@query("d16_tariff_on_date", """
with g as (select lpad(cast(p_partkey % 50 as varchar), 4, '0') gmt, min(p_retailprice) tarif, y, make_date(cast(y as int), 3, 1) deb, case when y < 2001 then make_date(cast(y + 1 as int), 3, 1) - 1 end fin from part, generate_series(1995, 2001) s(y) group by 1, 3)
select l.gmt, count(*) n, count(tarif) k, round(sum(tarif), 2) s from (select lpad(cast(l_partkey % 60 as varchar), 4, '0') gmt, cast(l_shipdate as date) d from lineitem) l
left join g on g.gmt = l.gmt and d >= deb and (fin is null or d <= fin) group by 1""")
def _(t: Tables) -> DataFrame:
    years = F.sequence(F.lit(1995), F.lit(2001))
    grid = t.part.groupBy(F.expr("lpad(cast(p % 50 as string), 4, '0')").alias("code_gmt")).agg(F.min("p_retailprice").alias("tarif")).select(
        "code_gmt", "tarif", F.explode(years).alias("y")
    ).select("code_gmt", "tarif", F.expr("make_date(y, 3, 1)").alias("date_debut"), F.expr("case when y < 2001 then date_sub(make_date(y + 1, 3, 1), 1) end").alias("date_fin"))
    rows = t.raw("lineitem").select(F.expr("lpad(cast(l_partkey % 60 as string), 4, '0')").alias("code_gmt"), F.to_date("l_shipdate").alias("d"))
    out = tariffs.tariff_on_date(rows, grid, ["code_gmt"], "d", ["tarif"])
    return out.groupBy(F.col("code_gmt").alias("gmt")).agg(F.count(ALL).alias("n"), F.count("tarif").alias("k"), r(F.sum("tarif")).alias("s"))


@query("d17_stay_sheet", """
with w as (select finess_epmsi, stay, count(*) n_weeks, cast(sum(n_days) as bigint) n_days, arg_min(numero_semaine, line_no) first_week from v_weeks group by 1, 2),
d as (select stay, count(*) n from v_das join v_weeks using (rhs_id) group by 1), c as (select stay, count(*) n from v_csarr join v_weeks using (rhs_id) group by 1),
v as (select stay, cast(sum(montant_br_sej) as double) m from v_valuation group by 1)
select w.finess_epmsi, w.stay, n_weeks, n_days, coalesce(d.n, 0) n_das, coalesce(c.n, 0) n_csarr, first_week, date_entree entree, m montant
from w left join d using (stay) left join c using (stay) left join v using (stay) left join v_admin a on a.stay = w.stay""")
def _(t: Tables) -> DataFrame:
    sheet = ex.stay_sheet(t.stays, t.weeks, t.admin, t.valuation, {"das": t.das, "csarr": t.csarr})
    size = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.array())), F.lit(0)).cast("bigint")
    return sheet.select(
        "finess_epmsi", "stay", size("weeks").alias("n_weeks"), "n_days", size("das").alias("n_das"), size("csarr").alias("n_csarr"),
        F.col("weeks")[0]["record"]["numero_semaine"].alias("first_week"), F.col("admin.date_entree").alias("entree"),
        F.col("montant_br_sej").cast("double").alias("montant"),
    )
