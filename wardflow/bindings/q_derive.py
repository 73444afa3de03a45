"""Derived-column and predicate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.bindings.q_valuation import r, text
from wardflow.bindings.registry import query
from wardflow.bindings.tables import Tables
from wardflow.functions import calendar as cal
from wardflow.functions import derive as d
from wardflow.functions import filters as f
from wardflow.operators.crossgrain import keep_if_any_match
from wardflow.operators.pivot import PivotMeasure, hide_empty, pivot

ALL = "*"


@query("c1_stay_key", """
select raw, coalesce(nullif(ltrim(trim(raw), '0'), ''), '0') stay, count(*) n
from (select case o_custkey % 5 when 0 then lpad(cast(o_custkey as varchar), 12, '0') when 1 then '  ' || cast(o_custkey as varchar) when 2 then '00N' || cast(o_custkey as varchar) when 3 then '000' else '' end raw from orders) group by 1, 2""")
def _(t: Tables) -> DataFrame:
    raw = t.raw("orders").selectExpr(
        "case o_custkey % 5 when 0 then lpad(cast(o_custkey as string), 12, '0') when 1 then concat('  ', cast(o_custkey as string)) when 2 then concat('00N', cast(o_custkey as string)) when 3 then '000' else '' end raw"
    )
    return raw.select("raw", d.stay_key(F.col("raw")).alias("stay")).groupBy("raw", "stay").agg(F.count(ALL).alias("n"))


@query("c4_iso_week_date", """
select y, w, dw, cast(c.monday + cast(dw - 1 as int) as varchar) "day", count(*) n
from (select cast(year(l_shipdate) as int) y, cast(45 + l_linenumber + l_quantity % 3 as int) w, cast(1 + l_suppkey % 8 as int) dw from lineitem) x
left join v_calendar c on c.iso_year = y and c.week = w and dw <= 7 group by all""")
def _(t: Tables) -> DataFrame:
    x = t.raw("lineitem").selectExpr(
        "year(l_shipdate) y", "cast(45 + l_linenumber + l_quantity % 3 as int) w", "cast(1 + l_suppkey % 8 as int) dw"
    )
    return x.groupBy("y", "w", "dw").agg(F.count(ALL).alias("n")).withColumn(
        "day", text(cal.iso_date(F.col("y"), F.col("w"), F.col("dw")))
    )


@query("c15_sum_of_known", """
select case when coalesce(dependance_habillage_toilette, dependance_deplacement, dependance_alimentation, dependance_continence) is not null then cast(coalesce(cast(dependance_habillage_toilette as int), 0) + coalesce(cast(dependance_deplacement as int), 0)
  + coalesce(cast(dependance_alimentation as int), 0) + coalesce(cast(dependance_continence as int), 0) as double) end avq, count(*) n from v_weeks group by 1""")
def _(t: Tables) -> DataFrame:
    avq = d.sum_of_known(*[F.col(f"dependance_{x}") for x in ("habillage_toilette", "deplacement", "alimentation", "continence")])
    return t.records.groupBy(avq.alias("avq")).agg(F.count(ALL).alias("n"))


_AGE = "date_diff('day', cast(date_naissance as date), cast(date_debut_sejour as date)) / 365.25"


@query("c16_c17_age_band", f"""
select case when a < 18 then '< 18 ans' when a < 45 then '18-44 ans' when a < 65 then '45-64 ans' when a < 75 then '65-74 ans' when a < 85 then '75-84 ans' else '85 ans et +' end tranche, count(*) n, round(avg(a), 6) age
from (select {_AGE} a from v_weeks) group by 1""")
def _(t: Tables) -> DataFrame:
    age = d.age_years(F.to_date("date_naissance"), F.to_date("date_debut_sejour"))
    rows = t.records.withColumn("a", age)
    return rows.groupBy(d.age_band(F.col("a")).alias("tranche")).agg(F.count(ALL).alias("n"), r(F.avg("a"), 6).alias("age"))


@query("c18_department", """
select case when length(cp) < 2 then null when cp like '97%' or cp like '98%' then substr(cp, 1, 3) else substr(cp, 1, 2) end departement, count(*) n from (select code_postal_residence cp from v_weeks) group by 1""")
def _(t: Tables) -> DataFrame:
    return t.records.groupBy(d.department(F.col("code_postal_residence")).alias("departement")).agg(F.count(ALL).alias("n"))


@query("c19_yes_no", """
select case nv_chain when 1 then 'Oui' when 0 then 'Non' end chain, case numero_rha when '000' then 'Non' else numero_rha end rha, count(*) n from v_valuation group by 1, 2""")
def _(t: Tables) -> DataFrame:
    return t.valuation.groupBy(d.yes_no(F.col("nv_chain")).alias("chain"), d.yes_no(F.col("numero_rha")).alias("rha")).agg(F.count(ALL).alias("n"))


@query("c20_code_labels", """
select sexe, case sexe when '1' then 'Homme' when '2' then 'Femme' when '3' then 'Indéterminé' end l_sexe, case type_hospitalisation when '1' then 'Complète' when '2' then 'Partielle de jour' when '3' then 'Partielle de nuit' end l_type,
  case mode_entree_um when '6' then 'Mutation' when '7' then 'Transfert définitif' when '8' then 'Domicile' end l_mode, count(*) n from v_weeks group by all""")
def _(t: Tables) -> DataFrame:
    return t.records.groupBy(
        "sexe", d.code_label("sexe", F.col("sexe")).alias("l_sexe"),
        d.code_label("type_hospitalisation", F.col("type_hospitalisation")).alias("l_type"),
        d.code_label("mode_entree_um", F.col("mode_entree_um")).alias("l_mode"),
    ).agg(F.count(ALL).alias("n"))


@query("c21_dimension_display", """
select coalesce(affection_etiologique, '(vide)') code, coalesce(libelle_complet, affection_etiologique, '(vide)') libelle,
  case when libelle_complet is not null then coalesce(affection_etiologique, '(vide)') || ' — ' || libelle_complet else coalesce(affection_etiologique, '(vide)') end deux,
  case when affection_etiologique is null then '(sans correspondance)' else affection_etiologique end autre, count(*) n
from v_weeks left join v_diagnoses on code = affection_etiologique group by 1, 2, 3, 4""")
def _(t: Tables) -> DataFrame:
    rows = t.records.join(t.diagnoses.withColumnRenamed("code", "_c"), F.col("affection_etiologique") == F.col("_c"), "left")
    code, label = F.col("affection_etiologique"), F.col("libelle_complet")
    return rows.groupBy(
        d.shown(code, label, "code").alias("code"), d.shown(code, label).alias("libelle"), d.shown(code, label, "both").alias("deux"),
        d.shown(code, matched=code.isNotNull()).alias("autre"),
    ).agg(F.count(ALL).alias("n"))


@query("c22_date_dimensions", """
select strftime(x, '%Y') d_annee, strftime(x, '%Y-%m') || ' (' || ['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', 'novembre', 'décembre'][cast(month(x) as int)] || ')' d_mois,
  strftime(x, '%Y-%m') d_mois_sort, strftime(x, '%Y') || '-T' || cast(quarter(x) as varchar) d_trimestre, ['Lundi', 'Mardi', 'Mercredi', 'Jeudi', 'Vendredi', 'Samedi', 'Dimanche'][cast(isodow(x) as int)] d_jour_semaine,
  cast(isodow(x) - 1 as int) d_jour_semaine_sort, 'S' || lpad(cast(week(x) as varchar), 2, '0') || '-' || cast(isoyear(x) as varchar) d_semaine_iso, cast(isoyear(x) * 100 + week(x) as int) d_semaine_iso_sort, count(*) n
from (select cast(l_shipdate as date) x from lineitem) group by all""")
def _(t: Tables) -> DataFrame:
    days = t.raw("lineitem").groupBy(F.to_date("l_shipdate").alias("x")).agg(F.count(ALL).alias("c"))
    dims = cal.date_dimensions(F.col("x"), "d")
    return days.groupBy(*[v.alias(k) for k, v in dims.items()]).agg(F.sum("c").alias("n"))


@query("c22_week_dimension", """
select 'S' || substr(numero_semaine, 1, 2) || '-' || substr(numero_semaine, 3, 4) semaine, cast(iso_year * 100 + week as int) tri, count(*) n from v_weeks group by 1, 2""")
def _(t: Tables) -> DataFrame:
    label, sort = cal.week_dimension(F.col("numero_semaine"))
    return t.records.groupBy(label.alias("semaine"), sort.alias("tri")).agg(F.count(ALL).alias("n"))


@query("c23_group_parts", """
select substr(code_gme, 1, 2) cm, substr(code_gme, 1, 4) gn, nullif(substr(code_gme, 5, 1), '') gr, nullif(substr(code_gme, 6, 1), '') gl, nullif(substr(code_gme, 7, 1), '') severite, count(*) n from v_weeks group by all""")
def _(t: Tables) -> DataFrame:
    return t.records.groupBy(*[v.alias(k) for k, v in d.group_parts(F.col("code_gme")).items()]).agg(F.count(ALL).alias("n"))


@query("c26_error_code", """
select code_retour_groupage, cast(cast(code_retour_groupage as int) as varchar) c, count(*) n from v_weeks group by 1, 2
union all select l_returnflag || '01', l_returnflag || '01', count(*) from lineitem group by 1""")
def _(t: Tables) -> DataFrame:
    letters = t.raw("lineitem").selectExpr("concat(l_returnflag, '01') code_retour_groupage")
    codes = t.records.select("code_retour_groupage").unionByName(letters)
    return codes.groupBy("code_retour_groupage", d.error_code(F.col("code_retour_groupage")).alias("c")).agg(F.count(ALL).alias("n"))


@query("c27_text_filter", """
select count(*) filter (lower(p_name) = 'red widget') a, count(*) filter (lower(p_name) <> 'red widget') b, count(*) filter (lower(p_name) like '%ring%') c, count(*) filter (lower(p_name) like 'b%e %t') d,
  count(*) filter (lower(p_brand) like 'brand#1_') e, count(*) filter (lower(p_brand) not like 'brand#1_') f, count(*) n from part""")
def _(t: Tables) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    return t.raw("part").agg(
        F.count_if(f.text_filter(name, "=", "Red Widget")).alias("a"), F.count_if(f.text_filter(name, "<>", "red widget")).alias("b"),
        F.count_if(f.text_filter(name, "contains", "RING")).alias("c"), F.count_if(f.text_filter(name, "=", "b*e *t")).alias("d"),
        F.count_if(f.text_filter(brand, "=", "brand#1?")).alias("e"), F.count_if(f.text_filter(brand, "<>", "Brand#1?")).alias("f"),
        F.count_if(f.text_filter(brand, "=", "")).alias("n"),
    )


@query("c27_text_filter_documents", """
select lang, count(*) filter (contains(lower(text), 'the ')) n_the, count(*) filter (regexp_matches(lower(text), 'a.b.*c')) n_wild, count(*) n from documents group by 1""")
def _(t: Tables) -> DataFrame:
    body = F.col("text")
    return t.raw("documents").groupBy("lang").agg(
        F.count_if(F.contains(F.lower(body), F.lit("the "))).alias("n_the"), F.count_if(F.lower(body).rlike("a.b.*c")).alias("n_wild"), F.count(ALL).alias("n"),
    )


@query("c28_number_filter", """
select count(*) filter (montant_facturer_tm * 0.01 between 1000 and 100000) a, count(*) filter (montant_facturer_tm * 0.01 >= 250000) b, count(*) filter (montant_facturer_tm * 0.01 <= 5000) c,
  count(*) filter (try_cast(numero_ipp as double) in (1, 7, 30)) d, count(*) filter (try_cast(numero_ipp as double) = 12) e from v_admin""")
def _(t: Tables) -> DataFrame:
    tm, ipp = F.col("montant_facturer_tm"), F.col("numero_ipp")
    return t.admin.agg(
        F.count_if(f.number_filter(tm, "between", 1000, 100000, scale=0.01)).alias("a"), F.count_if(f.number_filter(tm, ">=", 250000, scale=0.01)).alias("b"),
        F.count_if(f.number_filter(tm, "<=", 5000, scale=0.01)).alias("c"), F.count_if(f.number_filter(ipp, "in", 1, 7, 30)).alias("d"),
        F.count_if(f.number_filter(ipp, "=", 12)).alias("e"),
    )


@query("c29_value_set_filter", """
select coalesce(indicateur_erreur, '(vide)') v, count(*) n from v_weeks where coalesce(indicateur_erreur, '(vide)') in ('(vide)', 'F') group by 1""")
def _(t: Tables) -> DataFrame:
    kept = t.records.where(f.value_set_filter(F.col("indicateur_erreur"), ["(vide)", "F"]))
    return kept.groupBy(d.shown(F.col("indicateur_erreur")).alias("v")).agg(F.count(ALL).alias("n"))


@query("c30_hide_empty_dimensions", """
select case when grouping(cm) = 0 then cm end d_cm, case when grouping(ae) = 0 then ae end d_ae, count(*) n from (select substr(code_gme, 1, 2) cm, substr(affection_etiologique, 1, 1) ae from v_weeks where code_gme is not null and affection_etiologique is not null)
group by grouping sets ((cm, ae), (cm), (ae), ())""")
def _(t: Tables) -> DataFrame:
    rows = t.records.select(
        d.shown(F.substring("code_gme", 1, 2)).alias("d_cm"), d.shown(F.substring("affection_etiologique", 1, 1)).alias("d_ae")
    )
    return pivot(hide_empty(rows, ["d_cm", "d_ae"]), ["d_cm"], ["d_ae"], [PivotMeasure("n", "count", F.lit(1))]).select("d_cm", "d_ae", "n")


@query("d6_any_match_filter", """
select finess_epmsi, count(*) n from v_weeks w where exists (select 1 from v_valuation v where v.finess_epmsi = w.finess_epmsi and v.stay = w.stay and montant_br_sej > 400000) group by 1""")
def _(t: Tables) -> DataFrame:
    return keep_if_any_match(t.weeks, t.valuation, ["finess_epmsi", "stay"], F.col("montant_br_sej") > 400000).groupBy("finess_epmsi").agg(F.count(ALL).alias("n"))
