"""Nomenclature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.bindings.registry import query
from wardflow.bindings.tables import Tables
from wardflow.session import run_folder
from wardflow.sources import delimited as dl
from wardflow.sources import nomenclatures as nom


@query("a10_tariff_grid", """
select 'f' || cast(p_partkey % 3 as varchar) feuille_source, lpad(cast(p_partkey as varchar), 5, '0') code_gmt, p_type code_gme, p_retailprice tarif_zone_basse, cast(p_size as double) debut_zone_forfaitaire,
  '20' || lpad(cast(10 + p_partkey % 15 as varchar), 2, '0') || '-03-01' date_debut from part where p_partkey % 11 <> 0""")
def _(t: Tables) -> DataFrame:
    sheets = {}
    for k in range(3):
        sheets[f"f{k}"] = t.part.where(F.col("p") % 3 == k).select(
            F.expr("case when p % 11 = 0 then '' else '2024' end").alias("ANNEE"), F.expr("lpad(cast(p as string), 5, '0')").alias("GMT"), F.col("p_type").alias("GME"),
            F.col("p_retailprice").cast("string").alias("Tarif de la zone basse (TZB)"), F.col("p_size").cast("string").alias("Debut de zone forfaitaire (DZF)"),
            F.expr("case when p % 2 = 0 then concat('01/03/20', lpad(cast(10 + p % 15 as string), 2, '0')) else concat('20', lpad(cast(10 + p % 15 as string), 2, '0'), '-03-01') end").alias("DDEB"),
        )
    return dl.tariff_grid(sheets).select("feuille_source", "code_gmt", "code_gme", "tarif_zone_basse", "debut_zone_forfaitaire", "date_debut")


@query("a11_diagnosis_kit", """
select 'D' || cast(p_partkey as varchar) code, case when p_partkey % 4 <> 0 then cast(p_partkey % 4 as int) end type_mco_had, p_brand profil_smr, null type_psy, p_name libelle_courts, 'ok' what from part where p_partkey % 17 <> 0
union all select null, null, null, null, 'D' || cast(p_partkey as varchar) || '|x', 'bad' from part where p_partkey % 17 = 0""")
def _(t: Tables) -> DataFrame:
    lines = t.part.select(F.col("p").alias("line_no"), F.expr(
        "case when p % 17 = 0 then concat('D', p, '|x') else concat('D', p, ' |', case when p % 4 = 0 then '' else cast(p % 4 as string) end, '|', p_brand, '| |', p_name, '|', p_name) end"
    ).alias("line"))
    rows, bad = dl.diagnosis_kit(lines)
    good = rows.select("code", "type_mco_had", "profil_smr", "type_psy", F.col("libelle_court").alias("libelle_courts"), F.lit("ok").alias("what"))
    return good.unionByName(bad.select(F.col("line").alias("libelle_courts"), F.lit("bad").alias("what")), allowMissingColumns=True)


@query("a12_claml_hierarchy", "select code, kind, parent_code, libelle from v_nodes n, lateral (select 'L ' || n.code libelle)")
def _(t: Tables) -> DataFrame:
    folder = run_folder(t.spark, "claml")
    dotted = lambda c: F.when(F.length(c) > 3, F.concat(F.substring(c, 1, 3), F.lit("."), F.substring(c, 4, 9))).otherwise(F.col(c))
    label = F.array(F.struct(F.col("libelle").alias("_VALUE"), F.lit("fr").alias("_lang")))
    classes = t.diagnosis_nodes.select(
        dotted("code").alias("_code"), F.col("kind").alias("_kind"),
        F.when(F.col("parent_code").isNotNull(), F.array(F.struct(dotted("parent_code").alias("_code")))).alias("SuperClass"),
        F.array(F.struct(F.lit("note").alias("_kind"), label.alias("Label")), F.struct(F.lit("preferred").alias("_kind"), label.alias("Label"))).alias("Rubric"),
    )
    classes.write.format("xml").option("rootTag", "ClaML").option("rowTag", "Class").save(folder)
    return dl.claml_classes(t.spark, folder)


@query("a13_grouping_errors", """
select cast(p_partkey as varchar) code, p_name libelle, p_type "type" from part where p_partkey % 5 <> 0""")
def _(t: Tables) -> DataFrame:
    lines = t.part.selectExpr("case when p % 5 = 0 then concat('commentaire ', p, ' | x') else concat(p, '| ', p_name, ' |', p_type) end line")
    return dl.grouping_errors(lines)


@query("a14_f9_sectioned_acts", """
with x as (select p_brand source_file, p_partkey, case when p_partkey % 6 = 0 then cast(p_partkey as varchar) end h from part),
y as (select *, last_value(h ignore nulls) over (partition by source_file order by p_partkey rows between unbounded preceding and current row) e from x)
select source_file, e code_erreur, 'A' || cast(y.p_partkey as varchar) code_acte, p_name libelle_acte from y join part on part.p_partkey = y.p_partkey where h is null and e is not null and y.p_partkey % 6 <> 1""")
def _(t: Tables) -> DataFrame:
    lines = t.part.selectExpr("p_brand source_file", "p line_no", "case when p % 6 = 0 then concat('Erreur ', p, ' :') when p % 6 = 1 then '' else concat('A', p, '\\t', p_name) end line")
    return dl.sectioned_acts(lines)


@query("a15_code_labels", "select s_name code, 'nom ' || s_name libelle from supplier")
def _(t: Tables) -> DataFrame:
    folder = run_folder(t.spark, "labels")
    t.raw("supplier").select(F.col("s_name").alias("code"), F.concat(F.lit("nom "), "s_name").alias("libelle")).write.csv(folder, sep=";", header=True)
    return nom.code_labels(dl.read_export(t.spark, folder))


_CCAM = """
sh as (select p_partkey line_no, 'K' || cast(p_partkey % 200 as varchar) code, case when p_partkey % 9 = 0 then 'T' else 'L' end typo, p_name libelle, lpad(cast(p_partkey % 5 as varchar), 2, '0') || '.0' || cast(p_partkey % 3 as varchar) || '.01' par,
  case when p_partkey % 4 = 0 then lpad(cast(p_partkey % 5 as varchar), 2, '0') || '.0' || cast(p_partkey % 3 as varchar) || '.01.02' end sp, '20' || lpad(cast(p_size % 20 as varchar), 2, '0') || '-01-01' since, p_type from part)"""


def _ccam_sheet(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "p line_no", "concat('K', p % 200) code", "case when p % 9 = 0 then 'T' else 'L' end typo", "p_name libelle",
        "concat(lpad(cast(p % 5 as string), 2, '0'), '.0', p % 3, '.01') paragraphe", "case when p % 4 = 0 then concat(lpad(cast(p % 5 as string), 2, '0'), '.0', p % 3, '.01.02') end sous_paragraphe",
        "concat('20', lpad(cast(p_size % 20 as string), 2, '0'), '-01-01') date_debut", "concat('c ', p_type) chapitre_libelle", "concat('s ', p_type) sous_chapitre_libelle", "concat('p ', p_type) paragraphe_libelle", "concat('q ', p_type) sous_paragraphe_libelle",
    )


@query("a16_catalogue_acts", f"""
with {_CCAM} select code, libelle, coalesce(sp, par) parent_code from sh where typo = 'L' qualify row_number() over (partition by code order by since desc, line_no desc) = 1""")
def _(t: Tables) -> DataFrame:
    return nom.catalogue_acts(_ccam_sheet(t))


@query("l1_catalogue_hierarchy", f"""
with {_CCAM}, l as (select line_no, since, 1 d, split_part(par, '.', 1) code, 'chapitre' kind, null parent_code, 'c ' || p_type libelle from sh where typo = 'L'
  union all select line_no, since, 2, split_part(par, '.', 1) || '.' || split_part(par, '.', 2), 'sous_chapitre', split_part(par, '.', 1), 's ' || p_type from sh where typo = 'L'
  union all select line_no, since, 3, par, 'paragraphe', split_part(par, '.', 1) || '.' || split_part(par, '.', 2), 'p ' || p_type from sh where typo = 'L'
  union all select line_no, since, 4, sp, 'sous_paragraphe', par, 'q ' || p_type from sh where typo = 'L' and sp is not null)
select code, kind, parent_code, libelle from l qualify row_number() over (partition by code order by since desc, line_no desc, d desc) = 1""")
def _(t: Tables) -> DataFrame:
    return nom.catalogue_hierarchy(_ccam_sheet(t))


@query("l2_title_hierarchy", """
with h as (select p_partkey p, case p_partkey % 5 when 0 then '0' || cast(p_partkey % 9 as varchar) when 1 then '0' || cast(p_partkey % 9 as varchar) || '.02' when 2 then '01.02.0' || cast(p_partkey % 9 as varchar) when 3 then '01.02.03.0' || cast(p_partkey % 9 as varchar) else '01.02.03.04.0' || cast(p_partkey % 9 as varchar) end c, p_name from part)
select c code, case p % 5 when 0 then 'chapitre' when 1 then 'sous_chapitre' when 2 then 'paragraphe' when 3 then 'sous_paragraphe' else 'niveau_5' end kind, case when p % 5 > 0 then substr(c, 1, length(c) - 3) end parent_code, p_name libelle from h where p % 7 <> 0""")
def _(t: Tables) -> DataFrame:
    return nom.title_hierarchy(_title_sheet(t))


def _title_sheet(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "case p % 5 when 0 then concat('0', p % 9) when 1 then concat('0', p % 9, '.02') when 2 then concat('01.02.0', p % 9) when 3 then concat('01.02.03.0', p % 9) else concat('01.02.03.04.0', p % 9) end code_hier",
        "case when p % 7 = 0 then 'L' else 'T' end typo", "p_name libelle", "concat('ACT', p) code",
    )


@query("a16_title_acts", "select 'ACT' || cast(p_partkey as varchar) code, p_name libelle, count(*) over () n from part where p_partkey % 7 = 0")
def _(t: Tables) -> DataFrame:
    rows = nom.title_acts(_title_sheet(t))
    return rows.select("code", "libelle", rows.agg(F.count("*").alias("n")).scalar().alias("n"))


@query("l3_chapter_acts", """
select substr(code, 1, 2) parent_code, case substr(code, 1, 2) when '01' then 'FONCTIONS CEREBRALES' when '02' then 'FONCTIONS SENSORIELLES ET DOULEUR' when '03' then 'FONCTIONS DE LA VOIX ET DE LA PAROLE' end libelle, count(*) n
from (select '0' || cast(1 + p_partkey % 3 as varchar) || cast(p_partkey as varchar) code from part) group by 1""")
def _(t: Tables) -> DataFrame:
    acts = nom.chapter_acts(t.part.selectExpr("concat('0', 1 + p % 3, p) code", "p_name libelle")).drop("libelle")
    chapters = nom.chapter_table(acts).select(F.col("code").alias("parent_code"), "libelle")
    return acts.join(chapters, "parent_code", "left").groupBy("parent_code", "libelle").agg(F.count("*").alias("n"))


@query("a17_act_weights", "select line_no, code, nomenclature, intervenant, ponderation, cast(debut as int) debut, mod_hw, mod_lj, mod_xh, mod_l3 from v_weights")
def _(t: Tables) -> DataFrame:
    return nom.act_weights(t.weight_sheet)


@query("a17_transcoding", "select code_csar, intervenant, acte_coll, code_csarr from v_transcoding")
def _(t: Tables) -> DataFrame:
    return nom.transcoding_detail(t.transcoding_sheet)


@query("a17_transcoding_pairs", """
select p_brand code_csarr, trim(p_name) libelle_csarr, case when p_size % 5 <> 0 then p_type end code_csar, case when p_size % 5 <> 0 then p_name end libelle_csar from part""")
def _(t: Tables) -> DataFrame:
    return nom.transcoding_pairs(t.part.selectExpr("p_brand code_csarr", "concat(p_name, ' ') libelle_csarr", "case when p_size % 5 <> 0 then p_type else '' end code_csar", "case when p_size % 5 <> 0 then p_name end libelle_csar"))


@query("a17_surcharges_and_times", """
select coalesce(l, '-') lieu, i, c, tps, k, count(*) n from (select code_modulateur_lieu l, coalesce(code_modulateur_temps, 'Vide') tps from v_csar) left join (values ('L1', 20.0, 10.0), ('L2', 30.0, null), ('L3', 5.0, null)) a(x, i, c) on x = l
left join (values ('Vide', 0.0), ('T0', 1.0), ('T1', 5.0), ('T2', 10.0), ('T3', 20.0), ('T4', 0.0)) b(y, k) on y = tps group by all""".replace("i, c, tps, k,", "cast(i as double) i, cast(c as double) c, tps, cast(k as double) k,"))
def _(t: Tables) -> DataFrame:
    place = nom.place_surcharges(t.modality_sheet).selectExpr("modalite l", "individuel i", "collectif c")
    time = nom.time_weights(t.modality_sheet).selectExpr("modalite tps", "ponderation k")
    rows = t.csar.select(F.col("code_modulateur_lieu").alias("l"), F.coalesce("code_modulateur_temps", F.lit("Vide")).alias("tps"))
    counts = rows.groupBy("l", "tps").agg(F.count("*").alias("n"))
    return counts.join(place, "l", "left").join(time, "tps", "left").select(F.coalesce("l", F.lit("-")).alias("lieu"), "i", "c", "tps", "k", "n")


@query("a18_specialised_acts", """
with g as (select lpad(cast(p_partkey % 40 as varchar), 4, '0') gn, arg_max(case when p_partkey % 6 = 0 then 'PAS DE LISTE' else p_brand end, p_partkey) l from part where p_partkey % 6 <> 0 group by 1),
a as (select p_brand l, 'X' || cast(p_partkey % 90 as varchar) code_acte, arg_min(upper(p_type), p_partkey) nomenclature from part group by 1, 2) select gn, code_acte, nomenclature from g join a using (l)""")
def _(t: Tables) -> DataFrame:
    lists = t.part.selectExpr("p line_no", "lpad(cast(p % 40 as string), 4, '0') gn", "case when p % 6 = 0 then 'Pas de liste' else p_brand end gn_liste")
    acts = t.part.selectExpr("p line_no", "concat('X', p % 90) code_acte", "lower(p_type) type_acte", "p_brand gn_liste")
    return nom.specialised_acts(lists, acts)


@query("a19_l4_group_hierarchy", "select kind, code, parent_code, libelle_court, libelle_long from v_groups")
def _(t: Tables) -> DataFrame:
    return t.groups
