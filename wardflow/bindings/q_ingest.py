"""Source, sink and gate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.bindings.lines import admin_lines, weekly_folder, weekly_lines
from wardflow.bindings.q_valuation import text
from wardflow.bindings.registry import query
from wardflow.bindings.tables import Tables
from wardflow.operators.latest import last_wins
from wardflow.plans import quality as ql
from wardflow.session import run_folder
from wardflow.sources import delimited as dl
from wardflow.sources import fixed_width as fw
from wardflow.sources import store
from wardflow.sources.layouts import ADMIN, WEEKLY
from wardflow.streaming.incremental import ingest, ingest_rows, stream_lines

_N = "cast(numero_admin_sejour as bigint) + week"
_KNOWN = f"({_N}) % 37 <> 0"
_SHORT = f"({_N}) % 41 = 0"
_BAD = f"({_N}) % 41 <> 0 and ({_N}) % 43 = 0"


_IS_NUMBER = f"({_N}) % 41 <> 0 and ({_N}) % 43 <> 0 and ({_N}) % 47 = 0 and n2_nb_csarr > 0"
_HAS_CSAR = "n3_nb_csar > 0 and version_format_rhs_groupe = 'M1D'"
_IS_ACT_DATE = f"({_N}) % 41 <> 0 and ({_N}) % 43 <> 0 and not (({_N}) % 47 = 0 and n2_nb_csarr > 0) and ({_N}) % 53 = 0 and {_HAS_CSAR}"


@query("a1_scan_lines", """
select finess_epmsi, count(*) n, cast(sum(o_orderkey) as bigint) keys, count(*) n_numbers, count(*) last_number from v_orders group by 1""")
def _(t: Tables) -> DataFrame:
    folder = run_folder(t.spark, "lines")
    rows = t.orders.select("finess_epmsi", F.concat_ws(";", "numero_admin_sejour", "order_day").alias("value"))
    rows.repartition(8, "finess_epmsi").write.partitionBy("finess_epmsi").text(folder)
    lines = fw.read_lines(t.spark, folder)
    per_file = lines.withColumns({
        "finess_epmsi": F.regexp_extract("source_file", "finess_epmsi=([0-9]+)", 1), "key": F.substring("line", 1, 9).cast("bigint"),
    })
    return per_file.groupBy("finess_epmsi").agg(
        F.count("*").alias("n"), F.sum("key").alias("keys"), F.count_distinct("line_no").alias("n_numbers"), F.max("line_no").alias("last_number"),
    )


@query("a2_a3_fixed_fields", f"""
select finess_epmsi, ltrim(numero_admin_sejour) numero_admin_sejour, numero_semaine, numero_unite_medicale, version_format_rhs_groupe record_version, case when version_format_rhs_groupe = 'M1B' then substr(code_gme, 1, 6) else code_gme end code_gme, indicateur_erreur, date_debut_sejour, date_fin_sejour,
  case when {_BAD} then null else date_naissance end date_naissance, sexe, jours_hors_weekend, jours_weekend, manifestation_morbide_principale, n1_nb_das, n2_nb_csarr, case when version_format_rhs_groupe = 'M1D' then n3_nb_csar end n3_nb_csar, n4_nb_ccam from v_weeks where {_KNOWN}""")
def _(t: Tables) -> DataFrame:
    return fw.decode(weekly_lines(t), WEEKLY).select(
        "finess_epmsi", "numero_admin_sejour", "numero_semaine", "numero_unite_medicale", "record_version", "code_gme", "indicateur_erreur", "date_debut_sejour", "date_fin_sejour", "date_naissance",
        "sexe", "jours_hors_weekend", "jours_weekend", "manifestation_morbide_principale", "n1_nb_das", "n2_nb_csarr", "n3_nb_csar", "n4_nb_ccam",
    )


@query("a2_unknown_version", f"select finess_epmsi, count(*) n from v_weeks where not ({_KNOWN}) group by 1")
def _(t: Tables) -> DataFrame:
    bad = fw.rejected(weekly_lines(t), WEEKLY)
    return bad.groupBy(F.regexp_extract("source_file", "([0-9]{9})", 1).alias("finess_epmsi")).agg(F.count("*").alias("n"))


@query("a4_repeated_blocks", f"""
with k as (select rhs_id, version_format_rhs_groupe v, {_SHORT} short, {_IS_NUMBER} bad_number, {_IS_ACT_DATE} bad_date from v_weeks where {_KNOWN})
select 'das' block, code_das code, null staff, null jour, count(*) n, 0 done from v_das join k using (rhs_id) group by all
union all select 'csarr', code_principal, code_intervenant, date_realisation, count(*), cast(sum(done) as int) from
  (select *, case when bad_number and seq = min(seq) over (partition by rhs_id) then null else nombre_realisations end done from v_csarr join k using (rhs_id)) group by all
union all select 'csar', code_principal, code_intervenant, jour, count(*), cast(sum(nombre_realisations) as int) from
  (select *, case when bad_date and seq = min(seq) over (partition by rhs_id) then null else date_realisation end jour from v_csar join k using (rhs_id) where v = 'M1D') group by all
union all select 'ccam', code_ccam, null, date_realisation, count(*), cast(sum(done) as int) from
  (select *, case when short and seq = max(seq) over (partition by rhs_id) then null else nombre_realisations end done from v_ccam join k using (rhs_id)) group by all""")
def _(t: Tables) -> DataFrame:
    """Blocks of every known record: what a short line or a fault in an item takes is NULL, all else is there."""
    records = fw.decode(weekly_lines(t, block_faults=True), WEEKLY)
    none = F.lit(None).cast("string")
    parts = {"das": ("code_das", none), "csarr": ("code_principal", F.col("code_intervenant")), "csar": ("code_principal", F.col("code_intervenant")), "ccam": ("code_ccam", none)}
    out = None
    for name, (code, staff) in parts.items():
        items = fw.explode_block(records, name, "line_no")
        day = none if name == "das" else F.col("date_realisation")
        done = F.lit(0) if name == "das" else F.sum("nombre_realisations").cast("int")
        rows = items.groupBy(F.col(code).alias("code"), staff.alias("staff"), day.alias("jour")).agg(F.count("*").alias("n"), done.alias("done")).withColumn("block", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("a5_a6_record_errors", f"""
select 'date_naissance' kind, null block, null item, count(*) n from v_weeks where {_KNOWN} and {_BAD} union all select 'record length', null, null, count(*) from v_weeks where {_KNOWN} and {_SHORT}
union all select 'csarr[1].nombre_realisations', 'csarr', 1, count(*) from v_weeks where {_KNOWN} and {_IS_NUMBER} having count(*) > 0
union all select 'csar[1].date_realisation', 'csar', 1, count(*) from v_weeks where {_KNOWN} and {_IS_ACT_DATE} having count(*) > 0""")
def _(t: Tables) -> DataFrame:
    """Every message of every known record, by what it is about."""
    lines = weekly_lines(t, block_faults=True)
    errors = fw.error_rows(fw.decode(lines, WEEKLY), lines, WEEKLY).where(~F.col("message").startswith("unknown version"))
    return errors.groupBy(F.substring_index("message", ":", 1).alias("kind"), "block", "item").agg(F.count("*").alias("n"))


def _valuation_cells(t: Tables) -> DataFrame:
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return t.valuation.select(
        F.col("finess_epmsi").alias("FINESS"), F.col("numero_admin_sejour").alias("NUMADMIN"), F.col("numero_semaine").alias("NUMSEMAINE"), F.col("numero_rha").alias("NUMRHS"),
        F.col("type_hospitalisation").alias("HOSP"), dot("nv_chain").alias("NV_CHAIN"), F.col("code_gme").alias("GME"), F.col("montant_br_gmt").cast("string").alias("MNT_BR_GMT"),
        F.col("montant_br_gmth").cast("string").alias("MNT_BR_GMTH"), dot("montant_br_tot").alias("MNT_BR_TOT"),
    )


@query("a7_a8_valuation_csv", """
select finess_epmsi, numero_admin_sejour, numero_semaine, numero_rha, type_hospitalisation, nv_chain, code_gme, cast(montant_br_gmt as double) montant_br_gmt, cast(montant_br_gmth as double) montant_br_gmth, cast(montant_br_tot as double) montant_br_tot from v_valuation""")
def _(t: Tables) -> DataFrame:
    folder = run_folder(t.spark, "valuation")
    _valuation_cells(t).write.csv(folder, sep=";", header=True)
    rows, rejected = dl.read_valuation(t.spark, folder)
    return rows.withColumns({"nv_chain": F.col("nv_chain").cast("int")}).select(
        "finess_epmsi", "numero_admin_sejour", "numero_semaine", "numero_rha", "type_hospitalisation", "nv_chain", "code_gme", "montant_br_gmt", "montant_br_gmth", "montant_br_tot"
    )


@query("a9_file_identity", """
select finess_epmsi f, cast(year(o_orderdate) as int) campagne, finess_epmsi file_finess, cast(year(o_orderdate) as int) file_year, cast(month(o_orderdate) as int) file_month, count(*) n from v_orders group by all""")
def _(t: Tables) -> DataFrame:
    name = F.concat(F.lit("/drop/"), "finess_epmsi", F.date_format("o_orderdate", "'.'yyyy'.'MM'.SMR.VisualValoSejours.csv'"))
    rows = t.orders.select(F.col("finess_epmsi").alias("f"), name.alias("path"))
    # the campaign pattern takes the year that follows the first dot
    campaign = dl.file_campaign(F.regexp_replace("path", r"\.(\d{2})\.SMR.*$", ".csv"))
    return rows.groupBy("f", campaign.alias("campagne"), *[v.alias(k) for k, v in dl.file_identity(F.col("path")).items()]).agg(F.count("*").alias("n"))


_LAST = "select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc, l_discount desc, l_tax desc, l_returnflag desc, l_linestatus desc) = 1"
_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("f1_last_wins", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from ({_LAST})")
def _(t: Tables) -> DataFrame:
    return last_wins(t.raw("lineitem"), ["l_orderkey", "l_linenumber"], _ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("f1_last_wins_null_keys", """
with x as (select case when l_suppkey % 10 = 0 then null else l_orderkey end k, l_linenumber, l_partkey, l_orderkey * 10000 + l_suppkey * 10 + l_linenumber o, l_extendedprice p from lineitem)
select k, l_linenumber, p from x where k is null union all select k, l_linenumber, p from (select * from x where k is not null qualify row_number() over (partition by k, l_linenumber order by o desc, p desc) = 1)""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").selectExpr("case when l_suppkey % 10 = 0 then null else l_orderkey end k", "l_linenumber", "l_orderkey * 10000 + l_suppkey * 10 + l_linenumber o", "l_extendedprice p", "l_partkey", "l_shipdate", "l_quantity")
    return last_wins(rows, ["k", "l_linenumber"], ["o", "p"], ["o", "p", "l_partkey", "l_shipdate", "l_quantity"]).select("k", "l_linenumber", "p")


@query("a20_a21_upsert_table", f"select l_orderkey, l_linenumber, l_partkey, l_extendedprice from ({_LAST})")
def _(t: Tables) -> DataFrame:
    """Three loads of one table, the second one repeated: later lines replace, a reload changes nothing."""
    table = store.Table(run_folder(t.spark, "table"), ["l_orderkey", "l_linenumber"], _ORDER, ["part"])
    rows = t.raw("lineitem").withColumn("part", F.expr("l_orderkey % 4"))
    early, late = rows.where("l_shipdate < '1998-06-01'"), rows.where("l_shipdate >= '1998-06-01'")
    for batch in (early, late, late):
        table.upsert(batch)
    return table.read(t.spark).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("a22_latest_labels", """
select p_brand code, p_name libelle from part qualify row_number() over (partition by p_brand order by 2018 + p_size % 8 desc, p_type desc, p_partkey desc) = 1""")
def _(t: Tables) -> DataFrame:
    from wardflow.sources.nomenclatures import latest_labels

    rows = t.part.select(F.col("p_brand").alias("code"), F.col("p_name").alias("libelle"), F.expr("2018 + p_size % 8").alias("source_annee"), F.col("p_type").alias("source_file"), F.col("p").alias("line_no"))
    return latest_labels(rows, ["code"]).select("code", "libelle")


_MESSAGES = f"""
select 'rhs_' || finess_epmsi || '.txt' source_file, count(*) n from v_weeks where not ({_KNOWN}) or {_BAD} or ({_SHORT}) or ({_IS_NUMBER}) or ({_IS_ACT_DATE}) group by 1"""


@query("a23_error_log", f"select source_file, n, n n_keys from ({_MESSAGES})")
def _(t: Tables) -> DataFrame:
    """Two loads of the same files, the second one repeated; only the messages of the last one are current, each once."""
    lines = weekly_lines(t, block_faults=True)
    errors = fw.error_rows(fw.decode(lines, WEEKLY), lines, WEEKLY)
    log = store.ErrorLog(run_folder(t.spark, "errors"))
    for load in (1, 2, 2):
        log.append(errors, lines, load)
    key = F.struct("part_file", "line_no", "ordinal")
    return log.current(t.spark).groupBy("source_file").agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"))


@query("a24_load_summary", f"""
select 'rhs_' || finess_epmsi || '.txt' source_file, count(*) filter ({_KNOWN}) n_records, count(*) filter ({_KNOWN} and not ({_SHORT}) and not ({_BAD})) n_ok from v_weeks group by 1""")
def _(t: Tables) -> DataFrame:
    lines = weekly_lines(t)
    records = fw.decode(lines, WEEKLY)
    return store.load_summary(records, fw.error_rows(records, lines, WEEKLY)).select("source_file", "n_records", "n_ok")


@query("a25_delete_establishment", """
select 'vid_hosp' table_name, 'preview' what, count(*) n from v_admin where finess_epmsi = '680000002' union all select 'rhs', 'preview', count(*) from v_weeks where finess_epmsi = '680000002'
union all select 'vid_hosp', 'kept', count(*) from v_admin where finess_epmsi <> '680000002'""")
def _(t: Tables) -> DataFrame:
    source, target = run_folder(t.spark, "admin"), run_folder(t.spark, "admin-kept")
    t.admin.write.partitionBy("finess_epmsi").parquet(source)
    store.delete_establishment(t.spark, source, "680000002", target)
    preview = store.deletion_preview({"vid_hosp": t.admin, "rhs": t.records}, "680000002")
    kept = t.spark.read.parquet(target).agg(F.count("*").alias("n")).select(F.lit("vid_hosp").alias("table_name"), F.lit("kept").alias("what"), "n")
    return preview.select("table_name", F.lit("preview").alias("what"), F.col("n_rows").alias("n")).unionByName(kept)


@query("a25_drop_partition", f"""
select 'vid_hosp' table_name, finess_epmsi, count(*) n from v_admin where finess_epmsi <> '680000002' group by 2
union all select 'messages', substr(source_file, 5, 9), n from ({_MESSAGES}) where source_file <> 'rhs_680000002.txt'""")
def _(t: Tables) -> DataFrame:
    """An establishment leaves: its partition is dropped, and its files have no current message."""
    table = store.Table(run_folder(t.spark, "admin-table"), ["finess_epmsi", "numero_admin_sejour"], ["source_file", "line_no"], ["finess_epmsi"])
    table.upsert(t.admin)
    lines = weekly_lines(t, block_faults=True)
    log = store.ErrorLog(run_folder(t.spark, "errors"))
    log.append(fw.error_rows(fw.decode(lines, WEEKLY), lines, WEEKLY), lines, 1)
    table.drop(t.spark, "680000002")
    log.forget(lines.where(F.col("source_file") == "rhs_680000002.txt"), 2)
    left = [("vid_hosp", table.read(t.spark)), ("messages", log.current(t.spark).withColumn("finess_epmsi", F.substring("source_file", 5, 9)))]
    counts = [rows.groupBy("finess_epmsi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "finess_epmsi", "n") for name, rows in left]
    return counts[0].unionByName(counts[1])


@query("a26_export", "select numero_unite_medicale u, cast(iso_year as int) y, cast(sum(n_days) as bigint) n from v_weeks group by 1, 2")
def _(t: Tables) -> DataFrame:
    folder = run_folder(t.spark, "export")
    store.export_csv(t.weeks.groupBy(F.col("numero_unite_medicale").alias("u"), F.col("iso_year").alias("y")).agg(F.sum("n_days").alias("n")), folder)
    return t.spark.read.csv(folder, sep=";", header=True, schema="u string, y int, n bigint")


@query("a27_publish", "select finess_epmsi, stay, numero_ipp from v_admin")
def _(t: Tables) -> DataFrame:
    folder = run_folder(t.spark, "published")
    store.publish({"vid_hosp": t.admin}, folder)
    return t.spark.read.parquet(f"{folder}/vid_hosp").select("finess_epmsi", "stay", "numero_ipp")


_GATE = f"""
g as (select 'rhs_' || finess_epmsi || '.txt' source_file, count(*) total, count(*) filter ({_KNOWN} and not ({_SHORT}) and not ({_BAD})) n_ok, count(*) filter ({_KNOWN} and not ({_SHORT}) and {_BAD}) n_warning,
    count(*) filter ({_KNOWN} and {_SHORT}) n_blocking, count(*) filter (not ({_KNOWN})) n_unknown from v_weeks group by 1)"""


@query("b1_b2_file_gate", f"""
with {_GATE} select *, case when n_blocking > 0 then 'blocked' when n_warning > 0 then 'to_confirm' else 'accepted' end status, n_blocking > 0 blocked from g union all select 'rhs_vide.txt', 0, 0, 0, 0, 0, 'empty', true""")
def _(t: Tables) -> DataFrame:
    lines = weekly_lines(t)
    files = lines.select("source_file").distinct().unionByName(t.raw("region").limit(1).select(F.lit("rhs_vide.txt").alias("source_file")))
    return ql.file_gate(ql.record_verdicts(lines, WEEKLY), files).drop("first_blocking", "first_warning")


@query("b3_insured_number_warning", """
select case when numero_immatriculation_assure is null then 'missing' when regexp_full_match(numero_immatriculation_assure, '[0-9]+') then 'ok' else 'not numeric' end k, count(*) n from v_admin group by 1""")
def _(t: Tables) -> DataFrame:
    verdicts = ql.record_verdicts(admin_lines(t), ADMIN)
    kind = F.when(F.col("message").isNull(), "ok").when(F.col("message").contains("missing"), "missing").otherwise("not numeric")
    return verdicts.groupBy(kind.alias("k")).agg(F.count("*").alias("n"))


@query("b4_valuation_gate", """
select finess_epmsi source_file, count(*) n_rows, null unknown, false blocked from v_valuation group by 1 union all select p_brand, 0, 'AUTRE', true from part where p_partkey % 400 = 0 group by 1""")
def _(t: Tables) -> DataFrame:
    """Files with a known header, in column orders of their own, and files with one more column."""
    folder = run_folder(t.spark, "valuation-gate")
    _valuation_cells(t).select("HOSP", F.col("FINESS").alias("file"), "NUMADMIN", "FINESS", "MNT_BR_TOT").write.partitionBy("file").csv(f"{folder}/good", sep=";", header=True)
    bad = t.part.where("p % 400 = 0").select(F.col("p_brand").alias("file"), F.col("p").alias("NUMADMIN"), F.lit("1").alias("AUTRE"))
    bad.write.partitionBy("file").csv(f"{folder}/bad", sep=";", header=True)
    rows, rejected = dl.read_valuation(t.spark, folder)
    name = F.url_decode(F.url_decode(F.regexp_extract("source_file", "file=([^/]+)", 1))).alias("source_file")  # a folder name, in a URL
    return ql.valuation_gate(rows.groupBy(name).agg(F.count("*").alias("n_rows")), rejected.select(name, "unknown").distinct())


@query("b5_batch_gate", f"""
with {_GATE} select count(*) n_files, count(*) filter (n_blocking > 0) n_blocked, count(*) filter (source_file <= 'rhs_680000003.txt') n_overwrites, cast(sum(n_warning) as bigint) n_warnings, true needs_confirmation, count(*) filter (n_blocking > 0) = 0 promote from g""")
def _(t: Tables) -> DataFrame:
    gates = ql.file_gate(ql.record_verdicts(weekly_lines(t), WEEKLY))
    existing = gates.select("source_file").where("source_file <= 'rhs_680000003.txt'")
    return ql.batch_gate(gates, existing, confirmed=True)


@query("j1_incremental_load", """
select user_id, event_type, round(arg_max(value, ts), 4) "value", cast(max(ts) as varchar) ts from events group by 1, 2""")
def _(t: Tables) -> DataFrame:
    """Events dropped as daily files; a stream merges them, the latest event of a key wins."""
    drop, target, mark = (run_folder(t.spark, n) for n in ("drop", "merged", "mark"))
    events = t.raw("events").select("event_id", "ts", "user_id", "event_type", "value", F.date_format("ts", "yyyyMMdd").alias("day"))
    events.repartition("day").write.partitionBy("day").parquet(drop)
    table = store.Table(target, ["user_id", "event_type"], ["ts", "event_id"], ["event_type"])
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(drop)
    ingest_rows(stream, table, mark).awaitTermination()
    return table.read(t.spark).select("user_id", "event_type", F.round("value", 4).alias("value"), text("ts").alias("ts"))


def _streamed(t: Tables) -> tuple[store.Table, store.ErrorLog]:
    """The rendered weekly files as a drop folder, loaded by the stream in several micro-batches."""
    target, mark, messages = (run_folder(t.spark, n) for n in ("loaded", "mark", "messages"))
    table = store.Table(target, list(WEEKLY.key), ["source_file", "line_no"], ["finess_epmsi", "iso_year"])
    log = store.ErrorLog(messages)
    lines = stream_lines(t.spark, weekly_folder(t, block_faults=True), recursiveFileLookup="true", maxFilesPerTrigger="24")
    ingest(lines, WEEKLY, table, mark, log=log).awaitTermination()
    return table, log


@query("j1_drop_folder_load", f"""
select finess_epmsi, ltrim(numero_admin_sejour) numero_admin_sejour, numero_semaine, numero_unite_medicale, version_format_rhs_groupe record_version, n1_nb_das n_das, n2_nb_csarr n_csarr, n4_nb_ccam n_ccam,
  case when {_BAD} or {_SHORT} or ({_IS_NUMBER}) or ({_IS_ACT_DATE}) then 1 else 0 end n_errors from v_weeks where {_KNOWN}""")
def _(t: Tables) -> DataFrame:
    table, _log = _streamed(t)
    size = lambda c: F.size(c).cast("bigint")
    return table.read(t.spark).select(
        "finess_epmsi", "numero_admin_sejour", "numero_semaine", "numero_unite_medicale", "record_version",
        size("das").alias("n_das"), size("csarr").alias("n_csarr"), size("ccam").alias("n_ccam"), F.size("errors").alias("n_errors"),
    )


@query("j1_drop_folder_log", _MESSAGES)
def _(t: Tables) -> DataFrame:
    _table, log = _streamed(t)
    name = F.concat(F.lit("rhs_"), F.regexp_extract("source_file", "finess_epmsi=([0-9]+)", 1), F.lit(".txt"))
    return log.current(t.spark).groupBy(name.alias("source_file")).agg(F.count("*").alias("n"))
