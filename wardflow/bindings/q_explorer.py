"""Explorer queries: pivots with totals, percentages, lists and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.bindings.q_valuation import _MATCH, cents, r
from wardflow.bindings.registry import query
from wardflow.bindings.tables import Tables
from wardflow.functions import measures as m
from wardflow.functions import mergeable as mg
from wardflow.operators import ordered as od
from wardflow.operators import pivot as pv
from wardflow.plans import explorer as ex

_BASE = """
b as (select coalesce(numero_unite_medicale, '(vide)') u, coalesce(cast(iso_year as varchar), '(vide)') y, coalesce(case sexe when '1' then 'Homme' when '2' then 'Femme' when '3' then 'Indéterminé' end, sexe, '(vide)') s,
  coalesce(nullif(substr(code_gme, 1, 2), ''), '(vide)') cm, n_days, stay, finess_epmsi, numero_admin_sejour, n2_nb_csarr, n1_nb_das from v_in_period)"""


def _rows(t: Tables) -> DataFrame:
    src = ex.record_source(t.weeks).in_periods(t.periods)
    return src.shown("unite_medicale", "annee_periode", "sexe", "cm").withColumnsRenamed(
        {"d_unite_medicale": "u", "d_annee_periode": "y", "d_sexe": "s", "d_cm": "cm"}
    )


@query("e31_e32_pivot_totals", f"""
with {_BASE} select case when grouping(cm) = 0 then cm end d_cm, case when grouping(y) = 0 then y end d_annee_periode, case when grouping(cm) = 0 then 'full' else 'none' end row_level, case when grouping(y) = 0 then 'full' else 'none' end col_level,
  count(*) nb_rhs_count, cast(sum(n_days) as bigint) nb_journees_sum, round(avg(n2_nb_csarr), 6) nb_csarr_avg, min(n1_nb_das) nb_das_min, max(n1_nb_das) nb_das_max, count(distinct finess_epmsi || numero_admin_sejour) nb_sejours_distinct, round(median(n2_nb_csarr), 6) nb_csarr_median
from b group by grouping sets ((cm, y), (cm), (y), ())""")
def _(t: Tables) -> DataFrame:
    src = ex.record_source(t.weeks).in_periods(t.periods)
    out = src.pivot(["cm"], ["annee_periode"], [
        ("nb_rhs", "count"), ("nb_journees", "sum"), ("nb_csarr", "avg"), ("nb_das", "min"), ("nb_das", "max"), ("nb_sejours", "distinct"), ("nb_csarr", "median"),
    ])
    return out.withColumns({"nb_csarr_avg": r("nb_csarr_avg", 6), "nb_csarr_median": r("nb_csarr_median", 6)})


_SUBTOTAL_SETS = "(u, s, y, cm), (u, s, y), (u, s), (u, y, cm), (u, y), (u), (y, cm), (y), ()"


@query("e33_subtotals", f"""
with {_BASE} select case when grouping(u) = 0 then u end u, case when grouping(s) = 0 then s end s, case when grouping(y) = 0 then y end y, case when grouping(cm) = 0 then cm end cm,
  case when grouping(s) = 0 then 'full' when grouping(u) = 0 then 'first' else 'none' end row_level, case when grouping(cm) = 0 then 'full' when grouping(y) = 0 then 'first' else 'none' end col_level,
  count(*) n, cast(sum(n_days) as bigint) d, count(distinct stay) k from b group by grouping sets ({_SUBTOTAL_SETS})""")
def _(t: Tables) -> DataFrame:
    measures = [pv.PivotMeasure("n", "count", F.lit(1)), pv.PivotMeasure("d", "sum", F.col("n_days")), pv.PivotMeasure("k", "distinct", F.col("stay"))]
    return pv.pivot(_rows(t), ["u", "s"], ["y", "cm"], measures, row_subtotals=True, col_subtotals=True)


_PCT = """
with {base}, p as (select case when grouping(u) = 0 then u end u, case when grouping(s) = 0 then s end s, case when grouping(y) = 0 then y end y,
    case when grouping(s) = 0 then 'full' when grouping(u) = 0 then 'first' else 'none' end row_level, case when grouping(y) = 0 then 'full' else 'none' end col_level, cast(sum(n2_nb_csarr) as bigint) v
  from b group by grouping sets ((u, s, y), (u, s), (u, y), (u), (y), ())),
t as (select *, {den} tot from p)
select u, s, y, row_level, col_level, v, round(case when row_level = 'none' and col_level = 'none' then 100 when tot <> 0 then 100.0 * v / tot when row_level <> 'none' and col_level <> 'none' and v = 0 then 0 end, 6) pct
from t"""
_DEN = {
    "total": "max(case when row_level = 'none' and col_level = 'none' then v end) over ()",
    "row": "max(case when col_level = 'none' then v end) over (partition by row_level, u, s)",
    "col": "max(case when row_level = 'none' then v end) over (partition by col_level, y)",
}


def _percent(of: str) -> None:
    @query(f"e34_percent_of_{of}", _PCT.format(base=_BASE, den=_DEN[of]))
    def _(t: Tables) -> DataFrame:
        out = pv.pivot(_rows(t), ["u", "s"], ["y"], [pv.PivotMeasure("v", "sum", F.col("n2_nb_csarr"))], row_subtotals=True)
        return pv.percentages(out, ["u", "s"], ["y"], "v", of, "pct").withColumn("pct", r("pct", 6))


for _of in ("total", "row", "col"):
    _percent(_of)


@query("e35_aggregates", """
select finess_epmsi, count(montant_br_tot) n, cast(sum(montant_br_tot) as double) s, round(avg(cast(montant_br_tot as double)), 4) a, round(median(cast(montant_br_tot as double)), 4) m, cast(min(montant_br_tot) as double) mi, cast(max(montant_br_tot) as double) ma from v_official group by rollup(finess_epmsi)""")
def _(t: Tables) -> DataFrame:
    rows = ex.valuation_source(t.valuation).rows
    value = F.col("montant_br_tot")
    asked = [pv.PivotMeasure(n, how, value if how != "avg" and how != "median" else value.cast("double")) for n, how in
             (("n", "count"), ("s", "sum"), ("a", "avg"), ("m", "median"), ("mi", "min"), ("ma", "max"))]
    out = pv.pivot(rows, ["finess_epmsi"], [], asked)
    return out.select("finess_epmsi", "n", *[F.col(c).cast("double").alias(c) for c in ("s", "mi", "ma")], r("a", 4).alias("a"), r("m", 4).alias("m"))


@query("e36_distinct_measure", """
select case when grouping(sexe_beneficiaire) = 0 then coalesce(sexe_beneficiaire, '(vide)') end sexe, count(distinct numero_ipp) patients, round(sum(cast(montant_facturer_tm as double) * 0.01), 2) tm from v_admin group by grouping sets ((sexe_beneficiaire), ())""")
def _(t: Tables) -> DataFrame:
    out = ex.admin_source(t.admin).pivot(["sexe_b"], [], [("nb_patients", "distinct"), ("mnt_tm", "sum")])
    return out.select(F.col("d_sexe_b").alias("sexe"), F.col("nb_patients_distinct").alias("patients"), r("mnt_tm_sum").alias("tm"))


_YEARS = range(1992, 2000 + 1)  # fixed value: calendar of the supplied order dates


@query("e39_guarded_wide_pivot", f"""
select u, s, {", ".join(f'cast(sum(n_days) filter (y = {y}) as bigint) "{y}"' for y in _YEARS)} from (select numero_unite_medicale u, sexe s, iso_year y, n_days from v_in_period) group by 1, 2""")
def _(t: Tables) -> DataFrame:
    rows = t.in_period.select(F.col("numero_unite_medicale").alias("u"), F.col("sexe").alias("s"), F.col("iso_year").cast("string").alias("y"), "n_days")
    out = pv.pivot(rows, ["u", "s"], ["y"], [pv.PivotMeasure("d", "sum", F.col("n_days"))])
    wide = pv.pivot_wide(out, ["u", "s"], "y", "d", limit=200_000)
    return wide.select("u", "s", *[F.col(str(y)) if str(y) in wide.columns else F.lit(None).cast("bigint").alias(str(y)) for y in _YEARS])


@query("e40_e43_calculated_measure", """
select case when grouping(u) = 0 then u end u, case when grouping(y) = 0 then y end y, round(sum(n2_nb_csarr) / nullif(sum(n_days), 0), 6) actes_par_jour, cast(coalesce(sum(case when n1_nb_das > 0 then n_days end), 0) as double) jours_das, round(avg(n_days), 6) moy, count(distinct stay) n_sejours
from (select numero_unite_medicale u, cast(iso_year as varchar) y, * from v_in_period) group by grouping sets ((u, y), (u), (y), ())""")
def _(t: Tables) -> DataFrame:
    rows = t.in_period.withColumns({"u": F.col("numero_unite_medicale"), "y": F.col("iso_year").cast("string")})
    book = m.MeasureBook()
    book.register("actes_par_jour", "rhs", rows, lambda: mg.ratio(mg.total(F.col("n2_nb_csarr")), mg.total(F.col("n_days"))))
    book.register("jours_das", "rhs", rows, lambda: mg.total_if(F.col("n1_nb_das") > 0, F.col("n_days").cast("double")))
    book.register("moy", "rhs", rows, lambda: mg.mean(F.col("n_days")))
    book.register("n_sejours", "rhs", rows, lambda: mg.distinct(F.col("stay")))
    out = pv.pivot(rows, ["u"], ["y"], [pv.PivotMeasure(x.name, "calc", x.build()) for x in book])
    return out.select("u", "y", *[r(c, 6).alias(c) for c in ("actes_par_jour", "jours_das", "moy")], "n_sejours")


@query("e41_formula_aggregates", """
select n_nationkey k, coalesce(sum(c_acctbal) filter (c_acctbal < -900), 0.0) s, round(avg(c_acctbal), 6) a, count(c_acctbal) n, count(distinct c_mktsegment) d, min(c_mktsegment) mi, max(c_mktsegment) ma, round(median(c_acctbal), 4) me,
  (select c_mktsegment from customer x where x.c_nationkey = n_nationkey group by 1 order by count(*) desc, 1 limit 1) mo, case when count(distinct n_regionkey) = 1 then max(n_regionkey) end o
from nation left join customer on c_nationkey = n_nationkey group by 1""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("nation").join(t.raw("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    bal, segment = F.col("c_acctbal"), F.col("c_mktsegment")
    out = pv.calculate(rows.withColumn("k", F.col("n_nationkey")), ["k"], {
        "s": mg.total_if(bal < -900, bal), "a": mg.mean(bal), "n": mg.count(bal), "d": mg.distinct(segment), "mi": mg.least(segment), "ma": mg.greatest(segment),
        "me": mg.median(bal), "mo": mg.mode(segment), "o": mg.only(F.col("n_regionkey")),
    })
    return out.withColumns({"a": r("a", 6), "me": r("me", 4)})


@query("e44_total", """
select o_orderpriority, round(sum(o_totalprice), 2) v, round((select sum(o_totalprice) from orders), 2) v_total from orders group by 1""")
def _(t: Tables) -> DataFrame:
    return m.with_total(t.raw("orders"), ["o_orderpriority"], "v", F.col("o_totalprice")).withColumns({"v": r("v"), "v_total": r("v_total")})


@query("e30_g5_value_list", """
select coalesce(code_gme, '(vide)') valeur, libelle_long libelle from (select distinct code_gme from v_weeks) left join v_groups on code = code_gme and kind = 'GME'""")
def _(t: Tables) -> DataFrame:
    labels = t.groups.where("kind = 'GME'").select(F.col("code").alias("_c"), "libelle_long")
    rows = t.records.select("code_gme").distinct().join(labels, F.col("code_gme") == F.col("_c"), "left")
    return ex.value_list(rows, F.col("code_gme"), F.col("libelle_long"))


@query("g1_sort_keys", """
select cast(row_number() over (order by u, tri) as int) place, u, semaine, n from (select numero_unite_medicale u, 'S' || substr(numero_semaine, 1, 2) || '-' || substr(numero_semaine, 3, 4) semaine, iso_year * 100 + week tri, count(*) n from v_weeks group by 1, 2, 3)""")
def _(t: Tables) -> DataFrame:
    from wardflow.functions.calendar import week_dimension

    label, sort = week_dimension(F.col("numero_semaine"))
    cells = t.records.groupBy(F.col("numero_unite_medicale").alias("u"), label.alias("semaine"), sort.alias("tri")).agg(F.count("*").alias("n"))
    # the places show the order that the comparison would hide
    return od.numbered(cells, [F.col("u").asc_nulls_last(), F.col("tri").asc_nulls_last()], "place").drop("tri")


@query("g2_rows_by_total", """
select cm, n, cast(row_number() over (order by n desc nulls last, cm nulls last) as int) "rank" from (select substr(code_gme, 1, 2) cm, cast(sum(n_days) as bigint) n from v_in_period group by 1)""")
def _(t: Tables) -> DataFrame:
    totals = t.in_period.groupBy(F.substring("code_gme", 1, 2).alias("cm")).agg(F.sum("n_days").alias("n"))
    return od.numbered(totals, [F.col("n").desc_nulls_last(), F.col("cm").asc_nulls_last()], "rank")


@query("g3_filtered_list", """
select rhs_id, n_days, n1_nb_das, (select count(*) from v_in_period where n_days >= 1 and n1_nb_das >= 1) total from v_in_period where n_days >= 1 and n1_nb_das >= 1""")
def _(t: Tables) -> DataFrame:
    head, total = ex.filtered_list(t.in_period.where("n_days >= 1 and n1_nb_das >= 1"), ["rhs_id", "n_days", "n1_nb_das"], [F.col("rhs_id")])
    return head.withColumn("total", total.scalar())


@query("f6_trend", """
with c as (select finess_epmsi, numero_unite_medicale u, iso_year, cast(sum(n2_nb_csarr) as bigint) v from v_in_period group by 1, 2, 3), l as (select *, lag(v) over (partition by finess_epmsi, u order by iso_year) p from c)
select finess_epmsi, u, iso_year, v, round(case when p is null then null when p = 0 then case when v > 0 then 100 when v < 0 then -100 end else 100.0 * (v - p) / abs(p) end, 6) trend, round(cast(v - p as double), 6) points from l""")
def _(t: Tables) -> DataFrame:
    cells = t.in_period.groupBy("finess_epmsi", F.col("numero_unite_medicale").alias("u"), "iso_year").agg(F.sum("n2_nb_csarr").alias("v"))
    out = od.trend(cells, ["finess_epmsi", "u"], "iso_year", "v")
    out = od.trend(out, ["finess_epmsi", "u"], "iso_year", "v", is_percent=True, name="points")
    return out.withColumns({"trend": r("trend", 6), "points": r("points", 6)})


@query("f7_moving_average", """
with c as (select finess_epmsi, iso_year, week, case when week % 7 = 0 then null else cast(sum(n_days) as double) end v from v_weeks group by finess_epmsi, iso_year, week)
select finess_epmsi, cast(iso_year * 100 + week as int) k, v, round(avg(v) over (partition by finess_epmsi order by iso_year * 100 + week rows between 3 preceding and current row), 6) moving_average from c""")
def _(t: Tables) -> DataFrame:
    cells = t.weeks.groupBy("finess_epmsi", "iso_year", "week").agg(F.sum("n_days").alias("n")).select(
        "finess_epmsi", (F.col("iso_year") * 100 + F.col("week")).alias("k"), F.when(F.col("week") % 7 != 0, F.col("n").cast("double")).alias("v")
    )
    return od.moving_average(cells, ["finess_epmsi"], "k", "v", 4).withColumn("moving_average", r("moving_average", 6))


@query("f10_merged_headers", """
with c as (select finess_epmsi a, iso_year b, numero_unite_medicale c, count(*) n from v_in_period group by 1, 2, 3)
select a, b, c, n, row_number() over (partition by a order by b, c) = 1 show_a, case when row_number() over (partition by a order by b, c) = 1 then count(*) over (partition by a) else 1 end span_a,
  row_number() over (partition by a, b order by c) = 1 show_b, case when row_number() over (partition by a, b order by c) = 1 then count(*) over (partition by a, b) else 1 end span_b from c""")
def _(t: Tables) -> DataFrame:
    cells = t.in_period.groupBy(F.col("finess_epmsi").alias("a"), F.col("iso_year").alias("b"), F.col("numero_unite_medicale").alias("c")).agg(F.count("*").alias("n"))
    return od.merged_headers(cells, ["a", "b", "c"]).drop("show_c", "span_c")


def _sets(dims: list[str], parts: dict[str, str], source: str) -> str:
    """SQL of a pivot over two dimensions and its totals: each part is aggregated on its own rows in every grouping set.

    A part is an aggregate, or ``distinct <columns>: <aggregate>`` over distinct rows.
    """
    out = []
    for own in ([dims[0], dims[1]], [dims[0]], [dims[1]], []):
        keys = ", ".join(["1 one", *own])
        names = ", ".join(["one", *own])
        pieces = []
        for i, (name, text) in enumerate(parts.items()):
            columns, _, aggregate = text.rpartition(": ")
            rows = f"(select distinct {', '.join([*own, columns.removeprefix('distinct ')])} from {source})" if columns else source
            pieces.append(f"(select {keys}, {aggregate} {name} from {rows} group by {names if own else 'one'})" + (f" a{i}" if i == 0 else f" a{i} using ({names})"))
        shown = ", ".join([f"{d} d_{d}" if d in own else f"null d_{d}" for d in dims] + list(parts))
        out.append(f"select {shown} from " + " left join ".join(pieces))
    return " union all ".join(out)


_CROSS = {
    "nb_sejours": "count(distinct finess_epmsi || numero_admin_sejour)", "nb_journees": "cast(sum(n_days) as bigint)",
    "montant": "distinct finess_epmsi, stay, iso_year, rha, montant: round(cast(sum(montant) filter (rha is not null) as double), 2)", "montant_jours": "cast(round(sum(cast(alloc as decimal(18,6))), 2) as double)",
}
_CROSS_ROWS = f"""
{_MATCH}, g as (select m.*, cast(montant_br_sej as double) montant, sum(m.n_days) over g tot, max(m.line_no) over g last_no from m left join v_official v on v.finess_epmsi = m.finess_epmsi and v.stay = m.stay and v.campagne = m.iso_year and v.numero_rha = m.rha
  window g as (partition by m.finess_epmsi, m.stay, m.iso_year, m.rha)),
x as (select g.*, numero_admin_sejour, coalesce(numero_unite_medicale, '(vide)') unite_medicale, coalesce(cast(g.iso_year as varchar), '(vide)') annee_periode,
  case when rha is not null then montant * case when tot > 0 then g.n_days / tot when g.line_no = last_no then 1 else 0 end end alloc from g join v_weeks w using (rhs_id))"""


@query("e38_cross_source_pivot", f"with {_CROSS_ROWS} {_sets(['unite_medicale', 'annee_periode'], _CROSS, 'x')}")
def _(t: Tables) -> DataFrame:
    """Stays and days of the records beside amounts of the valuation, by unit and year with all totals."""
    valuation = t.valuation.withColumn("montant", F.col("montant_br_sej").cast("double"))
    source = ex.with_valuation(ex.record_source(t.weeks), valuation, ["montant"])
    out = source.pivot(["unite_medicale"], ["annee_periode"], [("nb_sejours", "distinct"), ("nb_journees", "sum"), ("valo_montant", "calc"), ("jours_montant", "calc")])
    return out.select(
        "d_unite_medicale", "d_annee_periode", F.col("nb_sejours_distinct").alias("nb_sejours"), F.col("nb_journees_sum").alias("nb_journees"),
        r("valo_montant").alias("montant"), cents("jours_montant").alias("montant_jours"),
    )


_ACT_MEASURES = {
    "nb_actes": "cast(sum(nombre_realisations) as bigint)", "nb_sejours": "count(distinct finess_epmsi || '|' || stay)",
    "tm": "distinct finess_epmsi, stay, tm: round(cast(sum(tm) as double), 2)",
}


@query("e38_acts_and_stays_pivot", f"""
with a as (select rhs_id, 'CSARR' type, nombre_realisations from v_csarr union all select rhs_id, 'CSAR', nombre_realisations from v_csar union all select rhs_id, 'CCAM', nombre_realisations from v_ccam),
x as (select a.*, w.finess_epmsi, w.stay, coalesce(cast(w.iso_year as varchar), '(vide)') annee_periode, montant_facturer_tm * 0.01 tm from a join v_weeks w using (rhs_id) left join v_admin v on v.finess_epmsi = w.finess_epmsi and v.stay = w.stay)
{_sets(['type', 'annee_periode'], _ACT_MEASURES, 'x')}""")
def _(t: Tables) -> DataFrame:
    """Acts of the three nomenclatures beside the stays' own amounts, each stay once in a cell and in a total."""
    acts = ex.act_rows_source("acte", ex.act_source(t.weeks, t.csarr, t.csar, t.ccam), "code_acte", "nombre_realisations")
    source = ex.with_stays(acts, t.admin, {"tm": F.col("montant_facturer_tm") * 0.01}, ["line_no"])
    out = source.pivot(["type"], ["annee_periode"], [("nb_realisations", "sum"), ("nb_sejours", "distinct"), ("vidhosp_tm", "calc")])
    return out.select("d_type", "d_annee_periode", F.col("nb_realisations_sum").alias("nb_actes"), F.col("nb_sejours_distinct").alias("nb_sejours"), r("vidhosp_tm").alias("tm"))


def _child(name: str, table: str, code: str, count: str | None) -> None:
    realised = ", cast(sum(nombre_realisations) as bigint) nb_realisations" if count else ""

    @query(f"e31_{name}_source", f"""
select coalesce(numero_unite_medicale, '(vide)') d_unite_medicale, coalesce(substr({code}, 1, 2), '(vide)') famille, count(*) nb_lignes, count(distinct finess_epmsi || '|' || stay) nb_sejours{realised}
from {table} join v_weeks using (rhs_id) group by 1, 2""")
    def _(t: Tables) -> DataFrame:
        source = ex.child_source(name, t.weeks, getattr(t, name), code, count)
        source.dims["famille"] = F.substring(code, 1, 2)
        asked = [("nb_lignes", "count"), ("nb_sejours", "distinct"), *([("nb_realisations", "sum")] if count else [])]
        cells = source.pivot(["unite_medicale"], ["famille"], asked).where("row_level = 'full' and col_level = 'full'")
        return cells.select("d_unite_medicale", F.col("d_famille").alias("famille"), *[F.col(f"{m}_{how}").alias(m) for m, how in asked])


_child("das", "v_das", "code_das", None)
for _name, _code in (("csarr", "code_principal"), ("csar", "code_principal"), ("ccam", "code_ccam")):
    _child(_name, f"v_{_name}", _code, "nombre_realisations")
