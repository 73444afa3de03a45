"""Scalar semantics of calculated measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.bindings.q_valuation import r
from wardflow.bindings.registry import query
from wardflow.bindings.tables import Tables
from wardflow.functions import measures as m


@query("i1_i2_conditional", """
select dependance_relation v, case when dependance_relation = '2' then 'deux' else 'autre' end a, case when dependance_relation = '2' then 'deux' end b, dependance_relation is null c, count(*) n from v_weeks group by all""")
def _(t: Tables) -> DataFrame:
    v = F.col("dependance_relation")
    return t.records.groupBy(v.alias("v"), m.if_(v == "2", F.lit("deux"), F.lit("autre")).alias("a"), m.if_(v == "2", F.lit("deux")).alias("b"), m.is_null(v).alias("c")).agg(F.count("*").alias("n"))


@query("i3_i5_numeric", """
select c_custkey, floor(c_acctbal / 5 + 0.5) * 5 rond, floor(c_acctbal / 0.5 + 0.5) * 0.5 rond_demi, abs(c_acctbal) ab, c_custkey % 7 mo, cast(null as bigint) mo0 from customer""")
def _(t: Tables) -> DataFrame:
    bal, key = F.col("c_acctbal"), F.col("c_custkey")
    return t.raw("customer").select(
        key, m.round_to(bal, 5).alias("rond"), m.round_to(bal, 0.5).alias("rond_demi"), F.abs(bal).alias("ab"), m.modulo(key, F.lit(7)).alias("mo"), m.modulo(key, F.lit(0)).cast("bigint").alias("mo0"),
    )


@query("i6_i7_text", """
select x, substr(coalesce(x, ''), 1, 4) l4, '' l0, substr(coalesce(x, ''), 1, 99) l99, case when length(coalesce(x, '')) <= 3 then coalesce(x, '') else right(x, 3) end r3, length(coalesce(x, '')) len, upper(coalesce(x, '')) up, lower(coalesce(x, '')) lo, trim('  ' || coalesce(x, '')) tr, count(*) n
from (select case when p_partkey % 10 = 0 then null when p_partkey % 10 = 1 then '' else p_brand end x from part) group by all""")
def _(t: Tables) -> DataFrame:
    x = F.col("x")
    rows = t.part.selectExpr("case when p % 10 = 0 then null when p % 10 = 1 then '' else p_brand end x")
    return rows.groupBy("x").agg(F.count("*").alias("n")).select(
        "x", m.left(x, 4).alias("l4"), m.left(x, 0).alias("l0"), m.left(x, 99).alias("l99"), m.right(x, 3).alias("r3"), F.col("n"),
        m.length(x).cast("bigint").alias("len"), m.upper(x).alias("up"), m.lower(x).alias("lo"), m.trim(F.concat(F.lit("  "), m.text(x))).alias("tr"),
    )


@query("i8_dates", """
select d, year(try_cast(d as date)) y, month(try_cast(d as date)) mo, count(*) n from (select case when o_orderkey % 9 = 0 then '2001-02-30' when o_orderkey % 9 = 1 then null else strftime(o_orderdate, '%Y-%m-%d') end d from orders) group by all""")
def _(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("case when o_orderkey % 9 = 0 then '2001-02-30' when o_orderkey % 9 = 1 then null else order_day end d")
    return rows.groupBy("d").agg(F.count("*").alias("n")).withColumns({"y": m.year(F.col("d")).cast("bigint"), "mo": m.month(F.col("d")).cast("bigint")})


@query("i9_range_sum", """
select rhs_id, cast(coalesce(cast(dependance_habillage_toilette as int), 0) + coalesce(cast(dependance_deplacement as int), 0) + n1_nb_das as double) s from v_weeks""")
def _(t: Tables) -> DataFrame:
    return t.records.select("rhs_id", m.range_sum(F.col("dependance_habillage_toilette"), F.col("dependance_deplacement"), F.col("n1_nb_das")).alias("s"))


@query("i10_i11_conversion", """
select x, try_cast(nullif(regexp_extract(x, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') as double) num, coalesce(x, '') txt, count(*) n
from (select case p_partkey % 5 when 0 then cast(p_size as varchar) || ' jours' when 1 then 'abc' when 2 then ' -' || cast(p_retailprice as varchar) when 3 then null else cast(p_size as varchar) || '.5e1x' end x from part) group by all""")
def _(t: Tables) -> DataFrame:
    rows = t.part.selectExpr(
        "case p % 5 when 0 then concat(p_size, ' jours') when 1 then 'abc' when 2 then concat(' -', cast(p_retailprice as string)) when 3 then null else concat(p_size, '.5e1x') end x"
    )
    return rows.groupBy("x").agg(F.count("*").alias("n")).select("x", m.number(F.col("x")).alias("num"), m.text(F.col("x")).alias("txt"), "n")


@query("i12_arithmetic", """
select l_quantity a, l_discount b, l_quantity + l_discount p, l_quantity - l_discount s, round(l_quantity * l_discount, 8) t, round(l_quantity / nullif(l_discount, 0), 8) q, cast(null as double) bad, count(*) n from lineitem group by all""")
def _(t: Tables) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    rows = t.raw("lineitem").groupBy(F.col("l_quantity").alias("a"), F.col("l_discount").alias("b")).agg(F.count("*").alias("n"))
    return rows.select(
        "a", "b", "n", m.arithmetic(a, "+", b).alias("p"), m.arithmetic(a, "-", b).alias("s"), r(m.arithmetic(a, "*", b), 8).alias("t"),
        r(m.arithmetic(a, "/", b), 8).alias("q"), m.arithmetic(a, "+", F.lit("abc")).alias("bad"),
    )


@query("i13_i14_comparison_and_logic", """
select x, y, x = y or coalesce(try_cast(x as double) = try_cast(y as double), false) eq, not (x = y or coalesce(try_cast(x as double) = try_cast(y as double), false)) ne, try_cast(x as double) < try_cast(y as double) lt, try_cast(x as double) >= try_cast(y as double) ge,
  coalesce(x = '2', false) and coalesce(y = '2', false) et, coalesce(x = '2', false) or coalesce(y = '2', false) ou, not coalesce(x = '2', false) non, count(*) n
from (select dependance_relation x, case when n1_nb_das = 1 then dependance_comportement when n1_nb_das = 0 then dependance_comportement || '.0' end y from v_weeks) group by all""")
def _(t: Tables) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    rows = t.records.selectExpr("dependance_relation x", "case when n1_nb_das = 1 then dependance_comportement when n1_nb_das = 0 then concat(dependance_comportement, '.0') end y")
    return rows.groupBy("x", "y").agg(F.count("*").alias("n")).select(
        "x", "y", "n", m.compare(x, "=", y).alias("eq"), m.compare(x, "<>", y).alias("ne"), m.compare(x, "<", y).alias("lt"), m.compare(x, ">=", y).alias("ge"),
        m.both(x == "2", y == "2").alias("et"), m.either(x == "2", y == "2").alias("ou"), m.negate(x == "2").alias("non"),
    )


@query("e42_sum_if", """
select finess_epmsi, coalesce(cast(sum(n_days) filter (code_gme like '01%') as double), 0.0) jours_cm01, coalesce(cast(sum(n_days) filter (year(cast(date_debut_sejour as date)) = 1999) as double), 0.0) jours_1999, coalesce(cast(sum(n_days) filter (code_gme = 'zz') as double), 0.0) rien from v_weeks group by 1""")
def _(t: Tables) -> DataFrame:
    days = F.col("n_days").cast("double")
    return t.weeks.groupBy("finess_epmsi").agg(
        m.sum_if(m.left(F.col("code_gme"), 2) == "01", days).alias("jours_cm01"), m.sum_if(m.year(F.col("date_debut_sejour")) == 1999, days).alias("jours_1999"),
        m.sum_if(F.col("code_gme") == "zz", days).alias("rien"),
    )


@query("i15_measure_book", """
select numero_unite_medicale u, round(sum(n2_nb_csarr) / nullif(sum(n_days), 0), 6) actes_par_jour, count(distinct stay) n_sejours from v_weeks group by 1""")
def _(t: Tables) -> DataFrame:
    book = m.MeasureBook()
    book.register("actes_par_jour", "rhs", t.weeks, lambda: m.ratio(F.sum("n2_nb_csarr"), F.sum("n_days")))
    book.register("n_sejours", "rhs", t.weeks, lambda: m.count_distinct(F.col("stay")))
    out = t.weeks.groupBy(F.col("numero_unite_medicale").alias("u")).agg(*book.columns("actes_par_jour", "n_sejours"))
    return out.withColumn("actes_par_jour", r("actes_par_jour", 6))
