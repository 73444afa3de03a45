"""Chart dataset queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.bindings.q_valuation import r
from wardflow.bindings.registry import query
from wardflow.bindings.tables import Tables
from wardflow.operators import charts as ch
from wardflow.operators import ordered as od


@query("e45_box_statistics", """
select l_returnflag, l_linestatus, min(l_extendedprice) lowest, round(quantile_cont(l_extendedprice, 0.25), 4) q1, round(quantile_cont(l_extendedprice, 0.5), 4) median, round(quantile_cont(l_extendedprice, 0.75), 4) q3, max(l_extendedprice) highest, count(*) n from lineitem group by 1, 2""")
def _(t: Tables) -> DataFrame:
    return _rounded(ch.box_statistics(t.raw("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"))


@query("e45_box_statistics_events", """
select event_type, min(value) lowest, round(quantile_cont(value, 0.25), 4) q1, round(quantile_cont(value, 0.5), 4) median, round(quantile_cont(value, 0.75), 4) q3, max(value) highest, count(*) n from events group by 1""")
def _(t: Tables) -> DataFrame:
    return _rounded(ch.box_statistics(t.raw("events"), ["event_type"], "value"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r(c, 4) for c in ("q1", "median", "q3")})


@query("e46_histogram", """
with s as (select min(value) lo, max(value) hi, count(value) n from events), k as (select lo, hi, greatest(5, least(20, cast(ceil(log2(n + 1)) as int) + 1)) k from s)
select event_type, cast(greatest(0, least(floor((value - lo) / ((hi - lo) / k)), k - 1)) as bigint) bin, round(lo + greatest(0, least(floor((value - lo) / ((hi - lo) / k)), k - 1)) * ((hi - lo) / k), 6) bin_start, count(*) n from events, k group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    return ch.histogram(t.raw("events"), "value", ["event_type"]).withColumn("bin_start", r("bin_start", 6))


@query("e47_value_tree", """
select cast(3 - (grouping(p_brand) + grouping(p_type) + grouping(p_size)) as int) depth, p_brand b, p_type y, cast(p_size as varchar) z, round(sum(p_retailprice), 2) "value" from part group by rollup (p_brand, p_type, p_size)""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("part").select(F.col("p_brand").alias("b"), F.col("p_type").alias("y"), F.col("p_size").cast("string").alias("z"), "p_retailprice")
    return ch.value_tree(rows, ["b", "y", "z"], r(F.sum("p_retailprice")))


@query("e47_value_tree_folded", """
with l1 as (select b, v, row_number() over (order by v desc, b) rn, count(*) over () n from (select p_brand b, round(sum(p_retailprice), 2) v from part group by 1)),
l2 as (select b, y, v, row_number() over (partition by b order by v desc, y) rn, count(*) over (partition by b) n from (select p_brand b, p_type y, round(sum(p_retailprice), 2) v from part group by 1, 2) where b in (select b from l1 where n <= 8 or rn < 8)),
l3 as (select b, y, z, v, row_number() over (partition by b, y order by v desc, z) rn, count(*) over (partition by b, y) n from (select p_brand b, p_type y, cast(p_size as varchar) z, round(sum(p_retailprice), 2) v from part group by 1, 2, 3) where (b, y) in (select (b, y) from l2 where n <= 8 or rn < 8))
select 0 depth, null b, null y, null z, round(sum(p_retailprice), 2) "value" from part
union all select 1, case when n <= 8 or rn < 8 then b else 'Autres (' || cast(n - 7 as varchar) || ')' end, null, null, round(sum(v), 2) from l1 group by 2
union all select 2, b, case when n <= 8 or rn < 8 then y else 'Autres (' || cast(n - 7 as varchar) || ')' end, null, round(sum(v), 2) from l2 group by 2, 3
union all select 3, b, y, case when n <= 8 or rn < 8 then z else 'Autres (' || cast(n - 7 as varchar) || ')' end, round(sum(v), 2) from l3 group by 2, 3, 4""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("part").select(F.col("p_brand").alias("b"), F.col("p_type").alias("y"), F.col("p_size").cast("string").alias("z"), "p_retailprice")
    return ch.value_tree(rows, ["b", "y", "z"], r(F.sum("p_retailprice")), cap=8).withColumn("value", r("value"))


@query("e48_flows", """
with c as (select n_name s, p_brand t, cast(sum(l_quantity) as double) v from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join part on p_partkey = l_partkey group by 1, 2),
a as (select s, row_number() over (order by sum(v) desc, s) rn, count(*) over () n from c group by 1), b as (select t, row_number() over (order by sum(v) desc, t) rn, count(*) over () n from c group by 1)
select case when a.n <= 8 or a.rn < 8 then s else 'Autres (' || cast(a.n - 7 as varchar) || ')' end src, case when b.n <= 8 or b.rn < 8 then t else 'Autres (' || cast(b.n - 7 as varchar) || ')' end dst, sum(v) "value" from c join a using (s) join b using (t) group by 1, 2""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").join(t.raw("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t.raw("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(
        t.raw("part"), F.col("p_partkey") == F.col("l_partkey")
    ).select(F.col("n_name").alias("src"), F.col("p_brand").alias("dst"), "l_quantity")
    return ch.flows(rows, "src", "dst", F.sum("l_quantity"), cap=8)


@query("e49_facets", """
select p_brand, l_returnflag, count(*) n, cast(sum(l_quantity) as double) q from lineitem join part on p_partkey = l_partkey group by 1, 2""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").join(t.raw("part"), F.col("p_partkey") == F.col("l_partkey"))
    return ch.facets(rows, "p_brand", ["l_returnflag"], F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@query("e50_fold_smallest", """
with c as (select finess_epmsi, substr(code_gme, 1, 2) cm, count(*) v from v_in_period group by 1, 2), k as (select *, row_number() over (partition by finess_epmsi order by v desc, cm nulls first) rn, count(*) over (partition by finess_epmsi) n from c)
select finess_epmsi, case when n <= 8 or rn < 8 then cm else 'Autres (' || cast(n - 7 as varchar) || ')' end cm, not (n <= 8 or rn < 8) folded, cast(sum(v) as bigint) v from k group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    cells = t.in_period.groupBy("finess_epmsi", F.substring("code_gme", 1, 2).alias("cm")).agg(F.count("*").alias("v"))
    return od.fold_smallest(cells, "cm", "v", 8, ["finess_epmsi"])


@query("e50_fold_series", """
with c as (select p_brand b, l_returnflag f, cast(sum(l_quantity) as double) v from lineitem join part on p_partkey = l_partkey group by 1, 2), t as (select b, row_number() over (order by sum(v) desc, b) rn, count(*) over () n from c group by 1)
select case when n <= 8 or rn < 8 then b else 'Autres (' || cast(n - 7 as varchar) || ')' end serie, f, sum(v) v from c join t using (b) group by 1, 2""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").join(t.raw("part"), F.col("p_partkey") == F.col("l_partkey"))
    cells = rows.groupBy(F.col("p_brand").alias("serie"), F.col("l_returnflag").alias("f")).agg(F.sum("l_quantity").alias("v"))
    return od.fold_series(cells, "serie", ["f"], "v", 8)


@query("e51_points", """
select o_custkey k, round(avg(o_totalprice), 6) x, count(*) y, round(sum(o_totalprice) filter (o_orderstatus = 'O'), 2) "size" from orders group by 1""")
def _(t: Tables) -> DataFrame:
    total = F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")))
    return ch.points(t.raw("orders").withColumn("k", F.col("o_custkey")), ["k"], r(F.avg("o_totalprice"), 6), F.count("*"), r(total))


@query("e52_heat_grid", """
with c as (select o_orderpriority, cast(month(o_orderdate) as int) mois, round(avg(o_totalprice), 4) v from orders group by 1, 2) select o_orderpriority, mois, v "value", min(v) over () lowest, max(v) over () highest from c""")
def _(t: Tables) -> DataFrame:
    return ch.heat_grid(t.raw("orders").withColumn("mois", F.month("o_orderdate")), "o_orderpriority", "mois", r(F.avg("o_totalprice"), 4))


@query("e53_series_with_shares", """
with c as (select iso_year, numero_unite_medicale u, cast(sum(n_days) as bigint) v from v_in_period group by 1, 2)
select iso_year, u, v "value", round(100.0 * v / sum(v) over (partition by iso_year), 6) pct_category, round(100.0 * v / sum(v) over (partition by u), 6) pct_series, round(100.0 * v / sum(v) over (), 6) pct_total from c""")
def _(t: Tables) -> DataFrame:
    out = ch.series(t.in_period.withColumn("u", F.col("numero_unite_medicale")), "iso_year", "u", F.sum("n_days"))
    return out.withColumns({c: r(c, 6) for c in ("pct_category", "pct_series", "pct_total")})
