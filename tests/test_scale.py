"""Plans whose cost has to grow with the rows: narrow stored rows, one rendering pass, loads that do not rewrite the table."""

import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from wardflow.bindings.lines import weekly_rows
from wardflow.bindings.tables import Tables
from wardflow.functions import mergeable as mg
from wardflow.operators.allocation import value_of
from wardflow.operators.crossgrain import match_other_source
from wardflow.operators.pivot import PivotMeasure, pivot
from wardflow.operators.presence import week_profile
from wardflow.plans import dashboard as dash
from wardflow.plans import periods as per
from wardflow.sources import store


@pytest.fixture()
def tables(spark, tmp_path):
    days = "timestamp '1997-03-03 00:00:00' + make_interval(0, 0, 0, id * 3)"
    spark.range(40).selectExpr(
        "cast(id div 4 as bigint) l_orderkey", "id l_partkey", "id l_suppkey", "cast(id % 4 as int) l_linenumber", "cast(id as double) l_quantity",
        "cast(id as double) l_extendedprice", "0.0d l_discount", "0.0d l_tax", "substring('ANR', cast(id % 3 as int) + 1, 1) l_returnflag",
        "substring('OF', cast(id % 2 as int) + 1, 1) l_linestatus", f"{days} l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(10).selectExpr(
        "id o_orderkey", "id o_custkey", "'F' o_orderstatus", "1.0d o_totalprice", "timestamp '1997-03-01 00:00:00' o_orderdate", "concat(cast(1 + id % 2 as string), '-X') o_orderpriority",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    return Tables(spark, str(tmp_path))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_weekly_table_stores_narrow_rows(spark, tables):
    """The forty wide columns are derived where they are used."""
    assert sorted(map(str, tables.weeks.collect())) == sorted(map(str, tables.weeks.select("*").collect()))
    stored = spark.read.parquet(tables.kept("weeks", lambda path: None))
    assert len(stored.columns) < 20 < len(tables.weeks.columns)


def test_custom_period_is_judged_per_year_not_per_record(spark):
    """the condition on the weeks stays above the aggregate."""
    rows = spark.range(20).selectExpr("'1' finess_epmsi", "cast(1997 + id % 2 as int) iso_year")
    out = per.custom_periods(rows, (3, 1), (15, 9))
    lines = plan(out).split("\n")
    aggregate = next(i for i, line in enumerate(lines) if "Aggregate" in line)
    assert not any("try_to_date" in line or "gettimestamp" in line or "format_string" in line for line in lines[aggregate + 1:])
    assert {(r.iso_year, r.min_week, r.max_week) for r in out.collect()} == {(1997, 1, 38), (1998, 1, 38)}


def test_indicators_read_records_once(spark):
    """one join with the records, which is never a broadcast of them."""
    records = spark.range(6).selectExpr("cast(id div 2 as string) rhs_id", "'1' finess_epmsi", "1997 iso_year", "'unit' axis", "cast(id % 2 as string) axis_value", "2L n_days", "1L n1_nb_das", *[f"cast(1 as string) dependance_{x}" for x in ("habillage_toilette", "deplacement", "alimentation", "continence", "comportement", "relation")])
    acts = spark.range(8).selectExpr("cast(id % 2 as string) rhs_id", "cast(id as int) seq", "'A' code_principal", "cast(null as string) code_modulateur_lieu", "3 nombre_realisations")
    das = spark.range(2).selectExpr("cast(id as string) rhs_id", "0 seq", "'D' code_das")
    out = dash.indicators(records, acts, acts.where("false"), das, ["finess_epmsi", "iso_year", "axis", "axis_value"])
    assert plan(out).count("Join") == 1 and "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    # at most two alike acts of a record count: records 0 and 1 have 6 each, record 2 none
    assert [(r.nb_csarr, r.nb_diag_approx) for r in out.collect()] == [(12, 2)] * 2


def test_lines_of_all_versions_in_one_pass(spark, tables):
    """The line items are read once for the records and once for each block."""
    assert plan(weekly_rows(tables)).count("Relation") == 6


def test_load_does_not_rewrite_the_table(spark, tmp_path):
    """a small load leaves the files of the table as they are, until loads are as large as it is."""
    table = store.Table(str(tmp_path / "t"), ["f", "k"], ["o"], ["f"])
    table.upsert(spark.range(2000).selectExpr("'a' f", "id k", "0 o"))
    files = lambda: {x for folder, _, names in os.walk(tmp_path / "t") for x in names if x.endswith(".parquet")}
    before = files()
    table.upsert(spark.range(1).selectExpr("'a' f", "id k", "1 o"))
    assert files() == before
    table.upsert(spark.range(3000).selectExpr("'b' f", "id k", "2 o"))
    assert not os.path.exists(table.loads)
    rows = table.read(spark)
    assert rows.count() == 5000 and rows.where("f = 'a' and k = 0").first().o == 1
    table.upsert(spark.range(1).selectExpr("'b' f", "id k", "3 o"))
    assert table.drop(spark, "b") and table.read(spark).where(F.col("f") == "b").count() == 0


def test_pivot_reads_its_rows_once(spark):
    """Rows that several parts read are stored before, so what makes them (here 40 rows) runs once."""
    read = spark.sparkContext.accumulator(0)
    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch
    rows = spark.range(40).selectExpr("cast(id % 2 as string) r", "cast(id % 4 as string) c", "id div 4 v", "cast(id as double) x").mapInArrow(seen, "r string, c string, v long, x double")
    once = mg.once(F.col("x"), F.struct("v"))
    out = pivot(rows, ["r"], ["c"], [PivotMeasure("n", "count", F.col("v")), PivotMeasure("d", "distinct", F.col("v")), PivotMeasure("o", "calc", once)]).collect()
    assert read.value == 40
    cells = {(row.r, row.c, row.row_level, row.col_level): (row.n, row.d, row.o) for row in out}
    assert cells[None, None, "none", "none"] == (40, 10, sum(4 * k + 3 for k in range(10)))
    assert cells["1", "3", "full", "full"] == (10, 10, sum(4 * k + 3 for k in range(10))) and len(cells) == 4 + 2 + 4 + 1
    assert pivot(rows.where("false"), ["r"], ["c"], [PivotMeasure("d", "distinct", F.col("v"))]).collect() == []


def test_other_source_is_joined_once(spark):
    """F8: the three rules of a match (week, year, stay) in one join, with the rows that three joins gave."""
    base = spark.createDataFrame([(1, "f", "s", 2020, 5), (2, "f", "s", 2020, 6), (3, "f", "s", 2021, 5), (4, "f", "s", None, 5), (5, "f", "t", 2020, 5), (6, None, "s", 2020, 5), (7, "f", "s", 2020, None)], "id int, f string, s string, y int, w int")
    other = spark.createDataFrame([("f", "s", 2020, 5, "b"), ("f", "s", 2020, 5, "c"), ("f", "s", 2020, None, "d"), ("f", "s", None, 5, "a"), ("f", "s", 2020, 9, "e"), (None, "s", 2020, 5, "a")], "f string, s string, oy int, ow int, k string")
    out = match_other_source(base, other, ["f", "s"], "y", "w", "oy", "ow", ["k"], ["k"])
    assert plan(out).count("Join") == 1
    assert {r.id: (r.o_k, r.matched) for r in out.collect()} == {1: ("b", True), 2: ("b", True), 3: (None, False), 4: ("a", True), 5: (None, False), 6: (None, False), 7: ("b", True)}


def test_value_has_no_window_by_stay(spark, tables):
    """entries of stays and campaigns are aggregates; weeks without their units give the same value."""
    assert "Window" not in plan(week_profile(tables.weeks, by_unit=False).select("stay", "monday", "days", "n_week"))
    shown = ["finess_epmsi", "stay", "campagne", "billing_case", "monday"]
    value = lambda df: sorted(map(tuple, df.groupBy(*shown).agg(*[F.sum(value_of(F.col("days")[i])) for i in range(7)]).collect()))
    assert value(tables.weekly_value) == value(tables.whole_weekly_value) != []
    assert plan(tables.whole_weekly_value).count("Window") < plan(tables.weekly_value).count("Window")


def test_blocks_are_counted_before_the_records(tables):
    """the associated diagnoses are counted per record before they meet the records."""
    out = queries()["e38_sources_side_by_side"](tables.spark, tables.folder)
    lines = plan(out).split("\n")
    join = next(i for i, line in enumerate(lines) if "Join" in line and "rhs_id" in line)
    assert any("Aggregate [rhs_id" in line for line in lines[join + 1:])
    assert sum(r.nb_das or 0 for r in out.collect()) == 20
