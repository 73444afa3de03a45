"""NULL is a group like any other; limits are the caller's; places come without one task."""

from pyspark.sql import functions as F

from wardflow.operators import charts, ordered, pivot


def rows(spark):
    return spark.createDataFrame([("a", "x", 1.0), (None, "x", 3.0), (None, None, 4.0)], "g string, h string, v double")


def test_shares_keep_null_groups(spark):
    got = {(r.g, r.h): r.p for r in ordered.share_of(rows(spark), ["g"], "v", "p").collect()}
    assert got == {("a", "x"): 100.0, (None, "x"): 300.0 / 7, (None, None): 400.0 / 7}


def test_folds_keep_null_groups(spark):
    got = {(r.g, r.h): r.v for r in ordered.fold_smallest(rows(spark), "h", "v", 8, ["g"]).collect()}
    assert got == {("a", "x"): 1.0, (None, "x"): 3.0, (None, None): 4.0}
    series = {(r.g, r.h): r.v for r in ordered.fold_series(rows(spark), "g", ["h"], "v", 8).collect()}
    assert series == got


def test_value_tree(spark):
    whole = charts.value_tree(rows(spark), ["g", "h"], F.sum("v")).collect()
    assert sorted((r.depth, r.value) for r in whole) == [(0, 8.0), (1, 1.0), (1, 7.0), (2, 1.0), (2, 3.0), (2, 4.0)]
    folded = charts.value_tree(rows(spark), ["g", "h"], F.sum("v"), cap=8).collect()
    assert sorted((r.depth, r.value) for r in folded) == sorted((r.depth, r.value) for r in whole)
    assert sum(r.value for r in charts.value_tree(rows(spark), ["g", "h"], F.sum("v"), cap=1).where("depth = 1").collect()) == 8.0


def test_percentages_of_null_side(spark):
    cells = pivot.pivot(rows(spark), ["g"], ["h"], [pivot.PivotMeasure("n", "sum", F.col("v"))])
    got = pivot.percentages(cells, ["g"], ["h"], "n", "row", "pct").where("row_level = 'full' and col_level = 'full'").collect()
    assert {(r.g, r.h): round(r.pct, 6) for r in got} == {("a", "x"): 100.0, (None, "x"): round(300 / 7, 6), (None, None): round(400 / 7, 6)}


def test_numbered(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7 % 1000).alias("k"))
    assert {r.k: r.place for r in ordered.numbered(df, [F.col("k").desc()], "place").collect()} == {k: 1000 - k for k in range(1000)}
    assert ordered.numbered(df.limit(0), [F.col("k")], "place").count() == 0


def test_no_limit_by_default(spark):
    many = spark.range(700).select(F.col("id").cast("string").alias("f"), F.lit(1).alias("v"))
    assert charts.facets(many, "f", [], F.sum("v").alias("n")).count() == 700
    assert charts.facets(many, "f", [], F.sum("v").alias("n"), cap=12).count() == 12
