"""Mergeable measures and exact quantiles against brute force, and the shape of their plans."""

import itertools
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from wardflow.functions import mergeable as mg
from wardflow.functions import measures as m
from wardflow.operators import quantiles as qs
from wardflow.operators.charts import box_statistics
from wardflow.operators.pivot import PivotMeasure, calculate, pivot


def rows_of(n=3000, seed=4):
    rng = random.Random(seed)
    pick = lambda: (rng.choice("abc"), rng.choice(["x", "y"]), rng.choice("pq"), rng.choice([None, *range(-3, 9)]), rng.choice(["u", "v", "w", None]), rng.random() < 0.5)
    return [pick() for _ in range(n)] + [("z", "x", "p", None, None, None)] * 3


KIND = "a string, b string, y string, v int, w string, f boolean"


def brute(rows):
    """Every measure of the test over a list of rows, from its definition."""
    v, w = [r[3] for r in rows if r[3] is not None], [r[4] for r in rows if r[4] is not None]
    top = sum(r[3] for r in rows if r[5] and r[3] is not None)
    most = max([w.count(x) for x in w], default=0)
    return {
        "s": float(sum(v)), "n": len(v), "mean": sum(v) / len(v) if v else None, "d": len(set(w)), "med": float(statistics.median(v)) if v else None,
        "mode": min([x for x in w if w.count(x) == most], default=None), "only": v[0] if v and min(v) == max(v) else None, "part": top / sum(v) if v and sum(v) else None, "lo": min(v, default=None),
    }


def measures():
    v, w = F.col("v"), F.col("w")
    return {
        "s": mg.total(v), "n": mg.count(v), "mean": mg.mean(v), "d": mg.distinct(w), "med": mg.median(v), "mode": mg.mode(w), "only": mg.only(v),
        "part": mg.ratio(mg.total_if(F.col("f"), v), mg.total(v)), "lo": mg.least(v),
    }


def same(got, want):
    return got == want or got is not None and want is not None and not isinstance(got, str) and abs(got - want) < 1e-9


def test_totals_are_merged_from_cells(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, KIND).repartition(5)
    asked = [PivotMeasure(n, "calc", x) for n, x in measures().items()]
    got = pivot(df, ["a", "b"], ["y"], asked, row_subtotals=True).collect()
    seen = {}
    for r in got:
        part = [x for x in rows if (r.a is None or x[0] == r.a) and (r.b is None or x[1] == r.b) and (r.y is None or x[2] == r.y)]
        want = brute(part)
        assert part and all(same(r[k], want[k]) for k in want), (r, want)
        seen[(r.a, r.b, r.y)] = (r.row_level, r.col_level)
    every = {tuple(k if keep else None for k, keep in zip(x[:3], kept, strict=True)) for x in rows for kept in itertools.product([True, False], repeat=3) if kept[0] or not kept[1]}
    assert seen.keys() == every and seen[(None, None, None)] == ("none", "none") and seen[("a", None, None)] == ("first", "none")


def test_single_groups_and_no_dimensions(spark):
    rows = rows_of(400)
    df = spark.createDataFrame(rows, KIND)
    for r in calculate(df, ["a"], measures()).collect():
        want = brute([x for x in rows if x[0] == r.a])
        assert all(same(r[k], want[k]) for k in want)
    whole = pivot(df, [], [], [PivotMeasure(n, "calc", x) for n, x in measures().items()]).collect()
    assert len(whole) == 1 and all(same(whole[0][k], x) for k, x in brute(rows).items())
    nothing = pivot(df.limit(0), [], [], [PivotMeasure(n, "calc", x) for n, x in measures().items()]).collect()
    assert len(nothing) == 1 and all(same(nothing[0][k], x) for k, x in brute([]).items())
    assert pivot(df.limit(0), ["a"], [], [PivotMeasure("d", "distinct", F.col("w"))]).where("row_level = 'full'").count() == 0


def expanded_inputs(df):
    """For every Expand of a plan whether an aggregate lies below it, within the same or an earlier stage."""
    text = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(re.match(r"[\s:+\-]*", line)[0])
    out = []
    for i, line in enumerate(text):
        if "Expand [" in line:
            below = itertools.takewhile(lambda x: depth(x) > depth(line), text[i + 1 :])
            out.append(any("Aggregate [" in x for x in below))
    return out


def test_no_source_row_meets_an_expand(spark, tmp_path):
    spark.createDataFrame(rows_of(200), KIND).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    merged = {n: x for n, x in measures().items() if n != "med"}
    found = expanded_inputs(pivot(df, ["a", "b"], ["y"], [PivotMeasure(n, "calc", x) for n, x in merged.items()], row_subtotals=True))
    assert len(found) >= 3 and all(found)


@pytest.mark.parametrize("fit", [150, 10**6])
def test_quantiles_of_many_groups(spark, fit):
    """One huge group, many small ones, ties, NULL keys; narrow brackets give the same ranks."""
    rng = random.Random(fit)
    rows = [("big", rng.randrange(4000) / 4) for _ in range(6000)] + [(f"g{k}", float(rng.randrange(9))) for k in range(60) for _ in range(k % 7 + 1)]
    rows += [(None, 1.0), (None, 4.0), ("ties", 2.5), ("none", None)] + [("ties", 2.5)] * 50
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    counts = qs.value_counts(df, ["g"], F.col("v"))
    probs = {"q1": 0.25, "median": 0.5, "p99": 0.99, "last": 1.0}
    got = {r.g: r for r in qs.quantiles_of_counts(counts, ["g"], probs, fit).collect()}
    assert got.keys() == {g for g, v in rows if v is not None}
    for g, r in got.items():
        s = sorted(v for k, v in rows if k == g and v is not None)
        for name, p in probs.items():
            at = p * (len(s) - 1)
            low, high = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
            assert r[name] == pytest.approx(low + (high - low) * (at - int(at)))
        assert (r._n, r._lowest, r._highest) == (len(s), s[0], s[-1])


def test_slices_are_narrowed(spark):
    """Too few partitions at first: the slices are cut again until they fit."""
    counts = spark.range(5000).select(F.lit("one").alias("g"), F.col("id").cast("double").alias("_v"), F.lit(1).cast("long").alias("_c"))
    ranks = spark.createDataFrame([("one", "a", 0), ("one", "b", 2499), ("one", "c", 4999)], "g string, _q string, _rank long")
    found = qs.select_ranks(counts, ["g"], ranks, rows=1000, fit=800)
    assert {(r._q, r._v) for r in found.collect()} == {("a", 0.0), ("b", 2499.0), ("c", 4999.0)}
    assert len(set(re.findall(r"_part\d+", found._jdf.queryExecution().optimizedPlan().toString()))) >= 2


def test_box_of_a_whole_table(spark):
    df = spark.createDataFrame([(float(k % 97),) for k in range(5000)], "v double")
    row = box_statistics(df, [], "v").first()
    s = sorted(float(k % 97) for k in range(5000))
    assert (row.lowest, row.median, row.highest, row.n) == (s[0], statistics.median(s), s[-1], 5000)


@pytest.mark.parametrize("build", [
    lambda: mg.total(F.col("no_such_field")), lambda: mg.total(F.sum("v")), lambda: mg.apply(lambda a: a + F.col("v"), mg.total(F.col("v"))), lambda: mg.total(F.array("w")),
])
def test_bad_mergeable_measures_are_refused(spark, build):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        m.MeasureBook().register("bad", "rows", spark.createDataFrame(rows_of(5), KIND), build)
    with pytest.raises(ValueError, match="no mergeable state"):
        mg.Part("stddev", F.col("v"))


def test_an_owner_counts_once_in_every_total(spark):
    """Rows of many cells carry one amount of another source: each cell and total has it once."""
    rows = [("a", "x", 1, 10.0), ("a", "x", 1, 10.0), ("a", "y", 1, 10.0), ("b", "x", 1, 10.0), ("b", "y", 2, 5.0), ("b", "y", None, None), ("c", "x", None, None)]
    df = spark.createDataFrame(rows, "a string, y string, o int, v double")
    out = pivot(df, ["a"], ["y"], [PivotMeasure("once", "calc", mg.once(F.col("v"), F.col("o"))), PivotMeasure("n", "count", F.lit(1))]).collect()
    got = {(r.a, r.y): (r.once, r.n) for r in out}
    assert got == {
        ("a", "x"): (10, 2), ("a", "y"): (10, 1), ("b", "x"): (10, 1), ("b", "y"): (5, 2), ("c", "x"): (None, 1), ("a", None): (10, 3), ("b", None): (15, 3), ("c", None): (None, 1),
        (None, "x"): (10, 4), (None, "y"): (15, 3), (None, None): (15, 7),
    }
    with pytest.raises(ValueError):
        mg.Part("once", F.col("v"))
    with pytest.raises(ValueError):
        mg.once(F.col("v"), F.col("o")).column()
