"""Calculated measures: cross-grain counts, conditional and empty aggregates, errors found at registration."""

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from wardflow.functions import measures as m
from wardflow.operators.crossgrain import count_once_per_cell
from wardflow.operators.charts import box_statistics
from wardflow.operators.latest import cap_identical
from wardflow.operators.ordered import fold_smallest, trend
from wardflow.operators.presence import with_week


@pytest.fixture(scope="module")
def rhs(spark):
    rows = [("0875UC1", "A", "2026-01-05", "11111", "00", 3), ("0875UC1", "A", "2026-01-05", "11111", "11", 4), ("0146TB2", "B", "2025-12-01", "10000", "00", 5)]
    df = spark.createDataFrame(rows, "code_gme string, numero_admin_sejour string, date_debut_sejour string, jours_hors_weekend string, jours_weekend string, score_test int")
    return with_week(df.withColumns({"numero_semaine": F.lit("022026"), "finess_epmsi": F.lit("1")}))


@pytest.fixture(scope="module")
def valo(spark):
    return spark.createDataFrame([("A", 2400.0), ("B", 300.0)], "stay string, montant_br_tot double")


def test_sum_of_days(rhs):
    assert rhs.where("stay = 'A'").agg(m.sum_(F.col("n_days").cast("double"))).first()[0] == 12


def test_amount_counts_once_over_two_weeks(rhs, valo):
    base = rhs.where("stay = 'A'")
    amount = count_once_per_cell(base, valo, ["stay"], ["code_gme"], "stay", m.sum_(F.col("montant_br_tot")).alias("s")).first().s
    assert amount / base.agg(F.sum("n_days")).first()[0] == 200


def test_diagnoses_per_stay(spark, rhs):
    das = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "stay string, id int")
    n = count_once_per_cell(rhs.withColumn("one", F.lit(1)), das, ["stay"], ["one"], "id", F.count("id").alias("n")).first().n
    assert n / rhs.agg(m.count_distinct(F.col("stay"))).first()[0] == 1.5


def test_conditional_and_dates(rhs):
    days = F.col("n_days").cast("double")
    row = rhs.agg(m.sum_if(F.col("code_gme") == "0875UC1", days), m.sum_if(m.year(F.col("date_debut_sejour")) == 2026, days)).first()
    assert tuple(row) == (12, 12)


def test_division_by_empty_sum(rhs):
    assert rhs.agg(m.ratio(m.sum_(F.col("n_days").cast("double")), m.sum_if(F.lit(False), F.col("n_days").cast("double")))).first()[0] is None


def test_text_is_summed_only_after_conversion(rhs):
    assert rhs.agg(m.sum_(m.number(F.col("jours_weekend")))).first()[0] == 11


@pytest.mark.parametrize("build", [
    lambda: F.sum("no_such_field"), lambda: F.sum(F.sum("n_days")), lambda: F.col("n_days") + F.sum("n_days"), lambda: F.expr("sum(n_days"), lambda: F.sum(F.array("code_gme")),
])
def test_bad_measures_are_refused(rhs, build):
    with pytest.raises((AnalysisException, PySparkException)):
        m.MeasureBook().register("bad", "rhs", rhs, build)


def test_rounding_to_multiples(spark):
    row = spark.range(1).select(m.round_to(F.lit(12.5), 5), m.round_to(F.lit(-2.5)), m.round_to(F.lit(7.3), 0), m.modulo(F.lit(-7), F.lit(3))).first()
    assert tuple(row) == (15.0, -2.0, 7.0, -1)


def test_cap_and_fold(spark):
    rows = spark.createDataFrame([("r", "a", i) for i in range(5)] + [("r", None, i) for i in range(3)], "p string, c string, seq int")
    assert sorted((r.c or "-", r.seq) for r in cap_identical(rows, "seq").collect()) == [("-", 0), ("-", 1), ("a", 0), ("a", 1)]
    bars = spark.createDataFrame([(chr(97 + i), 10 - i) for i in range(10)], "l string, v int")
    got = {r.l: r.v for r in fold_smallest(bars, "l", "v", 8).collect()}
    assert len(got) == 8 and got["Autres (3)"] == 3 + 2 + 1 and sum(got.values()) == 55


def test_trend_rules(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("a", 3, 0), ("a", 4, 0), ("a", 5, -2)], "k string, y int, v int")
    assert [r.trend for r in trend(rows, ["k"], "y", "v").orderBy("y").collect()] == [None, 100.0, -100.0, None, -100.0]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 10_000, 25_001])
def test_quartiles_against_brute_force(spark, n):
    values = [float((i * 7919) % 1000) + (i % 13) / 8 for i in range(n)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    row = box_statistics(df, ["g"], "v").first()
    s = sorted(values)
    def q(p):
        at = p * (n - 1)
        lo = int(at)
        return s[lo] + (s[min(lo + 1, n - 1)] - s[lo]) * (at - lo)
    assert (row.lowest, row.highest, row.n) == (s[0], s[-1], n)
    assert [row.q1, row.median, row.q3] == pytest.approx([q(0.25), q(0.5), q(0.75)])
