"""Golden cases of the proration and its invariants."""

import pytest
from pyspark.sql import functions as F

from wardflow.operators.allocation import daily_value, days_of, weekly_value
from wardflow.operators.presence import last_unit, with_week
from wardflow.plans import valuation as val
from wardflow.plans.periods import reporting_periods

F1 = "680000009"


def records(spark, rows):
    """(nda, week code, flags, unit)"""
    data = [(F1, nda, w, f[:5], f[5:], u, "1", "f", i) for i, (nda, w, f, u) in enumerate(rows)]
    return with_week(spark.createDataFrame(data, (
        "finess_epmsi string, numero_admin_sejour string, numero_semaine string, jours_hors_weekend string, jours_weekend string,"
        "numero_unite_medicale string, type_hospitalisation string, source_file string, line_no bigint"
    )))


def amounts(spark, rows):
    """(stay, campaign, year-week, rha, amount)"""
    data = [(F1, s, s, c, w, r, "C", a, 0, 0, 0, "0875UC1") for s, c, w, r, a in rows]
    df = spark.createDataFrame(data, (
        "finess_epmsi string, numero_admin_sejour string, stay string, campagne int, numero_semaine string, numero_rha string, type_hospitalisation string,"
        "a double, nv_chain int, nv_attente_dts int, nv_nonfactam int, code_gme string"
    ))
    return df.withColumns({"montant_br_sej": F.col("a").cast("decimal(18,2)"), "montant_br_tot": F.col("a").cast("decimal(18,2)")})


def admin(spark, rows):
    return spark.createDataFrame([(F1, s, d) for s, d in rows], "finess_epmsi string, stay string, date_entree string")


def days(df):
    return {(r.stay, r.campagne, str(r.day)): (r.billing_case, r.entries, round(r.value, 6), r.unit) for r in df.collect()}


def test_four_cases(spark):
    weeks = records(spark, [
        ("0001", "522024", "1100000", "A"), ("0001", "012025", "1000000", "B"),  # one campaign over New Year
        ("0002", "502024", "1000000", "A"), ("0002", "102025", "1100000", "A"),  # two campaigns
        ("0003", "102025", "1000000", "A"), ("0003", "112025", "1100000", "A"),  # weekly rows
        ("0004", "102025", "0000000", "A"), ("0004", "112025", "0000000", "A"),  # no day
        ("0005", "532025", "1111111", "A"),  # a week 2025 does not have
    ])
    valo = amounts(spark, [
        ("1", 2024, "202401", "000", 300.0), ("2", 2024, "202401", "000", 50.0), ("2", 2025, "202501", "000", 80.0),
        ("3", 2025, "202510", "001", 10.0), ("3", 2025, "202511", "002", 30.0), ("3", 2025, "202512", "003", 99.0),
        ("4", 2025, "202501", "000", 70.0), ("5", 2025, "202501", "000", 60.0), ("9", 2025, "202501", "000", 0.0),
    ])
    got = days(daily_value(weeks, valo, admin(spark, [("4", "2025-03-05"), ("1", "2024-12-01")])))
    assert got == {
        ("1", 2024, "2024-12-23"): (2, 1, 100.0, "A"), ("1", 2024, "2024-12-24"): (2, 1, 100.0, "A"), ("1", 2024, "2024-12-30"): (2, 1, 100.0, "B"),
        ("2", 2024, "2024-12-09"): (1, 1, 50.0, "A"), ("2", 2025, "2025-03-03"): (1, 1, 40.0, "A"), ("2", 2025, "2025-03-04"): (1, 1, 40.0, "A"),
        ("3", 2025, "2025-03-03"): (4, 1, 10.0, "A"), ("3", 2025, "2025-03-10"): (4, 1, 15.0, "A"), ("3", 2025, "2025-03-11"): (4, 1, 15.0, "A"),
        ("4", 2025, "2025-03-05"): (3, 1, 70.0, None),
    }


def test_same_day_in_two_units_counts_twice_for_the_later_one(spark):
    weeks = records(spark, [("1", "102025", "1100000", "A"), ("1", "102025", "1000000", "B")])
    got = days(daily_value(weeks, amounts(spark, [("1", 2025, "202501", "000", 30.0)]), admin(spark, [])))
    assert got == {("1", 2025, "2025-03-03"): (2, 2, 20.0, "B"), ("1", 2025, "2025-03-04"): (2, 1, 10.0, "A")}


def test_units_add_up_to_total(spark):
    weeks = records(spark, [
        ("1", "012025", "1111111", "A"), ("1", "022025", "1100000", "B"), ("2", "022025", "0000000", "C"), ("3", "452025", "1000000", "A"),
    ])
    valo = amounts(spark, [("1", 2025, "202501", "000", 90.0), ("2", 2025, "202501", "000", 5.0), ("3", 2025, "202501", "000", 7.0)])
    periods = reporting_periods(weeks, month=3)
    total = val.comparable_amount(valo, weeks, periods).first()
    units = {r.unite: round(r.montant, 6) for r in val.amount_by_unit(valo, weeks, periods).collect()}
    assert float(total.montant_br_tot) == 95.0 and units == {"A": 70.0, "B": 20.0, "C": 5.0}


def test_last_unit_year_flag(spark):
    weeks = records(spark, [("1", "522024", "1000000", "A"), ("1", "022025", "1000000", "B")])
    assert last_unit(weeks).first().last_unit == "B"
    assert last_unit(weeks, year_aware=False).first().last_unit == "A"


def test_blocked_rows_are_lost_revenue(spark):
    weeks = records(spark, [("1", "012025", "1000000", "A"), ("2", "012025", "1000000", "A")])
    valo = amounts(spark, [("1", 2025, "202501", "000", 10.0), ("2", 2025, "202501", "000", 4.0)]).withColumn("nv_chain", F.expr("case when stay = '2' then 1 end"))
    row = val.comparable_amount(valo, weeks, reporting_periods(weeks)).first()
    assert [float(x) for x in (row.montant_br_tot, row.montant_br_tot_sans_filtre, row.montant_br_non_fact)] == [10.0, 14.0, 4.0]


@pytest.mark.parametrize("year,week,monday", [(2020, 53, "2020-12-28"), (2021, 53, None), (2021, 1, "2021-01-04"), (2024, 0, None)])
def test_iso_weeks(spark, year, week, monday):
    from wardflow.functions.calendar import iso_monday

    got = spark.range(1).select(iso_monday(F.lit(year), F.lit(week)).cast("string").alias("d")).first().d
    assert got == monday


def test_equal_line_numbers_of_two_files_count_once(spark):
    """Two records of one stay and week, on the same line of two files, share a day: it has one owner."""
    base = records(spark, [("0001", "102025", "1000000", "A"), ("0001", "102025", "1000000", "B")])
    weeks = base.withColumns({"line_no": F.lit(5).cast("bigint"), "source_file": F.when(F.col("numero_unite_medicale") == "A", "f1").otherwise("f2")})
    got = daily_value(weeks, amounts(spark, [("1", 2025, "202501", "000", 100.0)]), admin(spark, [])).collect()
    assert [(r.entries, float(r.value), r.unit) for r in got] == [(2, 100.0, "B")]
    same_file = daily_value(base.withColumn("line_no", F.lit(5).cast("bigint")), amounts(spark, [("1", 2025, "202501", "000", 100.0)]), admin(spark, [])).collect()
    assert [(r.entries, float(r.value), r.unit) for r in same_file] == [(2, 100.0, "B")]


def test_parts_add_up(spark):
    weeks = records(spark, [("0001", f"{w:02d}2025", "1110100", "AB"[w % 2]) for w in range(2, 30)])
    got = daily_value(weeks, amounts(spark, [("1", 2025, "202501", "000", 1000.01)]), admin(spark, [])).agg(F.sum("value")).first()[0]
    assert float(round(got, 8)) == 1000.01


def test_value_over_time_without_days(spark):
    """Years and periods from weekly rows are those of the daily values, to the last place."""
    import datetime
    import random
    from collections import defaultdict
    from decimal import Decimal

    rng = random.Random(3)
    rows = [(f"{k:04d}", f"{rng.choice([1, 2, 26, 51, 52]):02d}{rng.choice([2023, 2024, 2025])}", "".join(rng.choice("01") for _ in range(7)), rng.choice("AB")) for k in range(60) for _ in range(3)]
    valo = amounts(spark, [(str(k), 2024, "202401", "000", 100.0 / (k % 7 + 1)) for k in range(60)] + [(str(k), 2025, "202501", "000", 7.77) for k in range(0, 60, 4)])
    weekly = weekly_value(records(spark, rows), valo, admin(spark, [(str(k), "2024-02-29") for k in range(60)]))
    days = [(r.day, r.unit, r.value) for r in days_of(weekly).collect()]
    years = defaultdict(Decimal)
    for day, unit, value in days:
        years[(day.year, unit)] += value
    assert {(r.annee, r.unit): r.montant_br_pt for r in val.value_per_year(weekly, ["unit"]).collect()} == years and len({y for y, _ in years}) > 2
    asked = [(2023, "2022-01-01", "2023-12-31"), (2024, "2023-12-27", "2024-01-03"), (2025, "2024-06-01", "2024-06-10"), (2026, "2025-01-01", "2030-01-01"), (2027, "2031-01-01", "2032-01-01"), (2028, "2010-01-01", "2040-01-01")]
    periods = spark.createDataFrame([(F1, y, datetime.date.fromisoformat(a), datetime.date.fromisoformat(b)) for y, a, b in asked], "finess_epmsi string, iso_year int, start date, end date")
    want = {}
    for y, a, b in asked:
        inside = [v for day, _, v in days if a <= str(day) <= b]
        if inside:
            want[y] = sum(inside)
    assert {r.iso_year: r.montant_br_pt for r in val.value_in_period(weekly, periods).collect()} == want and 2025 not in want and 2028 in want
    plan = val.value_per_year(weekly)._jdf.queryExecution().optimizedPlan().toString() + val.value_in_period(weekly, periods)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(days" not in plan
