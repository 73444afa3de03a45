"""Registered queries against their checking SQL on the smallest data (the full run is oracle_check.py)."""

import os

import pytest

import __spark_entry__ as entry
import oracle_check
from wardflow.bindings.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "a1_scan_lines", "a4_repeated_blocks", "a14_f9_sectioned_acts", "a20_a21_upsert_table", "b1_b2_file_gate", "b11_h5_leak_check", "c4_iso_week_date", "c21_dimension_display",
    "d4_ancestor_of_kind", "d5_match_other_source", "d13_e10_staff_scores", "d16_tariff_on_date", "d17_stay_sheet", "e1_e2_stay_activity", "e3_d9_patients", "e5_indicators",
    "e15_daily_value", "e16_value_per_year_and_unit", "e21_amount_by_unit", "e23_unvalued_stays", "e26_ranking_cm", "e33_subtotals", "e34_percent_of_row", "e37_presence_weighted_amount",
    "e46_histogram", "e47_value_tree", "e48_flows", "f1_last_wins_null_keys", "h1_diagnosis_union", "j1_incremental_load",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    ok, message, _ = oracle_check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert ok, message


def test_every_query_has_checking_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
