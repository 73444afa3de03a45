"""Ancestor closure of trees of any depth."""

import pytest

from wardflow.operators.hierarchy import ancestor_of_kind, closure

NODE = "code string, kind string, parent_code string, libelle string"


def test_long_chain(spark):
    nodes = spark.createDataFrame([(f"n{i}", "top" if i == 0 else "k", f"n{i - 1}" if i else None, f"L{i}") for i in range(40)] + [("alone", "k", "missing", "A")], NODE)
    got = {(r.code, r.ancestor_code): r.hops for r in closure(nodes).collect()}
    assert got == {(f"n{i}", f"n{j}"): i - j for i in range(40) for j in range(i + 1)} | {("alone", "alone"): 0}
    assert {r.code for r in ancestor_of_kind(nodes, "top").collect()} == {f"n{i}" for i in range(40)}


def test_no_nodes_and_cycles(spark):
    assert closure(spark.createDataFrame([], NODE)).count() == 0
    with pytest.raises(ValueError):
        closure(spark.createDataFrame([("a", "k", "b", "A"), ("b", "k", "a", "B")], NODE))
