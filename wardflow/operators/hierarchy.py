"""Code hierarchies: ancestor closure and lookups by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.session import run_folder


def closure(nodes: DataFrame) -> DataFrame:
    """All (code, ancestor_code, ancestor_kind, hops) pairs, each node being its own ancestor at 0.

    ``nodes`` has code, kind and parent_code. The chains double in length every round, so a tree of
    any depth takes as many rounds as the depth has binary digits; each round is one join, written
    to the shared folder. A cycle of parents is an error.
    """
    spark = nodes.sparkSession
    folder = run_folder(spark, "closure")
    columns = ["code", "ancestor_code", "ancestor_kind", "hops"]
    zero, one = F.lit(0).alias("hops"), F.lit(1).alias("hops")
    own = nodes.select("code", F.col("code").alias("ancestor_code"), F.col("kind").alias("ancestor_kind"), zero)
    parents = nodes.select(F.col("code").alias("ancestor_code"), F.col("kind").alias("ancestor_kind"))
    links = nodes.select("code", F.col("parent_code").alias("_up")).join(parents, F.col("_up") == F.col("ancestor_code"))
    links.select("code", "ancestor_code", "ancestor_kind", one).write.parquet(f"{folder}/1")
    pairs, reach, n = spark.read.parquet(f"{folder}/1"), 1, nodes.count()
    while not (longest := pairs.where(F.col("hops") == reach)).isEmpty():
        if reach > n:
            raise ValueError("the hierarchy has a cycle of parents")
        further = pairs.withColumnsRenamed({"code": "_c", "ancestor_code": "_a", "ancestor_kind": "_k", "hops": "_h"})
        new = longest.join(further, F.col("ancestor_code") == F.col("_c")).select(
            "code", F.col("_a").alias("ancestor_code"), F.col("_k").alias("ancestor_kind"), (F.col("hops") + F.col("_h")).alias("hops")
        )
        reach *= 2
        pairs.unionByName(new).write.parquet(f"{folder}/{reach}")
        pairs = spark.read.parquet(f"{folder}/{reach}")
    return own.select(*columns).unionByName(pairs.select(*columns))


def ancestor_of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    """Nearest ancestor of one kind per code: (code, ancestor_code, ancestor_label)."""
    pairs = closure(nodes).where(F.col("ancestor_kind") == kind)
    nearest = pairs.groupBy("code").agg(F.min_by("ancestor_code", "hops").alias("ancestor_code"))
    labels = nodes.select(F.col("code").alias("ancestor_code"), F.col("libelle").alias("ancestor_label"))
    return nearest.join(labels, "ancestor_code", "left").select("code", "ancestor_code", "ancestor_label")


def with_ancestor(rows: DataFrame, nodes: DataFrame, code: str, kind: str, prefix: int = 3) -> DataFrame:
    """Add the code's ancestor of a kind; an unknown code is looked up by its first characters.

    The fallback applies to codes that are not in the hierarchy at all.
    """
    known = nodes.select(F.col("code").alias("_node"))
    ancestors = ancestor_of_kind(nodes, kind)
    table = known.join(ancestors, F.col("_node") == F.col("code"), "left").drop("code")
    start = F.substring(F.col(code), 1, prefix)
    exact = rows.join(table, F.col(code) == F.col("_node"), "left")
    short = table.withColumnsRenamed({"_node": "_p", "ancestor_code": "_pc", "ancestor_label": "_pl"})
    both = exact.join(short, start == F.col("_p"), "left")
    found = F.col("_node").isNotNull()
    return both.select(
        *rows.columns,
        F.when(found, F.col("ancestor_code")).otherwise(F.col("_pc")).alias(f"{code}_{kind}"),
        F.when(found, F.col("ancestor_label")).otherwise(F.col("_pl")).alias(f"{code}_{kind}_label"),
    )


def with_prefix_label(rows: DataFrame, table: DataFrame, code: str, length: int, kind: str, name: str) -> DataFrame:
    """Add code and label of a heading found by cutting a hierarchical code."""
    heading = table.where(F.col("kind") == kind).select(F.col("code").alias(name), F.col("libelle").alias(f"{name}_label"))
    return rows.join(heading, F.substring(F.col(code), 1, length) == F.col(name), "left")
