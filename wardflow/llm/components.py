"""Connected components of an edge table by minimum labels and pointer jumping.

Every round is one small aggregate and one join, written to the shared folder; a node with very many edges is reduced
before it is shuffled and its join may be split, so no task needs a component whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm.common import written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable over the undirected edges (a, b), for every node that has an edge.

    Alternates two steps on edges kept as (a > b): every node's neighbours link to its smallest neighbour, first the
    larger neighbours, then the smaller ones, until the edges are stars.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = written(oriented(edges), "links")
    shape = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
        large = both.where("b > a").join(lowest, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(oriented(large), "links")
        lowest = now.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = now.join(lowest, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("n").alias("a"), F.col("m").alias("b")))
        now = written(oriented(small), "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.countDistinct("a")).first()
        if not seen[0] or shape == seen and seen[0] == seen[2]:
            break
        shape = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
