"""Exact quantiles of many groups at once, whatever the size of a group.

Equal values are counted first. The counts are range-partitioned by group and value over all groups together, so a large
group lies in many partitions and a partition holds many small groups. The sums of the partitions tell which partition
holds each wanted rank. Only those slices are kept; while one has more than ``FIT`` rows it is range-partitioned again,
so the bracket around a rank narrows by the number of partitions each time. The slices that fit are numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.operators.ordered import join_groups
from wardflow.session import run_folder

FIT = 2_000_000  # rows of one slice that one task orders


def value_counts(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys…, _v, _c): how often each known value occurs in each group."""
    return df.select(*keys, value.alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = run_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def select_ranks(counts: DataFrame, keys: list[str], ranks: DataFrame, rows: int, fit: int = FIT) -> DataFrame:
    """(keys…, _q, _v): for every row (keys…, _q, _rank) of ``ranks`` the value of that rank, from 0, in its group.

    ``counts`` is (keys…, _v, _c), ``rows`` of them; NULL is a key like any other.
    """
    slice_keys = list(keys)
    parts = max(1, -(-2 * rows // fit))
    while True:
        # written, since the partition of a row must be the same in every later use
        ranged = _stored(counts.repartitionByRange(parts, *slice_keys, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
        sums = ranged.groupBy(*slice_keys, "_part").agg(F.sum("_c").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
        earlier = Window.partitionBy(*slice_keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
        places = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        part = f"_part{len(slice_keys)}"
        hit = join_groups(ranks, places, slice_keys).where("_rank >= _before and _rank < _before + _sum")
        hit = _stored(hit.withColumn("_rank", F.col("_rank") - F.col("_before")).drop("_before", "_sum").withColumnRenamed("_part", part), "ranks")
        counts = ranged.withColumnRenamed("_part", part)
        slice_keys.append(part)
        counts = join_groups(counts, hit.select(*slice_keys).distinct(), slice_keys, "left_semi")
        ranks = hit.drop("_rows")
        if (hit.agg(F.max("_rows")).first()[0] or 0) <= fit:
            break
        parts *= 2
    up_to = Window.partitionBy(*slice_keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)  # at most ``fit`` rows
    numbered = counts.withColumn("_last", F.sum("_c").over(up_to))
    return join_groups(ranks, numbered, slice_keys).where("_rank < _last and _rank >= _last - _c").select(*keys, "_q", "_v")


def quantiles_of_counts(counts: DataFrame, keys: list[str], probs: dict[str, float], fit: int = FIT) -> DataFrame:
    """(keys…, _n, _lowest, _highest, one column per name of ``probs``) from (keys…, _v, _c): linear between neighbours."""
    counts = _stored(counts.withColumn("_v", F.col("_v").cast("double")), "counts")
    groups = _stored(counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lowest"), F.max("_v").alias("_highest"), F.count(F.lit(1)).alias("_rows")), "groups")
    rows = groups.agg(F.sum("_rows")).first()[0] or 0
    at = {name: F.lit(p) * (F.col("_n") - 1) for name, p in probs.items()}
    sides = {(name, side): round_to(x).cast("long") for name, x in at.items() for side, round_to in (("low", F.floor), ("high", F.ceil))}
    asked = F.explode(F.array(*[F.struct(F.lit(f"{name} {side}").alias("_q"), rank.alias("_rank")) for (name, side), rank in sides.items()]))
    found = select_ranks(counts, keys, groups.select(*keys, asked.alias("_a")).select(*keys, "_a.*"), rows, fit)
    ends = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_q", "_v"))).alias("_ends"))  # two entries per name
    both = join_groups(groups, ends, keys, "left")
    low, high = (lambda name: F.col("_ends")[f"{name} low"]), (lambda name: F.col("_ends")[f"{name} high"])
    values = [(low(name) + (high(name) - low(name)) * (x - F.floor(x))).alias(name) for name, x in at.items()]
    return both.select(*keys, "_n", "_lowest", "_highest", *values)
