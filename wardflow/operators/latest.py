"""Latest-version operators: last wins by key, cap of identical rows, latest value per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: list[str], order: list[str], null_key_id: list[str] | None = None) -> DataFrame:
    """Last row of each key by ``order``; a key with a NULL part never replaces another row.

    Rows with an incomplete key are told apart by ``null_key_id`` (default: the order columns), so
    a reload of the same file does not multiply them. ``row_number() = 1`` lets Spark keep one row
    per key and task before the shuffle, so a hot key does not travel.
    """
    incomplete = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    apart = [F.when(incomplete, F.col(c)) for c in (null_key_id or order)]
    latest = Window.partitionBy(*key, *apart).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn")


def cap_identical(rows: DataFrame, seq: str, cap: int = 2) -> DataFrame:
    """At most ``cap`` rows that agree on every column but ``seq`` (NULLs agree), lowest ``seq`` first."""
    same = [c for c in rows.columns if c != seq]
    nth = Window.partitionBy(*same).orderBy(seq)
    return rows.withColumn("_rn", F.row_number().over(nth)).where(F.col("_rn") <= cap).drop("_rn")


def latest_by(rows: DataFrame, keys: list[str], order: list[str], **values: Column) -> DataFrame:
    """Value of the last row per key by ``order``, one aggregate with map-side combine."""
    at = F.struct(*[F.col(c) for c in order])
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    return rows.groupBy(*keys).agg(F.max_by(packed, at).alias("_v")).select(*keys, "_v.*")


def copy_over_group(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Last known ``value`` of the group on all its rows.

    Aggregate and join back instead of a window, so that a hot group is never one task's sort.
    """
    known = rows.where(F.col(value).isNotNull())
    last = latest_by(known, keys, order, **{name: F.col(value)})
    return rows.join(last, keys, "left")
