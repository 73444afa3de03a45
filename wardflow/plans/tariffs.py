"""Tariff validity: the grid line valid on a date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tariff_on_date(rows: DataFrame, grid: DataFrame, keys: list[str], day: str, picked: list[str]) -> DataFrame:
    """Add the tariff valid on each row's date, NULL when there is none.

    ``grid`` has the keys, date_debut, date_fin (NULL: still valid) and the picked columns. The
    versions of a key are few and do not overlap; they are packed into one array per key, so the
    join is a plain equi-join and a row meets its key once.
    """
    version = F.struct("date_debut", "date_fin", *picked)
    versions = grid.groupBy(*keys).agg(F.array_sort(F.collect_list(version)).alias("_versions"))
    valid = F.filter("_versions", lambda v: (v["date_debut"] <= F.col(day)) & (v["date_fin"].isNull() | (v["date_fin"] >= F.col(day))))
    joined = rows.join(versions, keys, "left").withColumn("_v", F.try_element_at(valid, F.lit(-1)))
    return joined.select(*rows.columns, *[F.col(f"_v.{c}").alias(c) for c in picked])
