"""Columns that are evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is evaluated once per row, however many filters and columns read it.

    Spark copies an expression into every filter that it moves below it; it moves none below a generator.
    """
    kept = [F.col(c) for c in rows.columns if c != name]
    held = rows.select(*kept, value.alias("_held"))
    return held.select(*kept, F.inline(F.array(F.struct(F.col("_held").alias(name)))))
