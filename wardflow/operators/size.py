"""Broadcasting behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_BYTES = 32 * 1024 * 1024


def size_in_bytes(df: DataFrame) -> int:
    """Spark's own estimate: the size of the files for a stored table, an upper bound or a huge default otherwise."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """``df``, marked for broadcast if its known size allows it; else Spark joins it as it finds best."""
    return F.broadcast(df) if size_in_bytes(df) <= limit else df
