"""Order-dependent report operators: trend, moving average, shares, merged headers, top-n folding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.session import run_folder

TREND_CAP = 100.0  # fixed value: change shown when something appears from or falls from zero
OTHERS = "Autres"


def join_groups(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL is a group like any other; ``df`` keeps its key columns."""
    if not keys:
        return df.crossJoin(F.broadcast(other))  # other is one row
    named = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(named, on, how).drop(*[f"_k_{k}" for k in keys])


def numbered(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """All rows with their place (from 1) in the order of ``by``, without bringing them to one task.

    The rows are range-partitioned, sorted and written once; the rows of earlier partitions (one count each) are added
    to the place in the partition.
    """
    spark = df.sparkSession
    path = run_folder(spark, "numbered")
    df.orderBy(*by).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    before, shifts = 0, []
    for part, n in sorted(map(tuple, rows.groupBy("_part").count().collect())):
        shifts.append((part, before))
        before += n
    parts = spark.createDataFrame(shifts, "_part bigint, _shift bigint")
    return rows.join(F.broadcast(parts), "_part").withColumn(name, (F.col("_place") + F.col("_shift") + 1).cast("int")).drop("_id", "_part", "_place", "_shift")


def trend(df: DataFrame, prefix: list[str], along: str, value: str, is_percent: bool = False, name: str = "trend") -> DataFrame:
    """Change against the previous key of the same prefix.

    Relative percent, points for percentages, +-100 from zero, NULL from zero to zero.
    """
    order = Window.partitionBy(*prefix).orderBy(along)
    current, previous = F.col(value).cast("double"), F.lag(value).over(order).cast("double")
    if is_percent:
        change = current - previous
    else:
        from_zero = F.when(current > 0, F.lit(TREND_CAP)).when(current < 0, F.lit(-TREND_CAP))
        change = F.when(previous == 0, from_zero).otherwise((current - previous) / F.abs(previous) * 100)
    return df.withColumn(name, change)


def moving_average(df: DataFrame, series: list[str], along: str, value: str, points: int, name: str = "moving_average") -> DataFrame:
    """Trailing mean of the last ``points`` positions of each series, gaps skipped."""
    if points < 2:
        return df.withColumn(name, F.lit(None).cast("double"))
    frame = Window.partitionBy(*series).orderBy(along).rowsBetween(-(points - 1), 0)
    return df.withColumn(name, F.avg(value).over(frame))


def share_of(df: DataFrame, within: list[str], value: str, name: str) -> DataFrame:
    """Percent of a value in its group's sum; 0 in an empty group.

    Group sums are aggregated and joined back, so one big group is not one task.
    """
    sums = df.groupBy(*within).agg(F.sum(value).alias("_sum"))
    return join_groups(df, sums, within).withColumn(
        name, F.when(F.col("_sum") != 0, 100.0 * F.col(value) / F.col("_sum")).otherwise(F.lit(0.0))
    ).drop("_sum")


def merged_headers(df: DataFrame, dims: list[str]) -> DataFrame:
    """For report rows sorted by ``dims``: show each value on its group's first row, with its span.

    A group at level k is a distinct prefix of k values, so the first row is the smallest of the
    prefix and the span is the prefix's row count. Adds ``show_<dim>`` and ``span_<dim>``.
    """
    out = df
    for k, dim in enumerate(dims, start=1):
        prefix = Window.partitionBy(*dims[:k])
        first = F.row_number().over(prefix.orderBy(*dims)) == 1
        out = out.withColumns({
            f"show_{dim}": first,
            f"span_{dim}": F.when(first, F.count(F.lit(1)).over(prefix)).otherwise(F.lit(1)),
        })
    return out


def top_n(df: DataFrame, by: list[Column], n: int) -> DataFrame:
    """Ordered head of a report; each task keeps n rows, nothing is fully sorted."""
    return df.orderBy(*by).limit(n)


def ranked_head(df: DataFrame, by: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """``top_n`` with its rank; only the n rows kept are numbered."""
    return df.orderBy(*by).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*by)))


def top_per_group(df: DataFrame, group: list[str], by: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group; tasks drop the rest before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*by)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def fold_smallest(df: DataFrame, label: str, value: str, n: int, within: list[str] | None = None) -> DataFrame:
    """Keep the ``n - 1`` largest labels per group and sum the rest as "Autres (k)".

    Groups of at most ``n`` labels stay as they are. ``df`` has one row per group and label;
    result: (group, label, value, folded).
    """
    within = within or []
    amount = F.coalesce(F.col(value), F.lit(0))
    by = [amount.desc(), F.col(label)]
    head = top_per_group(df, within, by, n, "_rn") if within else ranked_head(df, by, n, "_rn")
    kept = head.select(*within, label, "_rn")
    sizes = df.groupBy(*within).agg(F.count(F.lit(1)).alias("_n"))
    ranked = join_groups(df, kept, [*within, label], "left")
    if within:
        ranked = join_groups(ranked, sizes, within)
    else:
        ranked = ranked.withColumn("_n", sizes.scalar())
    keep = (F.col("_n") <= n) | (F.coalesce(F.col("_rn"), F.lit(n)) < n)
    others = F.concat(F.lit(f"{OTHERS} ("), (F.col("_n") - (n - 1)).cast("string"), F.lit(")"))
    return (
        ranked.select(*within, F.when(keep, F.col(label)).otherwise(others).alias(label), amount.alias(value), (~keep).alias("folded"))
        .groupBy(*within, label, "folded").agg(F.sum(value).alias(value))
    )


def fold_series(df: DataFrame, series: str, keys: list[str], value: str, n: int) -> DataFrame:
    """Keep the ``n - 1`` largest series by their sum and add the rest up per key as "Autres (k)"."""
    totals = df.groupBy(series).agg(F.sum(value).alias("_total"))
    size = totals.agg(F.count(F.lit(1)).alias("k")).scalar()
    head = ranked_head(totals, [F.col("_total").desc(), F.col(series)], n, "_rn")
    kept = head.where((size <= n) | (F.col("_rn") < n)).select(series, F.lit(True).alias("_kept"))
    others = F.concat(F.lit(f"{OTHERS} ("), (size - (n - 1)).cast("string"), F.lit(")"))
    label = F.when(F.col("_kept"), F.col(series)).otherwise(others)
    return join_groups(df, kept, [series], "left").groupBy(label.alias(series), *keys).agg(F.sum(value).alias(value))


def first_groups(df: DataFrame, facet: str, limit: int) -> DataFrame:
    """Rows of the first ``limit`` facet values in sort order."""
    shown = df.select(facet).distinct().orderBy(facet).limit(limit)
    return df.join(shown.withColumnRenamed(facet, "_shown"), F.col(facet).eqNullSafe(F.col("_shown")), "left_semi")
