"""Chart datasets: distributions, hierarchies, flows, facets, points and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.operators.ordered import OTHERS, first_groups, fold_smallest, join_groups, ranked_head, share_of
from wardflow.operators.quantiles import quantiles_of_counts, value_counts

_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def box_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Minimum, quartiles (linear between neighbours), maximum and count per group, exact for groups of any size."""
    counts = value_counts(df, keys, F.col(value).cast("double"))
    found = quantiles_of_counts(counts, keys, _QUARTILES)
    return found.withColumnsRenamed({"_lowest": "lowest", "_highest": "highest", "_n": "n"}).select(*keys, "lowest", *_QUARTILES, "highest", "n")


def histogram(df: DataFrame, value: str, series: list[str] | None = None) -> DataFrame:
    """Counts in equal bins shared by all series: (series…, bin, bin_start, n).

    The number of bins is clamp(ceil(log2(n + 1)) + 1, 5, 20); the last bin is closed.
    """
    series = series or []
    v = F.col(value).cast("double")
    known = df.where(v.isNotNull())
    stats = known.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("n")).alias("s")).scalar()
    tagged = known.select(*series, v.alias("_v"), stats.alias("_s"))
    k = F.greatest(F.lit(5), F.least(F.lit(20), F.ceil(F.log2(F.col("_s.n") + 1)) + 1))
    span = F.col("_s.hi") - F.col("_s.lo")
    width = F.when(span == 0, F.lit(1.0)).otherwise(span) / k
    place = F.greatest(F.lit(0), F.least(F.floor((F.col("_v") - F.col("_s.lo")) / width), k - 1))
    return (
        tagged.withColumn("bin", place).withColumn("bin_start", F.col("_s.lo") + F.col("bin") * width)
        .groupBy(*series, "bin", "bin_start").agg(F.count(F.lit(1)).alias("n"))
    )


def value_tree(df: DataFrame, levels: list[str], value: Column, cap: int | None = None) -> DataFrame:
    """Totals of every node of a label tree; with ``cap``, each node's children are folded beyond it.

    Result: (depth, levels…, value). A folded node is a leaf "Autres (k)" that stands for its whole
    subtree. The rollup gives all levels in one aggregate.
    """
    rolled = df.rollup(*levels).agg(value.alias("value"), F.grouping_id().alias("_g"))
    n = len(levels)
    out = rolled.where(F.col("_g") == (1 << n) - 1).select(
        F.lit(0).alias("depth"), *levels, "value"
    )
    parents: DataFrame | None = None
    for depth in range(1, n + 1):
        path, label = levels[: depth - 1], levels[depth - 1]
        nodes = rolled.where(F.col("_g") == (1 << (n - depth)) - 1).select(*levels[:depth], "value")
        if cap is None:
            missing = [F.lit(None).cast("string").alias(x) for x in levels[depth:]]
            out = out.unionByName(nodes.select(F.lit(depth).alias("depth"), *path, label, *missing, "value"))
            continue
        if parents is not None:
            nodes = join_groups(nodes, parents.select(*path), path, "left_semi") if path else nodes
        folded = fold_smallest(nodes, label, "value", cap, path)
        parents = folded.where(~F.col("folded")).select(*path, label)
        missing = [F.lit(None).cast("string").alias(x) for x in levels[depth:]]
        out = out.unionByName(folded.select(F.lit(depth).alias("depth"), *path, label, *missing, "value"))
    return out


def flows(df: DataFrame, source: str, target: str, value: Column, cap: int | None = None) -> DataFrame:
    """Source-to-target sums; with ``cap``, both sides are folded to as many nodes."""
    cells = df.groupBy(source, target).agg(value.alias("value")).where("value <> 0")
    if cap is None:
        return cells

    def kept(side: str) -> DataFrame:
        totals = cells.groupBy(side).agg(F.sum("value").alias("value"))
        size = totals.agg(F.count(F.lit(1)).alias("k")).scalar()
        return ranked_head(totals, [F.col("value").desc(), F.col(side)], cap).where(
            (size <= cap) | (F.col("rank") < cap)
        ).select(
            F.col(side), F.lit(True).alias(f"_{side}_kept")
        )

    out = cells
    for side in (source, target):
        n_side = cells.select(side).distinct().agg(F.count(F.lit(1)).alias("k")).scalar()
        others = F.concat(F.lit(f"{OTHERS} ("), (n_side - (cap - 1)).cast("string"), F.lit(")"))
        out = join_groups(out, kept(side), [side], "left").withColumn(
            f"_{side}", F.when(F.col(f"_{side}_kept").isNotNull(), F.col(side)).otherwise(others)
        )
    return out.groupBy(F.col(f"_{source}").alias(source), F.col(f"_{target}").alias(target)).agg(
        F.sum("value").alias("value")
    )


def facets(df: DataFrame, facet: str, keys: list[str], *aggregates: Column, cap: int | None = None) -> DataFrame:
    """One aggregate per facet value and key; with ``cap``, for the first facet values in sort order."""
    totals = df.groupBy(facet, *keys).agg(*aggregates)
    return totals if cap is None else first_groups(totals, facet, cap)


def points(df: DataFrame, keys: list[str], x: Column, y: Column, size: Column | None = None) -> DataFrame:
    """Scatter or bubble points: two or three measures per cell, cells without x or y dropped."""
    aggs = [x.alias("x"), y.alias("y")] + ([size.alias("size")] if size is not None else [])
    return df.groupBy(*keys).agg(*aggs).dropna(subset=["x", "y"])


def heat_grid(df: DataFrame, row: str, col: str, value: Column) -> DataFrame:
    """Grid cells with the colour scale's ends."""
    cells = df.groupBy(row, col).agg(value.alias("value"))
    ends = cells.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("e")).scalar()
    return cells.withColumn("_e", ends).select(row, col, "value", F.col("_e.lo").alias("lowest"), F.col("_e.hi").alias("highest"))


def series(df: DataFrame, category: str, serie: str, value: Column) -> DataFrame:
    """Chart series with percent labels by category, by series and of the whole."""
    cells = df.groupBy(category, serie).agg(value.alias("value"))
    out = share_of(cells, [category], "value", "pct_category")
    out = share_of(out, [serie], "value", "pct_series")
    total = cells.agg(F.sum("value").alias("t")).scalar()
    return out.withColumn("pct_total", F.when(total != 0, 100.0 * F.col("value") / total).otherwise(F.lit(0.0)))
