"""Pivot in long form: cells, totals and subtotals merged from the cells' states, and percentages.

Dimensions are display values (never NULL), so a NULL dimension marks a total. ``row_level`` and
``col_level`` say how much of each side is kept: ``full``, ``first`` (subtotal on the first
dimension) or ``none``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions import mergeable as mg
from wardflow.functions.derive import EMPTY
from wardflow.functions.mergeable import Calculated, Part
from wardflow.operators.ordered import join_groups
from wardflow.operators.quantiles import quantiles_of_counts, value_counts
from wardflow.session import run_folder


@dataclass(frozen=True)
class PivotMeasure:
    """``how`` is count, sum, avg, min, max, median, distinct or calc.

    ``value`` is the row expression, or the ``Calculated`` measure itself for ``calc``.
    """

    name: str
    how: str
    value: Column | Calculated

    def calculated(self) -> Calculated:
        simple = {
            "count": mg.count_known, "sum": mg.total_known, "avg": mg.mean, "min": mg.least, "max": mg.greatest, "median": mg.median, "distinct": mg.distinct,
        }
        return self.value if self.how == "calc" else simple[self.how](self.value)


def grouping_levels(rows: list[str], cols: list[str], row_subtotals: bool, col_subtotals: bool) -> list[list[str]]:
    """Grouping sets of the requested cells, totals, subtotals and crossed subtotals."""
    row_sides = [rows] + ([rows[:1]] if row_subtotals and len(rows) > 1 else []) + ([[]] if rows else [])
    col_sides = [cols] + ([cols[:1]] if col_subtotals and len(cols) > 1 else []) + ([[]] if cols else [])
    return [r + c for r in row_sides for c in col_sides]


def _level(dims: list[str]) -> Column:
    """How much of one side a grouping-set row keeps."""
    if not dims:
        return F.lit("none")
    kept = [F.grouping(d) == 0 for d in dims]
    return F.when(kept[-1], F.lit("full")).when(kept[0], F.lit("first")).otherwise(F.lit("none"))


def _group(df: DataFrame, sets: list[list[str]], rows: list[str], cols: list[str], aggs: list[Column], also: list[str] | None = None) -> DataFrame:
    """Aggregates of every grouping set, by the columns ``also`` too, with the levels of both sides."""
    dims, also = rows + cols, also or []
    if not dims:
        out = df.groupBy(*also).agg(*aggs) if also else df.agg(*aggs)
        return out.select(F.lit("none").alias("row_level"), F.lit("none").alias("col_level"), "*")
    return df.groupingSets([s + also for s in sets], *dims, *also).agg(*aggs, _level(rows).alias("row_level"), _level(cols).alias("col_level"))


def _kept(dims: list[str], own: list[str]) -> Column:
    """``_level`` of one side in a given grouping set."""
    return F.lit("none" if not dims or dims[0] not in own else "full" if dims[-1] in own else "first")


def _per_value(df: DataFrame, sets: list[list[str]], rows: list[str], cols: list[str], inner: Column, outer: Column) -> DataFrame:
    """``outer`` of ``inner`` per value ``_v``, in every grouping set.

    The rows are dealt by value once; every set is then aggregated where the rows are, instead of shuffling a copy per set.
    """
    dealt, types = df.repartition("_v"), dict(df.dtypes)
    found = []
    for own in sets:
        per_set = dealt.groupBy(*own, "_v").agg(inner)
        shown = [F.col(d) if d in own else F.lit(None).cast(types[d]).alias(d) for d in rows + cols]
        levels = [_kept(rows, own).alias("row_level"), _kept(cols, own).alias("col_level")]
        found.append(per_set.select(*shown, *levels, per_set.columns[-1]).groupBy(*rows, *cols, "row_level", "col_level").agg(outer))
    return reduce(DataFrame.unionByName, found)


def _read_once(df: DataFrame, dims: list[str], parts: list[Part]) -> tuple[DataFrame, list[Part]]:
    """The dimensions and the parts' values as stored rows, and the parts over them: what makes the rows (joins with other
    sources, say) runs once, not once per part."""
    columns, over = [], []
    for i, p in enumerate(parts):
        columns += [p.value.alias(f"_x{i}"), *([p.owner.alias(f"_o{i}")] if p.owner is not None else [])]
        over.append(Part(p.kind, F.col(f"_x{i}"), None if p.owner is None else F.col(f"_o{i}")))
    narrow = df.select(*dims, *columns)
    if any(["void" in kind for _, kind in narrow.dtypes]):  # no file holds such a column
        return df, parts
    path = run_folder(df.sparkSession, "pivot")
    narrow.write.parquet(path)
    return df.sparkSession.read.schema(narrow.schema).parquet(path), over


def merged_states(df: DataFrame, rows: list[str], cols: list[str], sets: list[list[str]], parts: list[Part]) -> DataFrame:
    """(dims, levels, p0, p1, …): the state of every part in every cell and total.

    Source rows are read into cells (additive parts) and into counts of values per cell (the others), both with map-side
    combine; only cells and counts meet the grouping sets. Medians come from the counts by range, so no group is in one
    task. The results share their keys and are put together by one aggregate. Rows that several parts read are stored first.
    """
    dims = rows + cols
    keys = dims + ["row_level", "col_level"]
    found: list[DataFrame] = []
    if any([p.kind not in mg.ADDITIVE for p in parts]):
        df, parts = _read_once(df, dims, parts)
    additive = [(f"p{i}", p) for i, p in enumerate(parts) if p.kind in mg.ADDITIVE]
    cells = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("_rows"), *[getattr(F, p.kind)(p.value).alias(name) for name, p in additive])
    merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    found.append(_group(cells, sets, rows, cols, [F.sum("_rows").alias("_rows"), *[merge[p.kind](name).alias(name) for name, p in additive]]).drop("_rows"))
    for i, p in enumerate(parts):
        if p.kind in mg.OF_OWNERS:
            owned = df.select(*dims, p.owner.alias("_v"), p.value.alias("_x")).where("_v is not null").groupBy(*dims, "_v").agg(F.max("_x").alias("_x"))
            found.append(_per_value(owned, sets, rows, cols, F.max("_x").alias("_x"), F.sum("_x").alias(f"p{i}")))
        if p.kind not in mg.OF_VALUES:
            continue
        counts = _group(value_counts(df, dims, p.value), sets, rows, cols, [F.sum("_c").alias("_c")], ["_v"])
        if p.kind == "median":
            found.append(quantiles_of_counts(counts, keys, {f"p{i}": 0.5}).select(*keys, f"p{i}"))
        elif p.kind == "mode":
            found.append(counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_c")).alias("less"), "_v"))["_v"].alias(f"p{i}")))
        else:
            found.append(counts.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"p{i}")))
    if len(found) == 1:
        return found[0]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    return stacked.groupBy(*keys).agg(*[F.max(f"p{i}").alias(f"p{i}") for i in range(len(parts))])


def pivot(
    df: DataFrame, rows: list[str], cols: list[str], measures: list[PivotMeasure],
    row_subtotals: bool = False, col_subtotals: bool = False, totals: bool = True,
) -> DataFrame:
    """Long-form pivot: (row dims, column dims, row_level, col_level, one column per measure).

    The parts of all measures are computed together, one that several measures share only once.
    """
    sets = grouping_levels(rows, cols, row_subtotals, col_subtotals) if totals else [rows + cols]
    parts: list[Part] = []
    built: list[Column] = []
    for m in measures:
        measure, places = m.calculated(), []
        for part in measure.parts:
            known = next((i for i, p in enumerate(parts) if p.kind == part.kind and p.value is part.value and p.owner is part.owner), len(parts))
            parts += [part] if known == len(parts) else []
            places.append(known)
        built.append(measure.build([F.col(f"p{i}") for i in places]).alias(m.name))
    return merged_states(df, rows, cols, sets, parts).select(*rows, *cols, "row_level", "col_level", *built)


def calculate(df: DataFrame, keys: list[str], measures: dict[str, Calculated]) -> DataFrame:
    """Calculated measures per group, without totals."""
    return pivot(df, keys, [], [PivotMeasure(n, "calc", m) for n, m in measures.items()], totals=False).drop("row_level", "col_level")


def percentages(pivoted: DataFrame, rows: list[str], cols: list[str], base: str, of: str, name: str) -> DataFrame:
    """Add 100 * base / (grand, row or column total); ``of`` is total, row or col.

    ``base`` is an additive or distinct measure of ``pivot``. A cell of a zero total is 0 when it
    is 0 itself, else NULL; a total of a zero total is NULL; the grand total is always 100. The
    denominators are the totals of the pivot's own result, joined back on their keys.
    """
    value = F.col(base)
    if of == "total":
        grand = pivoted.where("row_level = 'none' and col_level = 'none'").select(base).scalar()
        pivoted = pivoted.withColumn("_total", grand)
    else:
        keys = ["row_level", *rows] if of == "row" else ["col_level", *cols]
        other = "col_level" if of == "row" else "row_level"
        totals = pivoted.where(F.col(other) == "none").select(*keys, value.alias("_total"))
        pivoted = join_groups(pivoted, totals, keys, "left")
    total = F.col("_total")
    inner = (F.col("row_level") != "none") & (F.col("col_level") != "none")
    share = F.when(total != 0, F.lit(100.0) * value / total).when(inner & (F.coalesce(value, F.lit(0)) == 0), F.lit(0.0))
    is_grand = (F.col("row_level") == "none") & (F.col("col_level") == "none")
    return pivoted.withColumn(name, F.when(is_grand, F.lit(100.0)).otherwise(share)).drop("_total")


def hide_empty(df: DataFrame, dims: list[str]) -> DataFrame:
    """Drop rows with an empty group dimension before anything is totalled."""
    return df.where(reduce(lambda a, b: a & b, [F.col(d) != EMPTY for d in dims], F.lit(True)))


def grid_size(df: DataFrame, rows: list[str], cols: list[str]) -> int:
    """Estimated number of grid cells of a wide table."""
    def keys(dims: list[str]) -> Column:
        return F.approx_count_distinct(F.struct(*dims)) if dims else F.lit(1)
    n_rows, n_cols = df.agg(keys(rows), keys(cols)).first()
    return int(n_rows) * int(n_cols)


def pivot_wide(pivoted: DataFrame, rows: list[str], col: str, value: str, limit: int | None = None) -> DataFrame:
    """Wide presentation of a long pivot's cells; with ``limit``, refuses a grid of more cells."""
    cells = pivoted.where("row_level = 'full' and col_level = 'full'")
    if limit is not None and (size := grid_size(cells, rows, [col])) > limit:
        raise ValueError(f"grid of about {size} cells exceeds {limit}: use fewer or coarser dimensions")
    return cells.groupBy(*rows).pivot(col).agg(F.first(value))
