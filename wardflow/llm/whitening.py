"""Embedding whitening by shifted CholeskyQR.

The rows, centred, are a tall matrix A. One pass sums A'A over all tasks; the Cholesky factor R of that small matrix (the
first one shifted, so that it exists whatever the conditioning) turns every row a into a R^-1 by a triangular solve
inside the tasks, and the next pass sums the products of those rows. When they are orthonormal, A = Q R with R the
product of all factors, and R has A's singular values and right singular vectors: the components and their variances to
double precision, without ever squaring A's condition number.

Entries become whole numbers floor(SCALE * c), so sums and deviations are exact. Statistics are over the distinct
vectors; the passes read them from a written table, and only matrices of dimension x dimension reach the driver.

Defined results: a row whose vector is null or holds a null or non-finite entry is left out; a shorter vector counts
as zero in the missing dimensions; repeated rows count once in the statistics and each get their result, as do rows with
a null id; a component without variance (numerical rank) is left out, so constant vectors and an empty table give no
rows; entries beyond a long's range end at it, a deviation beyond it is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import table, written
from wardflow.llm.registry import query

SCALE = 256
PASSES, ORTHONORMAL = 8, 1e-12  # at most so many Gram passes; done when no entry is further from the identity
_LARGEST = np.iinfo(np.int64).max


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x): the remaining rows with their entries as whole numbers."""
    finite = f"forall(`{vector_col}`, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"
    kept = rows.where(F.col(vector_col).isNotNull() & F.expr(finite))
    return kept.select(F.col(id_col).alias("id"), F.expr(f"transform(`{vector_col}`, c -> cast(floor({scale}D * cast(c as double)) as bigint))").alias("x"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """List rows as a matrix of longs; shorter rows end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    inside = np.arange(width) < lengths[:, None]
    out[inside] = values
    return out


def summed(rows: DataFrame, width: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of a matrix (of ``width`` columns) that ``make`` gives for a block of rows.

    Every task adds up its blocks; the tasks' matrices are summed row by row in a second stage, so only one matrix
    reaches the driver.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = make(matrix(batch.slice(at, 8192).column(0), width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "part"])

    def add(block: pa.Table) -> pa.Table:
        parts = block.column(1).combine_chunks()
        return pa.table({"i": block.column(0)[:1], "part": pa.array([parts.flatten().to_numpy().reshape(len(parts), -1).sum(axis=0)], pa.list_(pa.float64()))})

    found = rows.select("x").mapInArrow(partial, "i int, part array<double>").groupBy("i").applyInArrow(add, "i int, part array<double>").collect()  # one row per dimension
    return np.array([r.part for r in sorted(found, key=lambda r: r.i)])


@dataclass(frozen=True)
class Whitening:
    """``components`` are columns; ``variance`` falls; ``total`` is the trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: whole numbers first, one division."""
        whole, rest = self.sums // self.n, self.sums % self.n
        return (x - whole) - rest / self.n

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        return self.centred(x) @ self.components[:, :k] / np.sqrt(self.variance[:k])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sums)^2, exact."""
        reach = self.n * (int(np.abs(x).max(initial=0)) + 1) + int(np.abs(self.sums).max(initial=0))
        if len(self.sums) * reach * reach <= _LARGEST:
            return ((self.n * x - self.sums) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - self.sums.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v <= _LARGEST else None for v in exact]


def upper_factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper R with R'R = gram + shift; the shift is raised where rounding leaves the sum indefinite."""
    unit = np.eye(len(gram))
    while True:
        try:
            return np.linalg.cholesky(gram + shift * unit).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, np.finfo(float).eps * max(float(np.trace(gram)), np.finfo(float).tiny))


def solve_right(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows R1^-1 R2^-1 ... by forward substitution, one column after the other."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(len(r)):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def fit(distinct: DataFrame) -> Whitening:
    """Whitening from the distinct vectors (x), which every pass reads again."""
    n, width = distinct.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not width:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    by_dimension = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).collect()  # one row per dimension
    sums = np.zeros(width, dtype=np.int64)
    for r in by_dimension:
        sums[r.i] = r.s
    plain = Whitening(n, sums, np.eye(width), np.ones(width), 0.0)
    factors: list[np.ndarray] = []
    total = 0.0
    for k in range(PASSES):
        def gram(x: np.ndarray, factors: list[np.ndarray] = factors[:]) -> np.ndarray:
            q = solve_right(plain.centred(x), factors)
            return q.T @ q

        g = summed(distinct, width, gram)
        if k == 0:
            total = float(np.trace(g)) / n
            if total == 0:
                break
        elif np.abs(g - np.eye(width)).max() <= ORTHONORMAL:
            break
        norm = float(np.linalg.norm(g, 2))
        factors.append(upper_factor(g, 11 * (n * width + width * (width + 1)) * np.finfo(float).eps / 2 * norm if k == 0 else 0.0))
    r = np.eye(width)
    for factor in factors:
        r = factor @ r
    _, values, right = np.linalg.svd(r)
    real = values > values[0] * max(width, np.sqrt(n)) * np.finfo(float).eps * 16 if total else np.zeros(width, dtype=bool)
    components = right[real].T
    components = components * np.where(components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, components, values[real] ** 2 / n, total)


def identity_error(distinct: DataFrame, model: Whitening, k: int) -> float:
    """Largest absolute entry of the whitened distinct vectors' covariance minus the identity."""
    width = len(model.sums)
    mean = summed(distinct, width, lambda x: model.project(x, k).sum(axis=0)[None, :])[0] / model.n

    def spread(x: np.ndarray) -> np.ndarray:
        z = model.project(x, k) - mean
        return z.T @ z

    return float(np.abs(summed(distinct, width, spread) / model.n - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(id, whitened array<double>) of every row of (id, x), all components."""
    return _per_row(vectors, model, len(model.variance)).select("id", "whitened")


def _per_row(vectors: DataFrame, model: Whitening, k: int) -> DataFrame:
    """(id, deviation, whitened) per row, the first ``k`` components."""
    width, kind = len(model.sums), vectors.schema["id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                some = batch.slice(at, 8192)
                x = matrix(some.column(1), width)
                yield pa.RecordBatch.from_arrays([
                    some.column(0), pa.array(model.deviations(x), pa.int64()), pa.array(list(model.project(x, k)), pa.list_(pa.float64())),
                ], names=["id", "deviation", "whitened"])

    return vectors.select("id", "x").mapInArrow(project, f"id {kind}, deviation long, whitened array<double>")


def whitened_rows(rows: DataFrame, count: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component up to ``count``."""
    vectors = written(whole_vectors(rows, id_col, vector_col), "whole-vectors")
    distinct = written(vectors.select("x").distinct(), "vectors")
    model = fit(distinct)
    k = min(count, len(model.variance))
    kind = vectors.schema["id"].dataType.simpleString()
    if not k:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(distinct, model, k)
    explained = F.array(*[F.lit(float(v / model.total)) for v in model.variance[:k]])
    long = _per_row(vectors, model, k).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )


@query("op12_cholesky_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whitened_rows(table(spark, folder, "embeddings"))
