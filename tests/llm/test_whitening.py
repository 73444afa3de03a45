"""Whitening by shifted CholeskyQR against numpy's own eigenvectors."""

import numpy as np
import pytest

from wardflow.llm import whitening

KIND = "vec_id long, embedding array<float>, component string"


def plain(rows, count=4):
    """From the definition: {(row number, component): values} over the rows that remain."""
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = np.array([[int(np.floor(256 * c)) for c in v] + [0] * (width - len(v)) for _, v in kept], dtype=np.int64).reshape(len(kept), width)
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return [i for i, _ in kept], n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ v / np.sqrt(np.maximum(e, 1e-300)), e


def some_rows(n=400, width=9, seed=1, spread=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) * (np.ones(width) if spread is None else spread) + rng.normal(size=width) * 3
    rows = [(k, [float(c) for c in v], "x") for k, v in enumerate(x)]
    return rows + [(None, rows[0][1], "x"), (7, rows[1][1], "x"), (8, rows[1][1], None), (900, None, "x"), (901, [None] + rows[0][1][1:], "x"),
                   (902, [float("nan")] + rows[0][1][1:], "x"), (903, [float("inf")] + rows[0][1][1:], "x"), (904, rows[2][1][:-2], "x")]


@pytest.mark.parametrize("spread", [None, np.array([1e3, 1e3, 300, 40, 1, 0.1, 0.01, 0.004, 0.004])])
def test_against_eigenvectors(spark, spread):
    rows = some_rows(spread=spread)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    ids, n, deviation, whitened, e = plain(rows)
    got = whitening.whitened_rows(df).collect()
    assert len(got) == 4 * len(ids) and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2, 3, 4}
    assert all(r.identity_error < 1e-9 and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9 * r.explained for r in got)
    for c in range(4):
        own = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened) for r in got if r.component == c + 1)
        for sign in (1, -1):
            want = sorted((i is None, i or 0, int(d), sign * w) for i, d, w in zip(ids, deviation, whitened[:, c], strict=True))
            if all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 for a, b in zip(own, want, strict=True)):
                break
        else:
            raise AssertionError(c)


def test_low_rank_and_nothing(spark):
    line = spark.createDataFrame([(k, [k / 7, 2 * k / 7, 5.0], "x") for k in range(50)] * 2, KIND)
    assert {(r.component, r.n) for r in whitening.whitened_rows(line).where("component = 1").collect()} == {(1, 50)}
    flat = spark.createDataFrame([(k, [float(k // 10), 3.0], "x") for k in range(50)], KIND)
    got = whitening.whitened_rows(flat).collect()
    assert len(got) == 50 and {r.component for r in got} == {1} and {r.n for r in got} == {5} and all(abs(r.explained - 1) < 1e-9 for r in got)
    for rows in ([(1, [2.0, 3.0], "x")] * 3, [(1, None, "x")], [(1, [], "x")]):
        assert whitening.whitened_rows(spark.createDataFrame(rows, KIND)).count() == 0
    assert whitening.whitened_rows(line.limit(0)).count() == 0


def test_factors_of_an_ill_conditioned_matrix(spark):
    """A condition number whose square is beyond double precision."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    x = np.rint((rng.normal(size=(3000, 6)) * np.array([1e13, 1e10, 1e7, 1e5, 1e4, 1e3])) @ q.T).astype(np.int64)
    model = whitening.fit(spark.createDataFrame([(v.tolist(),) for v in x], "x array<bigint>").repartition(4))
    exact = x.astype(object) * len(x) - x.astype(object).sum(axis=0)
    values = np.linalg.svd(exact.astype(float) / len(x), compute_uv=False)
    assert len(model.variance) == 6 and np.allclose(np.sqrt(model.variance * len(x)), values, rtol=1e-6)


def test_large_deviations():
    model = whitening.Whitening(10, np.array([5, 5], dtype=np.int64), np.eye(2), np.ones(2), 2.0)
    x = np.array([[1, 2], [2**40, 3], [2**61, 3]], dtype=np.int64)
    exact = [sum((10 * int(c) - 5) ** 2 for c in v) for v in x]
    assert model.deviations(x[:1]) == exact[:1] and model.deviations(x) == [e if e < 2**63 else None for e in exact]
