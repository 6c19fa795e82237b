"""Whitening against a dense eigendecomposition; spectra that end early; odd tables."""

import numpy as np
import pytest

from reelscope.llm import queries, whitening

KIND = "vec_id long, embedding array<float>"


def compared(rows, found, most=32):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((x * n - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    k = min(most, int((values > 1e-9 * values[-1]).sum()))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    want = centred @ vectors / np.sqrt(values)
    assert len(found) == n * k
    got = np.zeros((n, k))
    place = {i: p for p, (i, _) in enumerate(rows)}
    for r in found:
        got[place[r.id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int(((x[place[r.id]] * n - sums) ** 2).sum())
        assert r.identity_error <= 1e-4
        assert abs(r.explained - values[r.component - 1] * n / (centred**2).sum()) <= 1e-9
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-6


@pytest.mark.parametrize("n,d,scale", [(300, 40, 1.0), (50, 5, 1.0), (20, 40, 3.0), (200, 12, 1000.0)])
def test_against_dense_eigenvectors(spark, n, d, scale):
    rng = np.random.default_rng(n)
    spread = np.linspace(3, 0.4, d) * scale
    rows = [(i, [float(c) for c in (rng.standard_normal(d) * spread).astype(np.float32)]) for i in range(n)]
    docs = spark.createDataFrame(rows, KIND).repartition(4)
    compared(rows, whitening.whiten(docs).collect())


def test_dependent_dimensions_and_one_common_vector(spark):
    """A spectrum that ends early: the process finds a new direction and goes on."""
    rng = np.random.default_rng(2)
    base = (rng.standard_normal((120, 3)) * [4, 2, 1]).round(3)
    flat = np.c_[base, base[:, 0], np.full(120, 2.5), base[:, 1]]
    flat[:40] = flat[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(flat)]
    compared(rows, whitening.whiten(spark.createDataFrame(rows, KIND)).collect())


def test_bidiagonal_products():
    rng = np.random.default_rng(4)
    for x in (rng.standard_normal((50, 8)), rng.standard_normal((50, 2)) @ rng.standard_normal((2, 8)), np.zeros((5, 3)), np.diag([5.0, 5, 5, 1])):
        v, b = whitening.bidiagonalised(lambda w, many: (x.T @ (x @ w), (x @ many).T @ (x @ w), (x @ w) @ (x @ w)), x.shape[1])
        assert np.abs(v.T @ v - np.eye(len(v))).max() < 1e-12
        assert np.allclose(v @ b.T @ b @ v.T, x.T @ x, atol=1e-9)
        assert np.allclose(np.tril(b, -1), 0) and np.allclose(np.triu(b, 2), 0)


def test_nulls_repeats_empty_tables_and_extra_columns(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (None, [0.5, 0.25])]
    bad = [(3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, None)]
    docs = spark.createDataFrame(good + bad, KIND).selectExpr("*", "1 AS component", "2 AS n", "3 AS id")
    out = whitening.whiten(docs).collect()
    assert len(out) == 8 and all(r.n == 4 for r in out) and sorted((r.id is None, r.id) for r in out if r.component == 1) == [(False, 1), (False, 2), (False, 2), (True, None)]
    empty = whitening.whiten(docs.limit(0))
    assert empty.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0
    assert whitening.whiten(docs.where("vec_id = 1")).count() == 0  # one row has no spread
    assert whitening.whiten(docs.where("vec_id = 2")).count() == 0
    assert empty.schema == whitening.whiten(docs).schema or [f.dataType for f in empty.schema] == [f.dataType for f in whitening.whiten(docs).schema]
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], KIND))


def test_exact_deviations_beyond_products_of_longs():
    x = np.array([[1_000_000, 999_000], [1_000_500, 1_000_000]])
    n = 10**8
    sums = [1_000_000 * n + 17, 999_500 * n + 3]
    want = [int(sum((n * int(v) - s) ** 2 for v, s in zip(row, sums))) for row in x]
    assert whitening.deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want]


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    out = [r for r in queries.op11_whitening(spark, "/root/testdata/sf0.001").withColumnRenamed("vec_id", "id").collect()]
    compared([(r.vec_id, r.embedding) for r in rows], out)
