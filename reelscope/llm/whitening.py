"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

With the centred rows X (n by d), X V = U B: V is orthonormal (d by k, held by the driver), U orthonormal (n by k), B upper
bidiagonal.  The singular values and right vectors of B, turned by V, are those of X, so the components and
deviations of the covariance.  U is never stored: u = X w for a vector w of d numbers, so one pass over the rows
takes u = X w, the product X'u, u's length and its products with all earlier u, each summed over the tasks.  Those
products reorthogonalise u in full; the v are reorthogonalised in full on the driver.  Where X v or X'u vanishes the process
goes on from a new direction orthogonal to all before.  With k = d steps all components are there to double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reelscope.llm.common import staged

#: Directions shorter than this share of the longest are rounding, not data.
TINY = 1e-12
LOW_BITS = 20


class Whitening(NamedTuple):
    """A fit: number of rows, sums (exact), components (one per column), their variances, and the total variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float

    def centre(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n in doubles; whole numbers are subtracted first, so nothing is lost to their size."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - part


def usable(vector: str) -> Column:
    """Vectors that are there and hold neither null nor a non-finite entry."""
    c = F.col(f"`{vector}`").cast("array<double>")
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce(F.forall(c, finite), F.lit(False))


def whole_rows(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x) of the usable vectors, x = floor(64 c) + 1000000 as longs."""
    c = F.col(f"`{vector}`").cast("array<double>")
    x = F.transform(c, lambda e: F.floor(F.lit(64.0) * e) + F.lit(1_000_000).cast("bigint"))
    return vectors.where(usable(vector)).select(F.col(f"`{id_column}`").alias("id"), x.alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], d: int, length: int, kind: str) -> list:
    """The sums over all rows of what ``of`` makes of a batch of x; each task passes one array on."""
    dtype = np.float64 if kind == "double" else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, dtype)
        for batch in batches:
            if batch.num_rows:
                total += of(matrix(batch.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.from_numpy_dtype(dtype)))], ["part"])

    parts = rows.select("x").mapInArrow(run, f"part array<{kind}>")
    values = parts.select(F.posexplode("part").alias("i", "value"))
    total = F.sum("value" if kind == "double" else F.col("value").cast("decimal(38,0)"))
    found = values.groupBy("i").agg(total.alias("total")).collect()  # ``length`` rows
    out = [0] * length
    for row in found:
        out[row.i] = row.total if kind == "double" else int(row.total)
    return out


def bidiagonalised(multiply: Callable, d: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) of d steps.  ``multiply(w, W)`` gives X'Xw, the products of Xw with the columns of XW, and |Xw|^2."""
    rng = np.random.default_rng(seed)
    v_all, w_all, g_all = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    b = np.zeros((d, d))
    longest = 0.0

    def apart(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - v_all @ (v_all.T @ v)
        return v

    def fresh() -> np.ndarray:
        v = apart(rng.standard_normal(d))
        return v / np.linalg.norm(v)

    v, beta = fresh(), 0.0
    for j in range(d):
        v_all = np.c_[v_all, v]
        w = v - beta * w_all[:, -1] if j else v
        g, products, square = multiply(w, w_all)
        w, g = w - w_all @ products, g - g_all @ products
        alpha = float(np.sqrt(max(0.0, square - products @ products)))
        longest = max(longest, alpha)
        if alpha <= TINY * longest or not alpha:
            w, g, alpha = np.zeros(d), np.zeros(d), 0.0
        else:
            w, g = w / alpha, g / alpha
        w_all, g_all = np.c_[w_all, w], np.c_[g_all, g]
        b[j, j] = alpha
        if j + 1 < d:
            v = apart(g - alpha * v)
            beta = float(np.linalg.norm(v))
            longest = max(longest, beta)
            if beta <= TINY * longest or not beta:
                v, beta = fresh(), 0.0
            else:
                v = apart(v / beta)
                v = v / np.linalg.norm(v)
            b[j, j + 1] = beta
    return v_all, b


def fit(rows: DataFrame, most: int = 32) -> Whitening | None:
    """Components of the covariance of ``rows`` (x; all of one length), the ``most`` largest; None without rows or spread."""
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("d")).first()
    n, d = sizes.n, sizes.d
    if not n or not d:
        return None
    if sizes.least != d:
        raise ValueError(f"vectors of {sizes.least} to {d} entries have no common covariance")
    halves = summed(rows, lambda x: np.r_[(x >> LOW_BITS).sum(axis=0), (x & ((1 << LOW_BITS) - 1)).sum(axis=0)], d, 2 * d, "bigint")
    sums = [(high << LOW_BITS) + low for high, low in zip(halves[:d], halves[d:])]

    def multiply(w: np.ndarray, w_all: np.ndarray):
        k = w_all.shape[1]

        def of(x: np.ndarray) -> np.ndarray:
            x = centred(x, n, sums)
            u = x @ w
            return np.r_[x.T @ u, (x @ w_all).T @ u, u @ u]

        found = np.array(summed(rows, of, d, d + k + 1, "double"))
        return found[:d], found[d : d + k], found[-1]

    v, b = bidiagonalised(multiply, d)
    _, values, right = np.linalg.svd(b)
    kept = int((values > 1e-10 * max(values[0], np.finfo(float).tiny)).sum())
    components = (v @ right.T)[:, : min(kept, most)]
    if not components.shape[1]:
        return None
    components = components / np.linalg.norm(components, axis=0)
    components = components * np.sign(components[np.argmax(np.abs(components), axis=0), np.arange(components.shape[1])])
    return Whitening(n, sums, components, values[: components.shape[1]] ** 2 / n, float(values @ values) / n)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    d, k = model.components.shape

    def of(x: np.ndarray) -> np.ndarray:
        w = model.centre(x) @ model.components / np.sqrt(model.variances)
        return np.r_[(w.T @ w).ravel(), w.sum(axis=0)]

    found = np.array(summed(rows, of, d, k * k + k, "double")) / model.n
    return float(np.abs(found[: k * k].reshape(k, k) - np.outer(found[k * k :], found[k * k :]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 over the dimensions of each row, exact; None where a long cannot hold it."""
    whole, part = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    x = x - whole
    largest = int(np.abs(x).max(initial=0)) * n + n
    if largest * largest * max(1, len(sums)) < 1 << 62:
        return ((x * n - part) ** 2).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - part.astype(object)) ** 2).sum(axis=1)
    return [int(e) if e < 1 << 63 else None for e in exact]


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, component, n, deviation, whitened, explained): one row per row and component."""
    d, k = model.components.shape
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = matrix(part.column(1), d)
                w = model.centre(x) @ model.components / np.sqrt(model.variances)
                which = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(which)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(which), model.n, np.int64)), pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(which)),
                        pa.array(w.ravel()), pa.array(np.tile(model.variances / model.total, len(x))),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained"],
                )

    return rows.select("id", "x").mapInArrow(run, f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double")


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of all usable vectors, up to ``most`` components.

    Vectors that are null or hold null or non-finite entries are left out; null ids and repeated rows stay, each a row of its
    own; extra columns are not read.  Components without spread (in a table of few or equal rows) are not returned, so an
    empty table, and one of equal vectors, gives no rows.  Vectors of different lengths raise ValueError.
    """
    rows = staged(whole_rows(vectors, id_column, vector), "whitening-rows")
    model = fit(rows, most)
    if model is None:
        return rows.selectExpr("id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error").limit(0)
    return whitened(rows, model).withColumn("identity_error", F.lit(identity_error(rows, model)))
