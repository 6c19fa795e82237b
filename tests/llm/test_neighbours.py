"""Recall and work of the routed search with many partitions, lengths by themselves, never a short list."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelscope.llm import neighbours

KIND = "vec_id long, embedding array<double>"


def table_of(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], KIND)


@pytest.mark.parametrize("kind,most_compared", [("clustered", 0.25), ("isotropic", 0.95)])
def test_recall_with_ten_partitions(spark, monkeypatch, kind, most_compared):
    """20,000 vectors; on clustered ones few rows are compared, on isotropic ones most have to be."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20_000, 32))
    if kind == "clustered":
        x = x * 0.25 + rng.standard_normal((200, 32))[rng.integers(0, 200, len(x))]
    seen = []
    real = neighbours.routed
    monkeypatch.setattr(neighbours, "routed", lambda *a, **k: seen.append((real(*a, **k), a)) or seen[-1][0])
    found = {}
    for r in neighbours.search(table_of(spark, x), lambda i: i % 200 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), 200):
        s = unit @ unit[q]
        s[q] = -9
        best = np.argsort(-s)[:5]
        rows = sorted(found[q])
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5] and all(abs(s[i] - score) < 1e-12 for _, i, score in rows)
        hits += len(set(best.tolist()) & {i for _, i, _ in rows})
    assert hits >= 0.9 * 500
    (_, _), (asked, arguments) = seen
    held = arguments[3]
    assert len(held) >= 8
    compared = np.mean([sum(held.get(p, 0) for p in r.parts) for r in asked.collect()]) / len(x)
    assert compared <= most_compared


def test_a_query_never_gets_a_short_list(spark):
    """One partition holds three rows only; its query goes on to others."""
    router = neighbours.Router(2, 4, 3)
    router.w = [np.zeros((2, 4)), np.zeros(4), np.zeros((4, 3)), np.log([0.99, 0.005, 0.005])]
    rows = table_of(spark, [[1.0, 0.0]]).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    assert neighbours.routed(rows, router, 0.97, {0: 3, 1: 50, 2: 9}, 21).first().parts == [0, 1]
    assert neighbours.routed(rows, router, 0.97, {0: 30}, 21).first().parts == [0]
    assert neighbours.routed(rows, router, 0.97, {0: 3}, 21).first().parts == [0, 1, 2]


def test_lengths_nulls_and_clashing_columns(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [0.9, 0.1, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [nan, 1.0]), (8, [1.0, None]), (None, [1.0, 1.0]), (9, [])]
    vectors = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS id", "2 AS v", "3 AS part", "0.5 AS score")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.search(vectors, lambda i: i % 3 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (3, 1, 4)]
    assert neighbours.search(vectors.limit(0), lambda i: i % 3 == 0).count() == 0
