"""Similar assets against a plain loop: near frames, frames that everyone shows, copies, nulls, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from reelscope.operators import assets as A


def flip(rng, value, bits):
    for at in rng.sample(range(64), bits):
        value ^= 1 << at
    return value


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_similar_against_a_loop(spark, threshold):
    rng = random.Random(int(threshold * 10))
    pool = [rng.getrandbits(64) for _ in range(60)]
    black = rng.getrandbits(64)
    held, asked = {}, {}
    for i in range(80):
        held[i] = {flip(rng, rng.choice(pool), rng.randrange(3)) for _ in range(rng.randrange(1, 8))} | ({black} if i % 3 else set())
    for i in range(40):
        asked[i] = {flip(rng, h, rng.randrange(5)) for h in held[rng.randrange(80)]} | ({black} if i % 2 else set())
    held[100], held[101], asked[50], asked[51] = set(held[3]), {black}, set(held[3]), {black}
    rows = lambda sets: [(i, signed(h)) for i, s in sets.items() for h in s] + [(999, None)]
    found = A.similar(
        spark.createDataFrame(rows(asked), "request_id long, hash long").withColumn("asset_id", F.lit(1)).drop("asset_id"),
        spark.createDataFrame(rows(held) * 2, "asset_id long, hash long"), threshold,
    )
    def once(sets):
        out = {}
        for i, s in sorted(sets.items()):
            out.setdefault(frozenset(s), []).append(i)
        return {ids[0]: (len(ids), s) for s, ids in out.items()}
    want = set()
    for r, (nr, a) in once(asked).items():
        for c, (nc, b) in once(held).items():
            votes = sum(any(bin(x ^ y).count("1") <= 3 for y in b) for x in a)
            if votes and votes >= threshold * len(a) - 1e-9:
                want.add((r, nr, c, nc, votes, len(a)))
    assert {(r.request_id, r.request_copies, r.asset_id, r.copies, r.votes, r.frames) for r in found.collect()} == want


def test_joined_rows_grow_with_the_tables(spark):
    """Twice the requests and assets: twice the candidates, not four times (a frame that all show is no key)."""
    def candidates(n):
        frames = spark.range(n * 6).select((F.col("id") / 6).cast("long").alias("k"), F.when(F.col("id") % 6 < 2, F.lit(7)).otherwise(F.xxhash64(F.lit("f"), "id")).alias("hash"))
        return A.similar(frames.withColumnRenamed("k", "request_id"), frames.withColumnRenamed("k", "asset_id"), 0.8).count()
    assert (candidates(200), candidates(400)) == (200, 400)


def test_results_and_predictions(spark):
    held = spark.createDataFrame([(1, 31), (2, 31), (3, 1 << 40)], "asset_id long, hash long")
    asked = spark.createDataFrame([(7, 31), (7, 1 << 40)], "request_id long, hash long")
    day = "timestamp'2024-01-0%d'"
    results = spark.sql("SELECT * FROM VALUES " + ", ".join([
        f"(2L, 1L, {day % 1}, cast(NULL AS timestamp), 80.0D, 0.9D)", f"(1L, 2L, {day % 2}, {day % 3}, 99.0D, 0.1D)", f"(3L, 3L, {day % 1}, {day % 9}, 60.0D, cast(NULL AS double))",
    ]) + " AS t(asset_id, result_id, ts, expires_at, vmaf, ssim)")
    out = A.cached_results(A.similar(asked, held, 0.5), held, results, F.expr(day % 5))
    assert sorted((r.asset_id, r.copies, r.result_id, r.vmaf) for r in out.collect()) == [(1, 2, 1, 80.0), (3, 1, 3, 60.0)]
    (r,) = A.predicted_quality(out).collect()
    assert (r.request_id, r.results, r.vmaf, r.ssim) == (7, 2, 70.0, 0.9) and r.confidence == pytest.approx(0.55)
    assert A.predicted_quality(out.where("asset_id = 1")).count() == 0
    assert A.similar(asked.limit(0), held).count() == 0 and A.similar(asked, held.limit(0)).count() == 0
