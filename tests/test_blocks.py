"""Block-wise operators against plain windows and plain loops, with blocks far smaller than the groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelscope.operators import blocks as B, folds, windows as W


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = []
    for i in range(900):
        group = 0 if rnd.random() < 0.6 else rnd.randrange(1, 6)  # one hot group
        data.append((group, i * 3 + rnd.randrange(2), rnd.randrange(50), None if rnd.random() < 0.1 else float(rnd.randrange(100))))
    return spark.createDataFrame(data, "g int, t long, id long, v double").cache()


def test_carried_matches_window(rows):
    got = B.carried(
        rows, ["g"], ["t", "id"], B.by_value("t", 40), number="n", sums={"s": F.col("v")}, previous={"p": "v"}, following={"f": "v"},
        maxima={"m": F.col("v")},
    ).select("g", "t", "id", "v", "n", "s", "p", "f", "m")
    w = Window.partitionBy("g").orderBy("t", "id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select(
        "*", F.row_number().over(w).alias("n"), F.sum("v").over(run).alias("s"), F.lag("v").over(w).alias("p"),
        F.lead("v").over(w).alias("f"), F.max("v").over(run).alias("m"),
    )
    key = lambda r: (r.g, r.t, r.id)
    assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]


def test_carried_without_group(rows):
    got = B.carried(rows, [], ["t", "id"], B.by_value("t", 40), number="n", sums={"s": F.lit(1)})
    assert all(r.n == r.s for r in got.collect())
    assert sorted(r.n for r in got.collect()) == list(range(1, 901))


def test_lags(spark):
    data = [(g, i, float(g * 100 + i)) for g, n in ((0, 200), (1, 3)) for i in range(1, n + 1)]
    df = spark.createDataFrame(data, "g int, step long, v double")
    got = {(r.g, r.step): (r.a, r.b) for r in B.with_lags(df, ["g"], "step", {"a": ("v", 1), "b": ("v", 2)}, size=16).collect()}
    for g, i, v in data:
        assert got[g, i] == (v - 1 if i > 1 else None, v - 2 if i > 2 else None)


def test_trend_matches_least_squares(rows):
    clean = rows.where("v IS NOT NULL")
    got = {r.g: r for r in B.trend(clean, ["g"], ["t", "id"], B.by_value("t", 40), {"v": F.col("v")}).collect()}
    by = {}
    for r in sorted(clean.collect(), key=lambda r: (r.t, r.id)):
        by.setdefault(r.g, []).append(r.v)
    for g, ys in by.items():
        assert got[g].n == len(ys)
        assert got[g].slope_v == pytest.approx(np.polyfit(range(len(ys)), ys, 1)[0], abs=1e-9)
        assert got[g].avg_v == pytest.approx(np.mean(ys))


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [7.0] * 500 + [1.0, 9.0], list(np.random.default_rng(1).normal(size=3001)), [1.0] * 100 + [2.0] * 100])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    row = B.exact_median(df, "x").first()
    assert row.n == len(values) and row.median == pytest.approx(float(np.median(values)), abs=0)


def test_recent_count(spark):
    rnd = random.Random(5)
    data = [(rnd.randrange(2), i, 1_700_000_000 + rnd.randrange(5000), rnd.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame(data, "g int, id long, s long, bad boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.c for r in W.recent_count(df, ["g"], "ts", 60, F.col("bad"), "c", block_s=100).collect()}
    for g, i, s, _ in data:
        assert got[i] == sum(1 for h, _, t, b in data if h == g and b and s - 60 <= t <= s)


def greedy_runs(xs, limit):
    out, run, cur = [], None, []
    for i, x in enumerate(xs):
        if run is None or (len(cur) >= 2 and abs(x - sum(cur) / len(cur)) > limit):
            run, cur = i, []
        cur.append(x)
        out.append(run)
    return out


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_fold_runs_match_loop(spark, size):
    rnd = random.Random(size)
    xs = [rnd.random() * (1 if i % 37 < 20 else 0.2) for i in range(150)]
    df = spark.createDataFrame([(v, i, xs[i]) for v in (1, 2) for i in range(150)], "video_id long, frame_idx long, motion double")
    out = folds.block_fold(
        df, ["video_id"], ["frame_idx"], B.index_block("frame_idx", size), ["frame_idx", "motion"], W._run_step(0.3),
        "struct<run:bigint,n:bigint,total:double>", "run bigint",
    )
    want = greedy_runs(xs, 0.3)
    for r in out.collect():
        assert r.run == want[r.frame_idx]


def test_fold_of_a_still_video_takes_few_rounds(spark, monkeypatch):
    """Each block depends on the one before; rounds grow with the logarithm of their number."""
    rounds = []
    real = folds.checkpointed
    monkeypatch.setattr(folds, "checkpointed", lambda df: rounds.append(1) or real(df))
    df = spark.createDataFrame([(1, i, [4, 4, 8], 100) for i in range(640)], "video_id long, frame_idx long, hist array<long>, show_ms int")
    (row,) = W.dedup_frames(df, 0.95, block=10).collect()
    assert (row.frame_idx, row.frames, row.show_ms) == (0, 640, 64000)
    assert len(rounds) <= 6  # rows, first pass, and spans of 4, 16, 64 blocks


def test_dedup_matches_loop(spark):
    rnd = np.random.default_rng(2)
    hists, cur = [], rnd.integers(1, 50, 8)
    for i in range(60):
        cur = rnd.integers(1, 50, 8) if i % 13 == 0 else np.maximum(cur + rnd.integers(-3, 4, 8), 0)
        hists.append([int(x) for x in cur])
    df = spark.createDataFrame([(1, i, h, 100) for i, h in enumerate(hists)], "video_id long, frame_idx long, hist array<long>, show_ms int")
    got = {r.frame_idx: r.show_ms for r in W.dedup_frames(df, 0.9, block=5).collect()}
    want, kept = {}, None
    for i, h in enumerate(hists):
        p = np.array(h) / sum(h)
        if kept is not None and np.minimum(p, np.array(hists[kept]) / sum(hists[kept])).sum() >= 0.9:
            want[kept] += 100
        else:
            kept, want[i] = i, 100
    assert got == want


def test_overlap_matches_loop(spark):
    rnd = random.Random(9)
    rows = [(1, i, float(rnd.randrange(500)), rnd.choice(["temporal", "scene", "complexity"])) for i in range(200)]
    df = spark.createDataFrame([(v, i, s, s + 5.0, 5.0, t) for v, i, s, t in rows],
                               "video_id long, sample_id long, start_s double, end_s double, duration_s double, sample_type string")
    got = sorted(r.sample_id for r in W.sample_overlap(df, block_s=20.0).collect())
    kept = []
    for _, i, s, t in sorted(rows, key=lambda r: (r[2], r[1])):
        if not kept or s >= kept[-1][1] + 5.0:
            kept.append((i, s, t))
        elif W.SAMPLE_RANK[t] > W.SAMPLE_RANK[kept[-1][2]]:
            kept[-1] = (i, s, t)
    assert got == sorted(k[0] for k in kept)


def test_motion_segments_merge(spark):
    motion = [0.02, 0.02, 0.5, 0.5, 0.02, 0.02, 0.02, 0.02, 0.02, 0.9, 0.9]
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate(motion)], "video_id long, frame_idx long, motion double")
    length = spark.createDataFrame([(1, 2.4)], "video_id long, duration_s double")
    got = [(round(r.start_s, 3), round(r.end_s, 3), round(r.avg_motion, 6)) for r in
           W.motion_segments(df, F.lit(18.0), length, block=3).orderBy("start_s").collect()]
    assert got == [(0.0, 0.8, 0.26), (0.8, 1.8, 0.02), (1.8, 2.4, 0.9)]


@pytest.mark.parametrize("group", [["g"], []])
def test_carried_at_sampled_borders(spark, group):
    """The hot group is cut (its rows exceed a share of the sample), null groups and keys are groups and keys."""
    rnd = random.Random(8)
    data = [(None if rnd.random() < 0.1 else 0 if rnd.random() < 0.7 else rnd.randrange(1, 300), None if i % 97 == 0 else rnd.randrange(700), i, float(rnd.randrange(100)), rnd.random() < 0.01) for i in range(4000)]
    df = spark.createDataFrame(data, "g int, t long, id long, v double, ok boolean").withColumn("ts", F.timestamp_seconds(F.col("t") * 86400))
    for order in (["ts", "id"], ["t", "id"]):
        assert B.borders(df, group, order).count() > 8
        got = B.carried(
            df, group, order, number="n", sums={"s": F.col("v"), "z": F.when(F.col("ok"), F.col("v"))}, previous={"p": "id"}, following={"f": "id"},
            maxima={"m": F.col("id")}, last={"l": F.col("ok")},
        ).select("id", "n", "s", "z", "p", "f", "m", "l")
        seen: dict = {}
        want = []
        for g, t, i, v, ok in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            at = seen.setdefault(g if group else 0, {"n": 0, "s": 0.0, "z": None, "p": None, "m": 0, "l": None, "rows": []})
            at["n"], at["s"], at["m"] = at["n"] + 1, at["s"] + v, max(at["m"], i)
            if ok:
                at["z"], at["l"] = (at["z"] or 0.0) + v, at["n"]
            row = [i, at["n"], at["s"], at["z"], at["p"], None, at["m"], at["l"]]
            if at["rows"]:
                at["rows"][-1][5] = i
            at["rows"].append(row)
            at["p"] = i
            want.append(row)
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want)


def test_small_groups_are_not_cut(spark):
    df = spark.range(3000).select((F.col("id") % 1000).alias("g"), "id")
    assert B.borders(df, ["g"], ["id"]) is None
    assert B.borders(df.limit(0), [], ["id"]) is None
    assert B.carried(df.limit(0), ["g"], ["id"], number="n", previous={"p": "id"}).collect() == []
    plan = B.carried(df, ["g"], ["id"], number="n", previous={"p": "id"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def still(rounds, monkeypatch):
    real = folds.checkpointed
    monkeypatch.setattr(folds, "checkpointed", lambda df: rounds.append(1) or real(df))


@pytest.mark.parametrize("frames", [200, 3200])
def test_still_videos_take_the_same_rounds_at_any_length(spark, monkeypatch, frames):
    """Maps of blocks compose, so the number of rounds does not depend on the number of blocks."""
    rounds = []
    still(rounds, monkeypatch)
    df = spark.createDataFrame([(v, i, 0.25) for v in (1, 2) for i in range(frames)], "video_id long, frame_idx long, motion double")
    kinds = "struct<run:bigint,n:bigint,total:double>"
    out = folds.block_fold(df, ["video_id"], ["frame_idx"], B.index_block("frame_idx", 10), ["frame_idx", "motion"], W._run_step(0.3), kinds, "run bigint", added=("n", "total"))
    assert out.groupBy("video_id", "run").count().collect() and {r.run for r in out.collect()} == {0}
    assert len(rounds) == 5  # rows, states, what changed, states, nothing changed


@pytest.mark.parametrize("size,seed", [(2, 1), (5, 2), (16, 3)])
def test_slow_drifts_match_a_loop(spark, size, seed):
    """Means that creep over many blocks before they break: maps assumed at first are wrong, the result is not."""
    rnd = random.Random(seed)
    xs, x = [], 0.5
    for i in range(240):
        x = rnd.random() if rnd.random() < 0.03 else x + 0.012 * rnd.random()
        xs.append(x)
    df = spark.createDataFrame([(v, i, xs[i]) for v in (1, 2) for i in range(240)], "video_id long, frame_idx long, motion double")
    out = folds.block_fold(
        df, ["video_id"], ["frame_idx"], B.index_block("frame_idx", size), ["frame_idx", "motion"], W._run_step(0.2),
        "struct<run:bigint,n:bigint,total:double>", "run bigint", added=("n", "total"),
    )
    want = greedy_runs(xs, 0.2)
    assert all(r.run == want[r.frame_idx] for r in out.collect())


@pytest.mark.parametrize("group", [["g"], []])
def test_cut_groups_with_order_keys_that_are_never_null(spark, group):
    df = spark.range(20000).select(F.lit(1).alias("g"), F.coalesce("id", F.lit(0)).alias("t"), (F.col("id") % 7).alias("v"))
    assert not df.schema["t"].nullable and B.borders(df, group, ["t"]).count() > 1
    got = B.carried(df, group, ["t"], number="n", sums={"s": F.col("v")}, previous={"p": "v"})
    assert got.where((F.col("n") != F.col("t") + 1) | (F.coalesce("p", F.lit(-1)) != F.when(F.col("t") > 0, (F.col("t") - 1) % 7).otherwise(-1))).isEmpty()
    assert got.agg(F.max("s")).first()[0] == sum(i % 7 for i in range(20000))


def test_lru_evict_with_very_many_rows_of_one_time(spark):
    """The rows of the one time at the limit are ordered by a key that is never null, and cut."""
    cache = spark.range(20000).select(F.md5(F.col("id").cast("string")).alias("cache_key"), F.lit(1.0).alias("data_size"), F.lit(7).alias("last_accessed"))
    assert not cache.schema["cache_key"].nullable
    got = {r.cache_key for r in W.lru_evict(cache, 1000.0).select("cache_key").collect()}
    assert got == {r.cache_key for r in cache.orderBy("cache_key").limit(20000 - 800).collect()}


def test_rounds_of_a_fold_start_from_plain_tables(spark):
    """A table kept between the rounds carries nothing of the plan that made it (F9: rounds that took longer and longer)."""
    from reelscope.operators import folds

    kept = folds.checkpointed(spark.range(20).selectExpr("id AS a", "id * 2 AS b").where("a > 3 AND b < 30"))
    assert kept.count() == 11 and kept.columns == ["a", "b"]
    assert kept._jdf.queryExecution().analyzed().constraints().isEmpty()
