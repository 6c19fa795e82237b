"""Ordered analytics. Groups are cut into blocks (see ``blocks``), so one huge group is shared by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from reelscope.functions import scalars as S
from reelscope.operators import blocks as B
from reelscope.session import stored


def mean_abs_diff(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return total / F.size(a)


def frame_motion(frames: DataFrame) -> DataFrame:
    """Mean absolute pixel change to the previous frame, over 255 (null for a first frame)."""
    base = frames.select("video_id", "frame_idx", "ts_s", "pixels")
    out = B.carried(base, ["video_id"], ["frame_idx"], previous={"_prev": "pixels"})
    return out.select("video_id", "frame_idx", "ts_s", (mean_abs_diff(F.col("pixels"), F.col("_prev")) / 255).alias("motion"))


def motion_level(avg: Column, top: Column, var: Column, high=0.15, peak=0.3, medium=0.05, spread=0.01) -> Column:
    return F.when((avg > high) | (top > peak), "high").when((avg > medium) | (var > spread), "medium").otherwise("low")


def video_motion_level(motion: DataFrame, fps: Column, **limits) -> DataFrame:
    """Per video: motion level, recommended frame rate and a five-step range, all within 6-20 fps."""
    agg = motion.where("motion IS NOT NULL").groupBy("video_id").agg(
        F.avg("motion").alias("avg_motion"), F.max("motion").alias("max_motion"), F.var_pop("motion").alias("var_motion")
    )
    level = motion_level(F.col("avg_motion"), F.col("max_motion"), F.col("var_motion"), **limits)
    fit = lambda c: S.clamp(c, 6.0, 20.0)
    steps = {"high": (1.0, 0.95, 0.9, 0.85, 0.8), "medium": (0.9, 0.8, 0.7, 0.6, 0.5), "low": (0.7, 0.6, 0.5, 0.4, 0.3)}
    best = S.lookup(F.col("motion_level"), {"high": 1.0, "medium": 0.9, "low": 0.7}, 1.0)
    ladder = F.when(F.lit(False), F.array().cast("array<double>"))
    for name, mults in steps.items():
        ladder = ladder.when(F.col("motion_level") == name, F.array(*[fit(F.col("_fps") * m) for m in mults]))
    return (
        agg.withColumn("motion_level", level).withColumn("_fps", fps)
        .withColumns({"optimal_fps": fit(F.col("_fps") * best), "fps_range": ladder}).drop("_fps")
    )


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two equally long arrays; 1 when both are flat."""
    n = F.size(a).cast("double")
    fold = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    sa, sb = fold(a), fold(b)
    num = dot(a, b) - sa * sb / n
    den = F.sqrt((dot(a, a) - sa * sa / n) * (dot(b, b) - sb * sb / n))
    return F.coalesce(F.try_divide(num, den), F.lit(1.0))


def frame_similarity(hist: DataFrame) -> DataFrame:
    """Histogram correlation of each frame with the one before. Needs video_id, frame_idx, hist."""
    out = B.carried(hist.select("video_id", "frame_idx", "hist"), ["video_id"], ["frame_idx"], previous={"_prev": "hist"})
    sim = F.when(F.col("_prev").isNotNull(), correlation(F.col("hist"), F.col("_prev")))
    return out.select("video_id", "frame_idx", sim.alias("similarity"))


def similarity_level(similarity: DataFrame, duplicate: float = 0.95) -> DataFrame:
    agg = similarity.where("similarity IS NOT NULL").groupBy("video_id").agg(
        F.avg("similarity").alias("avg_similarity"), F.min("similarity").alias("min_similarity"),
        F.var_pop("similarity").alias("var_similarity"),
        (F.count_if(F.col("similarity") >= duplicate) / F.count(F.lit(1))).alias("duplicate_share"),
    )
    level = (
        F.when((F.col("avg_similarity") > 0.9) | (F.col("min_similarity") > 0.85), "high")
        .when((F.col("avg_similarity") > 0.7) | (F.col("var_similarity") < 0.01), "medium").otherwise("low")
    )
    return agg.withColumn("similarity_level", level).withColumn(
        "optimal_frac", S.lookup(F.col("similarity_level"), {"high": 0.1, "medium": 0.2, "low": 0.3})
    )


def islands(df: DataFrame, group: list[str], value: str, tie: str, gap: float) -> DataFrame:
    """Number runs in which neighbouring values are at most ``gap`` apart (column ``island``)."""
    prev = B.carried(df, group, [value, tie], previous={"_pv": value})
    new = F.when(F.col("_pv").isNull() | (F.col(value) - F.col("_pv") > gap), 1).otherwise(0)
    return B.carried(
        prev.withColumn("_new", new), group, [value, tie], sums={"island": F.col("_new")}
    ).drop("_pv", "_new")


def regions(points: DataFrame, threshold: float = 0.3, gap: float = 10.0, min_s: float = 0.5, max_s: float = 3.0) -> DataFrame:
    """Regions of high complexity: start, end, mean complexity, and the sample cut from each."""
    high = points.where(F.col("complexity") >= threshold).select("video_id", "ts_s", "point_id", "complexity")
    marked = islands(high, ["video_id"], "ts_s", "point_id", gap)
    out = marked.groupBy("video_id", "island").agg(
        F.min("ts_s").alias("start_s"), F.max("ts_s").alias("end_s"), F.avg("complexity").alias("avg_complexity")
    )
    length = F.col("end_s") - F.col("start_s")
    return out.where(length >= min_s).withColumn("sample_end_s", F.col("start_s") + F.least(F.lit(max_s), length)).drop("island")


def scene_intervals(transitions: DataFrame, assets: DataFrame, min_s: float = 0.5) -> DataFrame:
    """Cuts (video_id, cut_s, point_id) to [start, end); the last scene ends with the video."""
    nxt = B.carried(transitions, ["video_id"], ["cut_s", "point_id"], following={"_next": "cut_s"})
    j = nxt.join(assets.select("video_id", "duration_s"), "video_id")
    out = j.select("video_id", "point_id", F.col("cut_s").alias("start_s"), F.coalesce("_next", "duration_s").alias("end_s"))
    return out.where(F.col("end_s") - F.col("start_s") >= min_s)


def lru_evict(cache: DataFrame, limit: float, keep: float = 0.8) -> DataFrame:
    """Least recently used rows to remove when the cache is over ``limit``.

    Rows go, oldest first and by key within one time, until what is removed reaches
    total - keep*limit.  Sizes are summed per access time; the running sum over those times finds
    the one time at which the target is reached.  Everything older goes by a plain filter, and only
    the rows of that time are ordered, in blocks along their key where they are many.  The sums, the time
    found and its rows are kept in the shared folder, so the cache is read three times.
    """
    per_time = stored(cache.groupBy("last_accessed").agg(F.sum("data_size").alias("_s")))
    total = per_time.agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("t")).scalar()
    run = B.carried(per_time, [], ["last_accessed"], sums={"_run": F.col("_s")})
    need = F.when(F.col("_total") > limit, F.col("_total") - float(int(limit * keep))).otherwise(0.0)
    reached = run.withColumn("_total", total).withColumn("_before", F.col("_run") - F.col("_s")).where(F.col("_before") < need)
    last = F.max_by(F.struct("last_accessed", "_before", need.alias("_need")), "last_accessed")
    cut = stored(reached.agg(last.alias("_c"))).scalar()
    marked = cache.withColumn("_c", cut)
    older = marked.where(F.col("last_accessed") < F.col("_c.last_accessed")).drop("_c")
    at_cut = stored(marked.where(F.col("last_accessed") == F.col("_c.last_accessed")).drop("_c"))
    ordered = B.carried(at_cut, [], ["cache_key"], sums={"_run": F.col("data_size")}).withColumn("_c", cut)
    rest = ordered.where(F.col("_c._before") + F.col("_run") - F.col("data_size") < F.col("_c._need"))
    return older.unionByName(rest.select(*cache.columns))


def sample_budget(samples: DataFrame, seconds: float, min_tail: float = 0.5) -> DataFrame:
    """Keep samples in time order until ``seconds`` are used; cut the crossing one if enough is left."""
    run = B.carried(samples, ["video_id"], ["start_s", "sample_id"], sums={"_run": F.col("duration_s")})
    before = F.col("_run") - F.col("duration_s")
    fits = F.col("_run") <= seconds
    # Only the first crossing sample may be cut: every later one starts beyond the budget.
    crossing = ~fits & (before <= seconds) & (seconds - before > min_tail)
    used = F.when(fits, F.col("duration_s")).otherwise(seconds - before)
    return (
        run.where(fits | crossing).withColumn("duration_s", used)
        .withColumn("end_s", F.col("start_s") + F.col("duration_s")).drop("_run")
    )


def convergence(
    attempts: DataFrame, group: list[str], max_iterations: int = 5, threshold: float = 1.0, drop: float = 2.0, block: int = 4096
) -> DataFrame:
    """Status after each attempt, from the last three scores. Needs step (1, 2, ... without gaps) and quality."""
    two = B.with_lags(attempts.withColumn("_i", F.col("step")), group, "step", {"_q1": ("quality", 1), "_q2": ("quality", 2)}, block)
    q0, q1, q2 = F.col("quality"), F.col("_q1"), F.col("_q2")
    known = q0.isNotNull() & q1.isNotNull() & q2.isNotNull()
    best = F.greatest(F.lit(0.0), q0 - q1, q1 - q2)
    mean = (q0 + q1 + q2) / 3
    var = ((q0 - mean) * (q0 - mean) + (q1 - mean) * (q1 - mean) + (q2 - mean) * (q2 - mean)) / 3
    status = (
        F.when(F.col("_i") >= max_iterations, "max_iterations")
        .when((F.col("_i") < 4) | ~known, "improving")
        .when(best < threshold, F.when(var < 0.1, "converged").otherwise("stagnant"))
        .when(q0 - q2 < -drop, "diverging")
        .otherwise("improving")
    )
    return two.withColumn("status", status).drop("_i", "_q1", "_q2")


def recent_count(df: DataFrame, group: list[str], ts: str, seconds: int, test: Column, name: str, block_s: int = 3600) -> DataFrame:
    """Rows passing ``test`` in the last ``seconds`` up to and including each row.

    Each block also receives the tail of the block before it, so windows stay inside blocks.
    """
    block_s = max(block_s, seconds)  # a window then reaches at most one block back
    sec = F.col(ts).cast("timestamp").cast("double")
    base = df.withColumn("_t", sec).withColumn(B.BLOCK, F.floor(sec / block_s))
    late = F.col("_t") >= (F.col(B.BLOCK) + 1) * block_s - seconds
    copies = F.when(late & test, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = base.withColumn("_ctx", F.explode(copies)).withColumn(B.BLOCK, F.col(B.BLOCK) + F.col("_ctx"))
    w = Window.partitionBy(*group, B.BLOCK).orderBy("_t").rangeBetween(-seconds, 0)
    return spread.withColumn(name, F.count_if(test).over(w)).where("_ctx = 0").drop("_ctx", "_t", B.BLOCK)


def failure_runs(attempts: DataFrame, window_s: int = 60) -> DataFrame:
    """After each attempt: consecutive failures, time used so far, failures in the last minute."""
    fail = F.col("result") == "FAILURE"
    group, order = ["session_id"], ["ts", "attempt_id"]
    runs = B.carried(attempts, group, order, number="attempt_no", sums={"total_time": F.col("duration")}, last={"_last_ok": ~fail})
    out = runs.withColumn("consecutive_failures", F.col("attempt_no") - F.coalesce("_last_ok", F.lit(0))).drop("_last_ok")
    return recent_count(out, group, "ts", window_s, fail, "recent_failures")


def degradation(sessions: DataFrame, group: list[str], last: int = 5, least: int = 3, limit: float = 0.2) -> DataFrame:
    """Slope of successful durations among each group's last sessions (top-k is cut before the shuffle)."""
    w = Window.partitionBy(*group).orderBy(F.col("start_ts").desc(), F.col("session_id").desc())
    tail = sessions.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    size = F.count(F.lit(1))
    good = F.col("success") & (F.coalesce("duration", F.lit(0.0)) != 0)
    gathered = tail.groupBy(*group).agg(
        size.alias("_n"),
        F.sort_array(F.collect_list(F.when(good, F.struct((-F.col("_r")).alias("o"), "duration")))).alias("_d"),
    )
    d = F.transform("_d", lambda x: x["duration"])
    n = F.size("_d")
    mx = (n - 1) / 2.0
    my = F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / n
    cov = F.aggregate(F.transform(d, lambda x, i: (i - mx) * (x - my)), F.lit(0.0), lambda a, x: a + x)
    var = (n * n - 1) * n / 12.0
    slope = F.try_divide(cov, var)
    out = gathered.where((F.col("_n") >= last) & (n >= least))
    return out.select(*group, n.cast("bigint").alias("n"), slope.alias("slope"), (slope > limit).alias("degrading"))


def improvement(attempts: DataFrame, group: list[str], block: int = 4096) -> DataFrame:
    """Step gain (quality plus ten times quality per MB), 0 where unknown. Steps count 1, 2, ... without gaps."""
    prev = B.with_lags(attempts, group, "step", {"_pq": ("quality", 1), "_pm": ("size_mb", 1)}, block)
    known = (F.coalesce("quality", F.lit(0.0)) != 0) & (F.coalesce("_pq", F.lit(0.0)) != 0)
    sized = (F.coalesce("size_mb", F.lit(0.0)) != 0) & (F.coalesce("_pm", F.lit(0.0)) != 0)
    gain = F.col("quality") - F.col("_pq")
    eff = (F.try_divide(F.col("quality"), F.col("size_mb")) - F.try_divide(F.col("_pq"), F.col("_pm"))) * 10
    step_gain = F.when(known, gain + F.when(sized, eff).otherwise(0.0)).otherwise(0.0)
    return prev.withColumn("step_gain", step_gain).drop("_pq", "_pm")


def total_improvement(attempts: DataFrame, group: list[str]) -> DataFrame:
    first, last = F.min_by("quality", "step"), F.max_by("quality", "step")
    ok = (F.coalesce(first, F.lit(0.0)) != 0) & (F.coalesce(last, F.lit(0.0)) != 0)
    return attempts.groupBy(*group).agg(F.when(ok, last - first).otherwise(0.0).alias("total_gain"))


# ---------------------------------------------------------------- greedy passes


def _run_step(limit: float):
    def step(state, row):
        idx, x = int(row[0]), float(row[1])
        split = state is not None and state["n"] >= 2 and abs(x - state["total"] / state["n"]) > limit
        if state is None or split:
            return idx, {"run": idx, "n": 1, "total": x}
        return state["run"], {"run": state["run"], "n": state["n"] + 1, "total": state["total"] + x}

    return step


def motion_segments(
    motion: DataFrame, fps: Column, duration: DataFrame, limit: float = 0.1, step_s: float = 0.2, min_s: float = 0.5,
    high: float = 0.15, medium: float = 0.05, block: int = 4096,
) -> DataFrame:
    """Split each video where motion leaves the running mean, then merge short segments backwards.

    ``duration``: (video_id, duration_s).  A merged segment's motion is averaged with the one
    before it, pair by pair, so the k-th last merged value weighs 2^-k.
    """
    from reelscope.operators.folds import block_fold

    base = motion.where("motion IS NOT NULL").select("video_id", "frame_idx", "motion")
    runs = block_fold(
        base, ["video_id"], ["frame_idx"], B.index_block("frame_idx", block), ["frame_idx", "motion"], _run_step(limit),
        "struct<run:bigint,n:bigint,total:double>", "run bigint", added=("n", "total"),
    )
    seg = runs.groupBy("video_id", "run").agg(F.count(F.lit(1)).alias("n"), F.avg("motion").alias("avg_motion"))
    seg = B.carried(seg, ["video_id"], ["run"], sums={"_upto": F.col("n")}, following={"_next": "run"})
    seg = seg.join(duration, "video_id")
    start = (F.col("_upto") - F.col("n")) * step_s
    end = F.when(F.col("_next").isNull(), F.col("duration_s")).otherwise(F.col("_upto") * step_s)
    seg = seg.withColumns({"start_s": start, "end_s": end})
    opens = F.when((F.col("end_s") - F.col("start_s") >= min_s) | (F.col("start_s") == 0), 1).otherwise(0)
    part = B.carried(seg, ["video_id"], ["run"], number="_rn", sums={"_part": opens})
    last = part.groupBy("video_id", "_part").agg(F.max("_rn").alias("_hi"), F.min("_rn").alias("_lo"))
    placed = part.join(last, ["video_id", "_part"])
    k = F.col("_hi") - F.col("_rn")
    weight = F.pow(F.lit(0.5), F.when(F.col("_rn") == F.col("_lo"), k).otherwise(k + 1).cast("double"))
    out = placed.groupBy("video_id", "_part").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum(F.col("avg_motion") * weight).alias("avg_motion")
    )
    level = F.when(F.col("avg_motion") > high, "high").when(F.col("avg_motion") > medium, "medium").otherwise("low")
    rate = S.lookup(F.col("motion_level"), {"high": 1.0, "medium": 0.85, "low": 0.6})
    return (
        out.withColumn("motion_level", level).withColumn("recommended_fps", S.clamp(fps * rate, 6.0, 20.0)).drop("_part")
    )


def _dedup_step(threshold: float):
    import numpy as np

    def step(state, row):
        hist = np.asarray(row[1], dtype=float)
        if state is not None:
            kept = np.asarray(state["hist"], dtype=float)
            if hist.sum() > 0 and kept.sum() > 0 and np.minimum(hist / hist.sum(), kept / kept.sum()).sum() >= threshold:
                return state["kept"], state
        return int(row[0]), {"kept": int(row[0]), "hist": hist.tolist()}

    return step


def dedup_frames(frames: DataFrame, threshold: float = 0.95, block: int = 1024) -> DataFrame:
    """Frames kept after dropping those close to the last kept one, with the summed display time.

    Needs video_id, frame_idx, hist (counts) and show_ms.
    """
    from reelscope.operators.folds import block_fold

    base = frames.select("video_id", "frame_idx", F.col("hist").cast("array<double>").alias("hist"), "show_ms")
    owned = block_fold(
        base, ["video_id"], ["frame_idx"], B.index_block("frame_idx", block), ["frame_idx", "hist"], _dedup_step(threshold),
        "struct<kept:bigint,hist:array<double>>", "kept_idx bigint", added=(),
    )
    return owned.groupBy("video_id", F.col("kept_idx").alias("frame_idx")).agg(
        F.sum("show_ms").alias("show_ms"), F.count(F.lit(1)).alias("frames")
    )


SAMPLE_RANK = {"complexity": 3, "scene": 2, "temporal": 1}


def _overlap_step(state, row):
    sid, start, end, rank = int(row[0]), float(row[1]), float(row[2]), int(row[3])
    if state is None or start >= state["end"]:
        return sid, {"slot": sid, "end": end, "rank": rank}
    if rank > state["rank"]:
        return state["slot"], {"slot": state["slot"], "end": end, "rank": rank}
    return None, state


def sample_overlap(samples: DataFrame, block_s: float = 600.0) -> DataFrame:
    """Non-overlapping samples in time order; an overlapping one replaces the last kept if its type ranks higher."""
    from reelscope.operators.folds import block_fold

    base = samples.withColumn("_rank", S.lookup(F.col("sample_type"), SAMPLE_RANK, 0))
    slots = block_fold(
        base, ["video_id"], ["start_s", "sample_id"], B.by_value("start_s", block_s), ["sample_id", "start_s", "end_s", "_rank"], _overlap_step,
        "struct<slot:bigint,end:double,rank:bigint>", "slot bigint", added=(), latest=("end", "rank"),
    )
    row = F.struct(*samples.columns)
    kept = slots.where("slot IS NOT NULL").groupBy("video_id", "slot").agg(F.max_by(row, F.struct("start_s", "sample_id")).alias("_r"))
    return kept.select("_r.*")
