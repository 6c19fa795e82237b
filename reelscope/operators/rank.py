"""Rankings, choices and set operations. Every ranking has a total order; top-1 uses mergeable aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from reelscope.functions import constants as K
from reelscope.operators import blocks as B

SIZE_STEP = 10.0


def with_objective(attempts: DataFrame, max_mb: float = 10.0, min_vmaf: float = 70.0) -> DataFrame:
    """Violation count, feasibility and objective of each attempt (quality, size_mb nullable)."""
    q, s = F.col("quality"), F.col("size_mb")
    over_size = F.coalesce(s > max_mb, F.lit(True)).cast("int")
    under_quality = F.coalesce(q < min_vmaf, F.lit(True)).cast("int")
    score = q - F.when(s > max_mb, (s - max_mb) * SIZE_STEP).otherwise(0.0) + F.when((s / max_mb).between(0.8, 1.0), 5.0).otherwise(0.0)
    return attempts.withColumns(
        {"violations": over_size + under_quality, "objective": score}
    ).withColumn("feasible", (F.col("violations") == 0) & q.isNotNull() & s.isNotNull())


def best_attempt(attempts: DataFrame, key: list[str], max_mb: float = 10.0, min_vmaf: float = 70.0) -> DataFrame:
    """Best feasible attempt per key by objective; without one, the attempt with fewest violations. Ties: earliest step."""
    scored = with_objective(attempts, max_mb, min_vmaf)
    order = F.struct(
        F.col("feasible"), F.when(F.col("feasible"), F.col("objective")).alias("o"), (-F.col("violations")).alias("v"), (-F.col("step")).alias("s")
    )
    cols = [c for c in scored.columns if c not in key]
    best = scored.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("_b"))
    return best.select(*key, "_b.*")


def fallback_attempt(attempts: DataFrame, key: list[str], max_mb: float = 10.0) -> DataFrame:
    """Best quality among attempts within the size limit, else the size nearest the limit."""
    q, s = F.col("quality"), F.col("size_mb")
    fits = F.coalesce(s <= max_mb, F.lit(False)) & q.isNotNull()
    order = F.struct(
        fits.alias("f"), F.when(fits, q).alias("q"), F.when(~fits, -F.abs(s - max_mb)).alias("d"), (-F.col("step")).alias("s")
    )
    cols = [c for c in attempts.columns if c not in key]
    best = attempts.where(s.isNotNull()).groupBy(*key).agg(F.max_by(F.struct(*cols, fits.alias("within_limit")), order).alias("_b"))
    return best.select(*key, "_b.*")


def keyframes(points: DataFrame, n: int) -> DataFrame:
    """Every (count // n)-th keyframe per video, n at most."""
    keys = points.where("is_keyframe")
    numbered = B.carried(keys, ["video_id"], ["ts_s", "point_id"], number="_rn")
    total = keys.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_n") / n))
    at = F.col("_rn") - 1
    out = numbered.join(total, "video_id").where((at % step == 0) & (at < step * n))
    return out.drop("_rn", "_n")


def top_per_video(points: DataFrame, by: Column, n: int) -> DataFrame:
    """n rows per video with the largest ``by``; Spark cuts to n per task before shuffling."""
    w = Window.partitionBy("video_id").orderBy(by.desc(), F.col("ts_s"), F.col("point_id"))
    return points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def critical_frames(points: DataFrame, n: int) -> DataFrame:
    """Keyframe, complexity and motion picks, the best per 0.1 s, then the first n by time."""
    third = n // 3
    cols = ["video_id", "point_id", "ts_s", "complexity"]
    picks = (
        keyframes(points, third).select(*cols[:3], F.lit(0.5).alias("complexity"))
        .unionByName(top_per_video(points, F.col("complexity"), third).select(*cols))
        .unionByName(top_per_video(points, F.col("motion"), third).select(*cols[:3], F.lit(0.4).alias("complexity")))
    )
    bins = picks.groupBy("video_id", F.floor(F.col("ts_s") * 10).alias("_bin")).agg(
        F.max_by(F.struct("point_id", "ts_s", "complexity"), F.struct("complexity", -F.col("ts_s"), -F.col("point_id"))).alias("_b")
    )
    one = bins.select("video_id", "_b.*")
    w = Window.partitionBy("video_id").orderBy("ts_s", "point_id")
    return one.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def top_failures(errors: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent categories with their latest message; ties by name."""
    agg = errors.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.max_by("message", "seq").alias("sample_message"))
    return agg.orderBy(F.col("n").desc(), "category").limit(k)


CORE_METRICS = (
    "cache_hits", "cache_misses", "retries", "segmentation_events", "guardrail_events", "timeout_events",
    "validation_failures", "summary_cleanups", "mp4_moves",
)


def top_metrics(counters: DataFrame, k: int = 5) -> DataFrame:
    core = F.col("counter").isin(*CORE_METRICS) | ~F.col("counter").contains("_")
    return counters.where(core).orderBy(F.col("total").desc(), "counter").limit(k)


SIGNATURE = ("bitrate", "crf", "preset", "encoder", "resolution_factor", "fps_factor")


def new_candidates(candidates: DataFrame, history: DataFrame, space: dict) -> DataFrame:
    """Valid candidates, one per signature, that are not in the history.

    ``space``: bitrate and crf as (low, high); presets, encoders, resolution_factors, fps_factors as tuples.
    """
    ok = F.col("bitrate").between(*space["bitrate"]) & (F.col("crf").isNull() | F.col("crf").between(*space["crf"]))
    for column, allowed in (("preset", space["presets"]), ("encoder", space["encoders"])):
        if allowed:
            ok = ok & F.col(column).isin(*allowed)
    ok = ok & F.col("resolution_factor").isin(*space["resolution_factors"]) & F.col("fps_factor").isin(*space["fps_factors"])
    fresh = candidates.where(ok).select(*SIGNATURE).distinct()
    seen = history.select(*[F.col(c).alias(f"_{c}") for c in SIGNATURE]).distinct()
    same = None
    for c in SIGNATURE:
        test = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = test if same is None else same & test
    return fresh.join(seen, same, "left_anti")


def dedup_summaries(files: DataFrame) -> DataFrame:
    """One summary per folder: the canonical name if present, else the newest. Needs folder, name, mtime."""
    from reelscope.functions import scalars as S

    canonical = F.col("name") == S.summary_name(F.col("folder"))
    kept = files.withColumn("is_canonical", canonical).groupBy("folder").agg(
        F.max_by(F.struct("name", "mtime"), F.struct("is_canonical", "mtime", "name")).alias("_k"), F.count(F.lit(1)).alias("found")
    )
    return kept.select("folder", F.col("_k.name").alias("kept_name"), F.col("_k.mtime").alias("kept_mtime"), "found",
                       S.summary_name(F.col("folder")).alias("canonical_name"))


def all_samples(*parts: DataFrame) -> DataFrame:
    """Type-tagged union of sample tables with equal columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_of(variants: list[DataFrame], key: list[str], score: str, speed: str | None = None) -> DataFrame:
    """Best row per key over several variants' results: score plus a bonus for short run time."""
    tagged = [v.withColumn("variant", F.lit(i)) for i, v in enumerate(variants)]
    union = all_samples(*tagged)
    bonus = F.greatest(F.lit(0.0), 10 - F.col(speed) / 60) * 0.1 if speed else F.lit(0.0)
    order = F.struct((F.col(score) + bonus).alias("s"), (-F.col("variant")).alias("v"))
    cols = [c for c in union.columns if c not in key]
    return union.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("_b")).select(*key, "_b.*")


__all__ = [n for n in dir() if not n.startswith("_")] + ["K"]
