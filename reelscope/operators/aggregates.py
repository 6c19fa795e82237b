"""Grouped and global statistics. All use mergeable aggregates, so hot keys combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelscope.functions import constants as K, scalars as S
from reelscope.operators import blocks as B


def share(test: Column, scale: float = 100.0) -> Column:
    """Percentage of rows passing ``test`` (0 for no rows)."""
    return F.coalesce(F.try_divide(F.count_if(test) * F.lit(scale), F.count(F.lit(1))), F.lit(0.0))


def op_stats(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op_name").agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("success")).alias("success_rate"),
        F.avg("duration").alias("avg_duration"), F.min("duration").alias("min_duration"),
        F.max("duration").alias("max_duration"), F.sum("duration").alias("total_duration"),
        F.avg("memory_delta").alias("avg_memory"), F.min("memory_delta").alias("min_memory"),
        F.max("memory_delta").alias("max_memory"),
    )


def size_use() -> Column:
    ok = (F.col("final_mb") != 0) & (F.col("target_mb") > 0)
    return F.when(ok, F.col("final_mb") / F.col("target_mb") * 100)


def session_summary(sessions: DataFrame) -> DataFrame:
    """One row: totals over all sessions; durations and size use over the successful ones."""
    good = F.col("success") & F.col("duration").isNotNull() & (F.col("duration") != 0)
    duration = F.when(good, F.col("duration"))
    use = F.when(F.col("success"), size_use())
    main = sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if("success").alias("successful_sessions"),
        share(F.col("success")).alias("success_rate"),
        F.avg(duration).alias("avg_duration"),
        F.coalesce(F.stddev_samp(duration), F.lit(0.0)).alias("std_duration"),
        F.min(duration).alias("min_duration"), F.max(duration).alias("max_duration"),
        F.avg(use).alias("avg_utilisation"), F.min(use).alias("min_utilisation"), F.max(use).alias("max_utilisation"),
    )
    median = B.exact_median(sessions.where(good), "duration")
    return main.withColumn("median_duration", median.select("median").scalar())


def daily_stats(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(F.to_date("start_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.avg(F.nullif("duration", F.lit(0.0))), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_time"),
        share(F.col("success")).alias("success_rate"),
    )


def platform_stats(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(F.coalesce("platform", F.lit("unknown")).alias("platform")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.avg(F.nullif("duration", F.lit(0.0))), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(F.avg(size_use()), F.lit(0.0)).alias("avg_utilisation"),
        share(F.col("success")).alias("success_rate"),
    )


def op_trends(ops: DataFrame, block_s: int = 60) -> DataFrame:
    """Per operation with at least three rows: slopes of duration and success over log order."""
    measures = {"duration": F.col("duration"), "success": F.col("success").cast("double")}
    out = B.trend(ops, ["op_name"], ["ts", "op_id"], B.time_block("ts", block_s), measures)
    return out.where("n >= 3").select(
        "op_name", "n", "avg_duration",
        F.col("slope_duration").alias("duration_slope"), B.direction(F.col("slope_duration")).alias("duration_trend"),
        (F.col("avg_success") * 100).alias("success_rate"),
        F.col("slope_success").alias("success_slope"), B.direction(F.col("slope_success")).alias("success_trend"),
    )


def trend_significance(sessions: DataFrame, group: list[str] | None = None, block_s: int = 3600) -> DataFrame:
    group = group or []
    good = sessions.where(F.col("success") & (F.coalesce("duration", F.lit(0.0)) != 0))
    t = B.trend(good, group, ["start_ts", "session_id"], B.time_block("start_ts", block_s), {"duration": F.col("duration")})
    return t.select(
        *group, "n", F.col("slope_duration").alias("slope"), B.direction(F.col("slope_duration")).alias("direction"),
        B.significance(F.col("slope_duration"), F.col("min_duration"), F.col("max_duration"), F.col("n")).alias("significance"),
    )


def lookup_stats(lookups: DataFrame) -> DataFrame:
    """One row over cache lookups with columns ``hit`` and ``response_s``."""
    return lookups.agg(
        F.count(F.lit(1)).alias("total_lookups"),
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        share(F.col("hit")).alias("hit_rate"), share(~F.col("hit")).alias("miss_rate"),
        F.coalesce(F.avg("response_s"), F.lit(0.0)).alias("avg_response_s"),
    )


def cache_stats(cache: DataFrame, lookups: DataFrame) -> DataFrame:
    main = cache.agg(
        F.count(F.lit(1)).alias("entries"),
        (F.coalesce(F.sum("data_size"), F.lit(0)) / S.MIB).alias("total_mb"),
        F.coalesce(F.avg("access_count"), F.lit(0.0)).alias("avg_access"),
    )
    looks = lookup_stats(lookups)
    row = looks.select(F.struct(*looks.columns)).scalar()
    return main.withColumn("_l", row).select("*", "_l.*").drop("_l")


def cache_age(cache: DataFrame, now: Column, created: str = "created_at") -> DataFrame:
    age = (F.unix_timestamp(now) - F.unix_timestamp(created)) / 3600.0
    return cache.select(age.alias("age_h")).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("age_h") < 1).alias("fresh_entries"), F.count_if(F.col("age_h") >= 1).alias("old_entries"),
        F.max("age_h").alias("oldest_age_h"), F.min("age_h").alias("newest_age_h"),
    )


def error_summary(errors: DataFrame) -> DataFrame:
    """Counts by category, by severity and in total; the total row names the commonest category."""
    small = errors.groupBy("category", "severity").agg(
        F.count(F.lit(1)).alias("c"), F.count_if("retryable").alias("r")
    )  # at most categories x severities rows
    level = F.when(F.col("category").isNotNull(), "category").when(F.col("severity").isNotNull(), "severity").otherwise("total")
    sets = small.groupingSets([["category"], ["severity"], []], "category", "severity").agg(
        F.sum("c").alias("n"), F.sum("r").alias("retryable"), (F.sum("c") - F.sum("r")).alias("non_retryable")
    )
    out = sets.select(level.alias("level"), F.coalesce("category", "severity", F.lit("all")).alias("key"), "n", "retryable", "non_retryable")
    by_cat = small.groupBy("category").agg(F.sum("c").alias("c"))
    top = by_cat.agg(F.min_by("category", F.struct(-F.col("c"), F.col("category"))).alias("t")).scalar()
    return out.withColumn("most_common", F.when(F.col("level") == "total", top))


def tracker(events: DataFrame) -> DataFrame:
    """Counters per metric and per metric and context; non-positive amounts do not count."""
    out = events.where("amount > 0").rollup("metric", "context").agg(F.sum("amount").alias("total"))
    return out.where("metric IS NOT NULL").select(
        F.when(F.col("context").isNull(), F.col("metric")).otherwise(F.concat_ws("_", "metric", "context")).alias("counter"),
        "total",
    )


def floor_severity(kbps: Column, minimum: Column) -> Column:
    deficit = minimum / F.greatest(kbps, F.lit(1))
    return F.when(kbps >= minimum, "info").when(deficit > 2.0, "critical").otherwise("warning")


def with_floor(df: DataFrame, minima: dict = K.ENCODER_MIN_KBPS, default: int = K.DEFAULT_ENCODER_MIN_KBPS) -> DataFrame:
    minimum = S.lookup(F.col("encoder"), minima, default)
    return df.withColumn("min_kbps", minimum).withColumn("severity", floor_severity(F.col("bitrate_kbps"), F.col("min_kbps")))


def floor_audit(df: DataFrame, minima: dict = K.ENCODER_MIN_KBPS) -> DataFrame:
    sev = F.col("severity")
    return with_floor(df, minima).groupBy("encoder").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sev == "info").alias("valid"),
        F.count_if(sev == "warning").alias("warnings"), F.count_if(sev == "critical").alias("criticals"),
        share(sev == "info").alias("success_rate"), F.bool_and(sev == "info").alias("all_valid"),
    )


def gate_confidence(vmaf, ssim, vmaf_conf, ssim_conf, method) -> Column:
    both = F.when(vmaf.isNotNull() & ssim.isNotNull(), (vmaf_conf + ssim_conf) / 2).when(
        vmaf.isNotNull(), vmaf_conf * 0.8).when(ssim.isNotNull(), ssim_conf * 0.6).otherwise(0.0)
    single = F.when(ssim.isNotNull(), ssim_conf * 0.9).otherwise(0.0)
    return F.when(method == "vmaf+ssim", both).when(method == "ssim_only", single).otherwise(0.0)


def with_gate_confidence(df: DataFrame) -> DataFrame:
    cols = [F.col(c) for c in ("vmaf", "ssim", "vmaf_conf", "ssim_conf", "method")]
    return df.withColumn("confidence", gate_confidence(*cols))


def prediction_mae(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Mean absolute error per metric over evaluated rows: pred_<m> against <m>, m in vmaf, ssim, time_s."""
    aggs = [F.count(F.lit(1)).alias("evaluations")]
    for m in ("vmaf", "ssim", "time_s"):
        gap = F.abs(F.col(f"pred_{m}") - F.col(m))
        aggs += [F.avg(gap).alias(f"{m}_mae"), F.count(gap).alias(f"{m}_n")]
    good = df.where("evaluated")
    return (good.groupBy(*group) if group else good.groupBy()).agg(*aggs)


def attempt_stats(attempts: DataFrame, max_attempts: int = 3, max_time: float = 300.0) -> DataFrame:
    ok = F.col("result") == "SUCCESS"
    n, spent = F.count(F.lit(1)), F.sum("duration")
    return attempts.groupBy("session_id").agg(
        n.alias("attempts"), F.count_if(ok).alias("successes"),
        F.count_if(F.col("result") == "FAILURE").alias("failures"), F.count_if(F.col("result") == "TIMEOUT").alias("timeouts"),
        spent.alias("total_time"),
        F.coalesce(F.avg(F.when(ok, F.col("duration"))), F.lit(0.0)).alias("avg_success_duration"),
        F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"),
        F.greatest(F.lit(0).cast("bigint"), max_attempts - n).alias("remaining_attempts"),
        F.greatest(F.lit(0.0), max_time - spent).alias("remaining_time"),
    )


def gradients(attempts: DataFrame, key: str = "job_id") -> DataFrame:
    """Correlation of bitrate with quality (0 when undefined) and with size (1 when undefined)."""

    def safe(measure: str, default: float) -> Column:
        rate = F.when(F.col(measure).isNotNull(), F.col("bitrate_kbps").cast("double"))
        value = F.when(F.col("bitrate_kbps").isNotNull(), F.col(measure))
        corr = F.try_divide(F.covar_pop(rate, value), F.stddev_pop(rate) * F.stddev_pop(value))
        return F.coalesce(corr, F.lit(default))

    return attempts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), safe("quality", 0.0).alias("quality_gradient"), safe("size_mb", 1.0).alias("size_gradient"),
    )


def batch_outcome(results: DataFrame) -> DataFrame:
    s = F.col("status")
    return results.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(s == "ok").alias("successful"),
        F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "failed").alias("failed"),
        share(s == "ok").alias("success_rate"), share(s == "failed").alias("failure_rate"),
    )


def session_enrich(sessions: DataFrame) -> DataFrame:
    """Hit rate over nested cache operations and final/target ratio, without exploding."""
    cache = F.filter("operations", lambda o: F.lower(o["op_name"]).contains("cache"))
    hits = F.filter(cache, lambda o: o["success"])
    ratio = F.when((F.col("final_mb") != 0) & (F.col("target_mb") != 0), F.col("final_mb") / F.col("target_mb"))
    return sessions.withColumns(
        {"cache_hit_rate": F.try_divide(F.size(hits).cast("double"), F.size(cache).cast("double")), "compression_ratio": ratio}
    )


def history_trend(metrics: DataFrame, order: list[str]) -> DataFrame:
    """One row over metric snapshots: avg/min/max per metric and whether the hit rate rose."""
    aggs = [
        f(c).alias(f"{n}_{c}")
        for c in ("hit_rate", "response_s", "cache_mb")
        for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))
    ]
    key = F.struct(*order)
    improved = F.max_by("hit_rate", key) > F.min_by("hit_rate", key)
    return metrics.agg(*aggs, F.when(improved, "improving").otherwise("declining").alias("trend"))


def _segment_index() -> Column:
    return F.regexp_extract("name", r"_segment_(\d+)\.gif$", 1).try_cast("bigint")


def folder_validity(segments: DataFrame) -> DataFrame:
    """Per segment folder (columns folder, name, valid): completeness and usability.

    Indices are made distinct in a first, mergeable step, so a folder is never gathered whole.
    """
    gifs = segments.where(F.lower("name").endswith(".gif")).withColumn("idx", _segment_index())
    per_index = gifs.groupBy("folder", "idx").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("ok"))
    agg = per_index.groupBy("folder").agg(
        F.sum("n").alias("gifs"), F.sum("ok").alias("ok"), F.max("idx").alias("expected"), F.count_if(F.col("idx") >= 1).alias("present")
    )
    short = F.coalesce(F.col("gifs") < F.col("expected"), F.lit(False))
    return agg.select(
        "folder", "gifs",
        F.when(short, 0).otherwise(F.col("ok")).alias("valid_gifs"),
        F.when(short, F.col("gifs")).otherwise(F.col("gifs") - F.col("ok")).alias("invalid_gifs"),
        F.when(short, F.col("expected") - F.col("present")).otherwise(0).alias("missing"),
        (~short & (F.col("ok") > 0)).alias("usable"),
    )


def missing_segments(segments: DataFrame) -> DataFrame:
    """The missing indices of incomplete folders as rows (folder, segment_no)."""
    gifs = segments.where(F.lower("name").endswith(".gif")).withColumn("idx", _segment_index())
    short = folder_validity(segments).where("missing > 0").select("folder")
    present = gifs.where("idx >= 1").select("folder", "idx").distinct().join(short, "folder", "left_semi")
    gaps = B.carried(present, ["folder"], ["idx"], previous={"_p": "idx"})
    before = F.coalesce("_p", F.lit(0))
    hole = gaps.where(F.col("idx") - before > 1)
    return hole.select("folder", F.explode(F.sequence(before + 1, F.col("idx") - 1)).alias("segment_no"))


def scene_stats(scenes: DataFrame) -> DataFrame:
    """Per video: scene count, mean scene length, critical scenes, spatial complexity spread."""
    return scenes.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("scenes"), F.avg(F.col("end_s") - F.col("start_s")).alias("avg_scene_s"),
        F.count_if("is_critical").alias("critical"), F.avg("spatial").alias("avg_spatial"), F.max("spatial").alias("max_spatial"),
        F.var_pop("spatial").alias("var_spatial"),
    )


def critical_regions(scenes: DataFrame) -> DataFrame:
    """The critical scenes as rows (kept as rows: a long video may have very many)."""
    return scenes.where("is_critical").select("video_id", "start_s", "end_s")
