"""Performance report: bottlenecks, recommendations, potential, and one nested report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from reelscope.functions import scalars as S
from reelscope.operators import aggregates as A, blocks as B

SLOW_S, POOR_SUCCESS, HIGH_MEMORY_MB, LOW_HIT = 30.0, 80.0, 500.0, 30.0
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
IMPACT_RANK = {"high": 0, "medium": 1, "low": 2}


def severity(value: Column, threshold: float, critical: float) -> Column:
    return F.when(value >= critical, "critical").when(value >= threshold * 2, "high").when(value >= threshold * 1.5, "medium").otherwise("low")


def bottlenecks(op_stats: DataFrame, lookups: DataFrame) -> DataFrame:
    """One row per broken rule. Inputs: ``aggregates.op_stats`` (a row per operation) and ``aggregates.lookup_stats`` (one row)."""
    c = F.col
    n, dur, ok, mem = c("n"), c("avg_duration"), c("success_rate"), c("avg_memory")
    rule = lambda test, kind, sev, metric, impact: F.when(
        test, F.struct(F.lit(kind).alias("kind"), sev.alias("severity"), metric.cast("double").alias("metric"), impact.alias("impact")))
    total = dur * n
    slow = rule(dur > SLOW_S, "slow_operation", severity(dur, SLOW_S, 120.0), dur,
                F.when(total > 600, "high").when(total > 180, "medium").otherwise("low"))
    fails = rule(ok < POOR_SUCCESS, "high_failure_rate", severity(100 - ok, 20, 50), ok,
                 F.when(ok < 50, "critical").when(ok < 70, "high").when(ok < 85, "medium").otherwise("low"))
    memory = rule(mem > HIGH_MEMORY_MB, "high_memory_usage", severity(mem, HIGH_MEMORY_MB, 1000.0), mem,
                  F.when((c("max_memory") > mem * 3) | (mem > 1000), "poor").when(mem > 500, "moderate").otherwise("good"))
    per_op = op_stats.where("n >= 3").select(
        "op_name", "n", (c("max_duration") / dur).alias("variability"), "max_memory", F.explode(F.array_compact(F.array(slow, fails, memory))).alias("_b")
    )
    ops = per_op.select("_b.kind", "op_name", "_b.severity", "_b.metric", "_b.impact", "n", "variability", "max_memory")
    hit = c("hit_rate")
    loss = F.greatest(F.lit(0.0), 80 - hit) / 80
    cache = lookups.where((hit < LOW_HIT) & (c("total_lookups") > 10)).select(
        F.lit("poor_cache_performance").alias("kind"), F.lit(None).cast("string").alias("op_name"),
        severity(LOW_HIT - hit, 10, 30).alias("severity"), hit.alias("metric"),
        F.when(loss > 0.5, "high").otherwise("medium").alias("impact"), c("total_lookups").alias("n"),
        F.lit(None).cast("double").alias("variability"), F.lit(None).cast("double").alias("max_memory"),
    )
    return ops.unionByName(cache)


def ranked(found: DataFrame) -> DataFrame:
    """Most severe first; a handful of rows (operations x rules)."""
    return found.orderBy(S.lookup(F.col("severity"), SEVERITY_RANK, 4), "kind", F.col("op_name").asc_nulls_last())


def cache_speedup(hit: Column) -> Column:
    """Relative run time now over run time at an 80 % hit rate."""
    now = (hit * 0.1 + (100 - hit) * 1.0) / 100
    return F.when(hit >= 80, 1.0).otherwise(now / 0.28)


def advice(found: DataFrame) -> DataFrame:
    """Recommendation codes per bottleneck, in rule order, with their expected impact."""
    c = F.col
    op, kind, metric, sev = F.lower(F.coalesce("op_name", F.lit(""))), c("kind"), c("metric"), c("severity")
    v = c("variability")
    has = lambda word: op.contains(word)
    code = lambda test, *names: F.when(F.coalesce(test, F.lit(False)), F.array(*[F.lit(x) for x in names])).otherwise(F.array().cast("array<string>"))
    slow, fails, memory, cache = (kind == k for k in ("slow_operation", "high_failure_rate", "high_memory_usage", "poor_cache_performance"))
    rules = F.concat(
        code(slow & has("quality"), "fast_quality_estimation", "quality_result_caching"), code(slow & has("quality") & (metric > 60), "evaluation_time_limits"),
        code(slow & has("compression"), "optimize_encoder_parameters", "hardware_acceleration"),
        code(slow & has("compression") & (v > 2), "investigate_compression_variability"),
        code(slow & has("cache"), "review_cache_implementation", "cache_size_optimization"),
        code(slow & (metric > 120), "split_into_parallel_tasks"), code(slow & (v > 3), "investigate_input_variability"),
        code(fails & (metric < 50), "immediate_investigation", "better_error_handling"),
        code(fails & has("quality"), "fallback_quality_estimation", "quality_input_validation"),
        code(fails & has("compression"), "parameter_validation_and_fallback", "progressive_quality_reduction"),
        code(fails, "retry_with_backoff", "input_validation_and_recovery"),
        code(memory & (metric > 1000), "memory_optimization", "process_in_chunks"), code(memory & (c("max_memory") > metric * 3), "investigate_memory_leaks"),
        code(memory & has("quality"), "reduce_quality_memory", "sampling_based_assessment"),
        code(memory, "memory_monitoring_and_cleanup", "memory_efficient_structures"),
        code(cache & (metric < 20), "review_cache_keys", "increase_cache_size"), code(cache & (metric >= 20) & (metric < 50), "cache_key_optimization"),
        code(cache & (c("n") > 100), "cache_performance_optimization"), code(cache, "cache_warming", "review_eviction_policy"),
    )
    out = found.select("kind", "op_name", "severity", F.posexplode(rules).alias("pos", "advice"))
    a = F.col("advice")
    impact = (
        F.when(a == "hardware_acceleration", "high").when((a == "evaluation_time_limits") & sev.isin("critical", "high"), "high")
        .when(a.contains("optimization") | a.contains("fallback"), "medium").otherwise("low")
    )
    return out.withColumn("expected_impact", impact)


def cache_notice(lookups: DataFrame, high: float = 80.0, low: float = 20.0, enough: int = 20) -> DataFrame:
    """At most one notice from the row of ``aggregates.lookup_stats``: very good use of the cache, or poor use over enough lookups."""
    rate = F.col("hit_rate")
    good, poor = rate > high, (rate < low) & (F.col("total_lookups") > enough)
    pick = lambda a, b: F.when(good, a).otherwise(b)
    return lookups.where(good | poor).select(
        pick("optimization_opportunity", "cache_optimization").alias("kind"), F.lit(None).cast("string").alias("op_name"),
        pick("low", "high").alias("severity"), F.lit(0).alias("pos"), pick("increase_cache_size", "review_cache_strategy").alias("advice"),
        pick("low", "high").alias("expected_impact"),
    )


def recommend(found: DataFrame, duration_trend: DataFrame | None = None, lookups: DataFrame | None = None) -> DataFrame:
    """Advice ordered by priority, then impact.

    ``duration_trend``: one row (direction, significance) adds a degradation notice; ``lookups``: one row (total_lookups,
    hit_rate) adds a notice on the use of the cache.
    """
    out = advice(found)
    if lookups is not None:
        out = out.unionByName(cache_notice(lookups))
    if duration_trend is not None:
        worse = (F.col("direction") == "increasing") & F.col("significance").isin("significant", "moderate")
        notice = duration_trend.where(worse).select(
            F.lit("performance_degradation").alias("kind"), F.lit(None).cast("string").alias("op_name"), F.lit("high").alias("severity"),
            F.lit(0).alias("pos"), F.lit("monitoring_alerts").alias("advice"), F.lit("high").alias("expected_impact"),
        )
        out = out.unionByName(notice)
    return out.orderBy(
        S.lookup(F.col("severity"), SEVERITY_RANK, 4), S.lookup(F.col("expected_impact"), IMPACT_RANK, 3), "kind", F.col("op_name").asc_nulls_last(), "pos"
    )


def potential(found: DataFrame) -> DataFrame:
    """One row: speed-up factor (at most 3), reliability and memory gains, category."""
    c = F.col
    kind, m = c("kind"), c("metric")
    factor = (
        F.when((kind == "slow_operation") & (m > 60), 1.5).when((kind == "slow_operation") & (m > 30), 1.3)
        .when((kind == "poor_cache_performance") & (m < 30), 2.0).when((kind == "poor_cache_performance") & (m < 60), 1.5)
    )
    gain = F.when(kind == "high_failure_rate", F.greatest(F.lit(0.0), F.least(95 - m, F.lit(50.0))))
    saved = F.when(kind == "high_memory_usage", F.least(m * 0.5, F.lit(500.0)))
    out = found.agg(
        F.coalesce(F.exp(F.sum(F.ln(factor))), F.lit(1.0)).alias("_s"), F.coalesce(F.max(gain), F.lit(0.0)).alias("reliability_gain"),
        F.coalesce(F.max(saved), F.lit(0.0)).alias("memory_saved_mb"), F.count(F.lit(1)).alias("bottlenecks"),
        F.count_if(c("severity") == "critical").alias("critical"),
    )
    s, r, mem = c("_s"), c("reliability_gain"), c("memory_saved_mb")
    level = (
        F.when((s > 2) | (r > 30) | (mem > 300), "high").when((s > 1.5) | (r > 15) | (mem > 150), "medium")
        .when((s > 1.2) | (r > 5) | (mem > 50), "low").otherwise("minimal")
    )
    return out.withColumns({"speedup": F.least(s, F.lit(3.0)), "overall": level}).drop("_s")


def concerns(found: DataFrame) -> DataFrame:
    """One row: primary concern codes."""
    k = F.col("kind")
    agg = found.agg(
        F.count_if(F.col("severity") == "critical").alias("crit"), F.count_if(k == "slow_operation").alias("slow"),
        F.count_if(k == "high_failure_rate").alias("fail"), F.count_if(k == "poor_cache_performance").alias("cache"),
    )
    told = F.array_compact(F.array(
        F.when(F.col("crit") > 0, "critical_issues"), F.when(F.col("slow") > 2, "multiple_slow_operations"),
        F.when(F.col("fail") > 0, "reliability_issues"), F.when(F.col("cache") > 0, "cache_optimization_needed"),
    ))
    return agg.select(F.when(F.size(told) > 0, told).otherwise(F.array(F.lit("no_major_concerns"))).alias("concerns"))


def build_report(sessions: DataFrame, ops: DataFrame, lookups: DataFrame, now: Column, days: int | None = None) -> DataFrame:
    """One nested row: summary, trends, bottlenecks, recommendations, potential.

    Everything nested is small by construction (a row per day, platform, operation or rule); each
    part is aggregated on its own and attached as a scalar.  ``days``: one period for all parts (lookups then
    need ts); everything by default.
    """
    recent, logged = sessions, ops
    if days is not None:
        since = now - F.make_dt_interval(days=F.lit(days))
        recent, logged, lookups = sessions.where(F.col("start_ts") >= since), ops.where(F.col("ts") >= since), lookups.where(F.col("ts") >= since)
    good = recent.where(F.col("success"))
    trend = A.trend_significance(recent)
    found = bottlenecks(A.op_stats(logged), A.lookup_stats(lookups))
    one = lambda df: df.select(F.struct(*df.columns)).scalar()
    many = lambda df: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns)))).scalar()
    head = recent.sparkSession.range(1).select(now.alias("report_ts"), F.lit(days).cast("int").alias("period_days"))
    return head.withColumns({
        "summary": one(A.session_summary(recent)), "duration_trend": one(trend),
        "daily": many(A.daily_stats(good)), "platforms": many(A.platform_stats(good)), "operation_trends": many(A.op_trends(logged)),
        "bottlenecks": many(found.select("severity", "kind", "op_name", "metric", "impact")),
        "recommendations": many(advice(found)), "potential": one(potential(found)), "concerns": concerns(found).scalar(),
    })


def report_rows(report: DataFrame, items: dict[str, tuple[str, ...]]) -> DataFrame:
    """The numbers of a report as rows: report_ts, section, item, metric, value (null numbers have no row).

    ``items``: the sections wanted, each with the fields that name an item (none for a section that is one struct); they are
    joined by ``/``.  Fields that are neither numbers nor booleans name nothing and are left out.
    """
    parts = None
    for section, names in items.items():
        kind = report.schema[section].dataType
        rows = report.select("report_ts", F.explode(section).alias("r") if isinstance(kind, T.ArrayType) else F.col(section).alias("r"))
        fields = kind.elementType.fields if isinstance(kind, T.ArrayType) else kind.fields
        numbers = [f.name for f in fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col("r")[n].cast("double").alias("value")) for n in numbers])
        item = F.concat_ws("/", *[F.col("r")[n].cast("string") for n in names]) if names else F.lit(None).cast("string")
        flat = rows.select("report_ts", F.lit(section).alias("section"), item.alias("item"), F.explode(pairs).alias("p")).select("report_ts", "section", "item", "p.metric", "p.value")
        parts = flat if parts is None else parts.unionByName(flat)
    return parts.where(F.col("value").isNotNull())


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").json(path)


__all__ = [n for n in dir() if not n.startswith("_")] + ["B"]
