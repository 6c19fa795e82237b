"""Route evaluation requests: cached, limited, over budget, predictable, risky, or really evaluate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelscope.functions import scalars as S

BUDGETS = {"vmaf": 180.0, "ssim": 90.0, "combined": 300.0}


def limit_reason(disabled: Column, attempts: Column, streak: Column, spent: Column, recent: Column,
                 max_attempts=3, skip_after=2, max_time=300.0, max_recent=2) -> Column:
    """Why a session may not evaluate again (null when it may)."""
    return (
        F.when(disabled, "expensive_evaluations_disabled").when(attempts >= max_attempts, "max_attempts_reached")
        .when(streak >= skip_after, "consecutive_failures").when(spent >= max_time, "time_budget_exceeded")
        .when(recent >= max_recent, "recent_failures")
    )


def limiter_state(runs: DataFrame, skip_after: int = 2) -> DataFrame:
    """Latest state per session from ``windows.failure_runs``; a session that ever failed twice in a row stays disabled."""
    last = F.max_by(F.struct("attempt_no", "consecutive_failures", "total_time", "recent_failures"), F.struct("attempt_no"))
    agg = runs.groupBy("session_id").agg(last.alias("_l"), F.bool_or(F.col("consecutive_failures") >= skip_after).alias("disabled"))
    return agg.select("session_id", "disabled", "_l.*")


def eval_timeout(kind: Column, spent: Column, base: float = 120.0, max_time: float = 300.0) -> Column:
    per = F.when(kind == "vmaf", min(base * 1.5, 180.0)).when(kind == "ssim", min(base * 0.8, 90.0)).otherwise(base)
    return F.least(per, F.greatest(F.lit(30.0), max_time - spent))


def vmaf_timeout(duration: Column, height: Column, least: int = 300) -> Column:
    factor = F.when(height >= 1080, 2.0).when(height >= 720, 1.5).when(height >= 480, 1.2).otherwise(1.0)
    return F.greatest(F.lit(least).cast("bigint"), F.least(S.whole(duration * 2.5 * factor), F.lit(least * 3).cast("bigint")))


def route_evals(requests: DataFrame, state: DataFrame, predictions: DataFrame, vmaf_min: float = 80.0, ssim_min: float = 0.94,
                total_budget: float = 300.0) -> DataFrame:
    """Requests: request_id, session_id, asset_id, duration_s, height.

    State: ``limiter_state``.  Predictions: asset_id, pred_vmaf, pred_ssim, confidence, skip, eval_cost_s, risk_factors.
    """
    c = F.col
    j = requests.join(state, "session_id", "left").join(predictions, "asset_id", "left")
    zero = lambda n: F.coalesce(c(n), F.lit(0))
    limited = limit_reason(F.coalesce("disabled", F.lit(False)), zero("attempt_no"), zero("consecutive_failures"), zero("total_time"), zero("recent_failures"))
    left = total_budget - F.coalesce("total_time", F.lit(0.0))
    predicted = F.coalesce("skip", F.lit(False))
    out = j.withColumn("reason", F.coalesce(
        F.when(limited.isNotNull(), F.concat(F.lit("frequency_limit_"), limited)), F.when(left <= 0, "time_budget_exceeded"),
        F.when(left < 30, "insufficient_time_budget"), F.when(predicted, "prediction_skip"),
        F.when(F.size("risk_factors") >= 3, "high_risk_prediction"),
    ))
    method = F.when((c("confidence") > 0.8) & (c("eval_cost_s") > 120), "ssim_only").otherwise("combined")
    from_pred = c("reason").isin("prediction_skip", "high_risk_prediction")
    return out.withColumns({
        "method": F.when(from_pred, "prediction").when(c("reason").isNotNull(), "skipped").otherwise(method),
        "timeout_s": F.when(c("reason").isNull(), vmaf_timeout(c("duration_s"), c("height"))),
        "passes": F.when(from_pred, S.at_least(c("pred_vmaf"), vmaf_min) & S.at_least(c("pred_ssim"), ssim_min)),
    }).select("request_id", "session_id", "asset_id", "reason", "method", "timeout_s", "passes")
