"""Quality prediction from video features, from asset characteristics, and from similar results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from reelscope.functions import scalars as S
from reelscope.operators import joins as J
from reelscope.operators.frames import spread_confidence

# Fixed model coefficients.
VMAF_MODEL = {
    "intercept": 45.0, "blur": 35.0, "noise": 25.0, "complexity": 8.0, "stability": 12.0, "laplacian": 15.0,
    "snr": 20.0, "edge": 10.0, "blur_noise": 15.0, "complexity_stability": 5.0,
}
SSIM_MODEL = {
    "intercept": 0.75, "blur": 0.15, "noise": 0.12, "texture": 0.08, "gradient": 0.06, "stability": 0.10,
    "fft": 0.08, "structure": 0.05, "luminance": 0.04,
}
FEATURE_WEIGHTS = {"blur": 0.35, "noise": 0.25, "complexity": 0.20, "motion": 0.15, "meta": 0.05}
VMAF_TRAITS = {
    "baseline": 75.0, "resolution": 0.015, "bitrate": 0.008, "complexity": -15.0, "motion": -10.0, "fps": 0.1,
    "codec": 5.0, "duration": -0.05,
}
SSIM_TRAITS = {
    "baseline": 0.92, "resolution": 0.00008, "bitrate": 0.000005, "complexity": -0.08, "motion": -0.05, "fps": 0.0005,
    "codec": 0.02, "duration": -0.0001,
}
SKIP_CONFIDENCE = 0.8


def unit(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def total(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0])


def skip(conf: Column, vmaf: Column, ssim: Column, threshold: float) -> Column:
    return F.coalesce((conf >= threshold) & (vmaf >= 75.0) & (ssim >= 0.90), F.lit(False))


def confidence_level(conf: Column) -> Column:
    return F.when(conf >= 0.8, "very_high").when(conf >= 0.7, "high").when(conf >= 0.5, "medium").otherwise("low")


#: Features that ``predict_stat`` reads.
STAT_FEATURES = (
    "blur_score", "noise_score", "complexity_score", "motion_score", "temporal_stability", "laplacian_var", "fft_score", "noise_var",
    "snr_db", "edge_density", "texture", "gradient_magnitude",
)


def predict_stat(f: DataFrame, threshold: float = SKIP_CONFIDENCE) -> DataFrame:
    """Statistical prediction from the columns of ``frames.video_features`` plus analysis_s (seconds spent).

    A feature that was not measured (null) counts as 0, so every row gets a prediction.
    """
    c = F.col
    f = f.withColumns({n: F.coalesce(c(n), F.lit(0.0)) for n in STAT_FEATURES})
    clean = 1 - c("noise_score")
    m, n = VMAF_MODEL, SSIM_MODEL
    vmaf = S.clamp(total([
        F.lit(m["intercept"]), c("blur_score") * m["blur"], clean * m["noise"], c("complexity_score") * m["complexity"],
        c("temporal_stability") * m["stability"], unit(c("laplacian_var") / 100) * m["laplacian"], unit(c("snr_db") / 40) * m["snr"],
        c("edge_density") * m["edge"], c("blur_score") * clean * m["blur_noise"],
        c("complexity_score") * c("temporal_stability") * m["complexity_stability"],
    ]), 0.0, 100.0)
    ssim = S.clamp(total([
        F.lit(n["intercept"]), c("blur_score") * n["blur"], clean * n["noise"], c("texture") * n["texture"],
        unit(c("gradient_magnitude") / 100) * n["gradient"], c("temporal_stability") * n["stability"], c("fft_score") * n["fft"],
        c("blur_score") * c("texture") * n["structure"], clean * c("temporal_stability") * n["luminance"],
    ]), 0.0, 1.0)
    out = f.withColumns({"pred_vmaf": vmaf, "pred_ssim": ssim})
    blur_even = spread_confidence(c("blur_score"), unit(c("laplacian_var") / 100), c("fft_score"))
    noise_even = spread_confidence(c("noise_score"), unit(c("noise_var") / 0.1), S.clamp(1 - c("snr_db") / 40, 0.0, 1.0))
    v = c("pred_vmaf")
    v_range = F.when(v.between(30, 80), 1.0).when(v.between(20, 90), 0.8).otherwise(0.6)
    s_range = F.when(c("pred_ssim") >= 0.85, 1.0).when(c("pred_ssim") >= 0.70, 0.8).otherwise(0.6)
    frames = unit(c("frames") / 10.0)
    v_conf = S.clamp(unit(c("blur_score") + 0.3) * 0.25 + clean * 0.25 + frames * 0.15 + v_range * 0.20 + (blur_even + noise_even) / 2 * 0.15, 0.0, 1.0)
    s_conf = S.clamp(
        (c("blur_score") + c("texture")) / 2 * 0.25 + clean * 0.25 + c("temporal_stability") * 0.20 + frames * 0.15 + s_range * 0.15, 0.0, 1.0)
    out = out.withColumns({"vmaf_conf": v_conf, "ssim_conf": s_conf})
    quality = (unit(c("frames") / 5.0) + c("temporal_stability") + 1 - F.abs(c("analysis_s") - 2.0) / 10) / 3
    out = out.withColumn("confidence", S.clamp((c("vmaf_conf") + c("ssim_conf")) / 2 * 0.7 + quality * 0.3, 0.0, 1.0))
    w = FEATURE_WEIGHTS
    boosted = {
        "blur": F.when(c("blur_score") > 0.7, w["blur"] * 1.2).otherwise(w["blur"]),
        "noise": F.when(c("noise_score") > 0.3, w["noise"] * 1.3).otherwise(w["noise"]),
        "complexity": F.lit(w["complexity"]),
        "motion": F.when(c("motion_score") > 0.5, w["motion"] * 1.1).otherwise(w["motion"]),
        "meta": F.lit(w["meta"]),
    }
    all_w = total(list(boosted.values()))
    risk = F.array_compact(F.array(
        F.when(c("complexity_score") > 0.7, "high_complexity_content"), F.when(c("motion_score") > 0.8, "high_motion_content"),
        F.when(c("blur_score") > 0.6, "high_blur"), F.when(c("noise_score") > 0.4, "high_noise"),
    ))
    cost = F.least(F.lit(300.0), F.least(F.lit(2.0), c("frames") / 100.0) * 30.0 * (c("complexity_score") * 0.5 + 1))
    return out.withColumns({
        **{f"importance_{k}": x / all_w for k, x in boosted.items()},
        "skip": skip(c("confidence"), c("pred_vmaf"), c("pred_ssim"), threshold), "risk_factors": risk, "eval_cost_s": cost,
        "confidence_level": confidence_level(c("confidence")),
    })


def from_traits(w: dict, top: float) -> Column:
    c = F.col
    px = S.pixels(c("width"), c("height"))
    score = total([
        F.lit(w["baseline"]), px / 1000000 * w["resolution"], F.coalesce(c("bitrate") / 1000000, F.lit(0.0)) * w["bitrate"],
        c("complexity") * w["complexity"], c("motion") * w["motion"], c("fps") * w["fps"],
        F.when(F.lower("codec").isin("hevc", "h265", "av1"), w["codec"]).otherwise(0.0),
        F.when(c("duration_s") > 300, c("duration_s") * w["duration"]).otherwise(0.0),
    ])
    return S.clamp(score, 0.0, top)


def predict_chars(assets: DataFrame) -> DataFrame:
    """Linear prediction from characteristics (complexity and motion on a 0-1 scale)."""
    return assets.withColumns({"pred_vmaf": from_traits(VMAF_TRAITS, 100.0), "pred_ssim": from_traits(SSIM_TRAITS, 1.0)})


def predict_decision(assets: DataFrame, history: DataFrame, threshold: float = SKIP_CONFIDENCE, newest: int = 100) -> DataFrame:
    """Prediction, confidence, skip decision, cost and risks per asset, using the bounded history.

    Needs width, height, fps, duration_s, bitrate, codec, complexity, motion, scene_changes.
    """
    c = F.col
    px = S.pixels(c("width"), c("height"))
    out = J.with_neighbour_count(predict_chars(assets).withColumn("pixels", px), history, newest=newest).drop("pixels")
    n = c("similar_results")
    parts = [
        F.when(px >= 1920 * 1080, 0.9).when(px >= 1280 * 720, 0.7).otherwise(0.5),
        F.when(F.coalesce(c("bitrate"), F.lit(0)) != 0, 0.8).otherwise(0.4),
        1.0 - c("complexity") * 0.5, 1.0 - c("motion") * 0.3,
        F.when(c("duration_s") < 60, 0.9).when(c("duration_s") < 300, 0.7).otherwise(0.5),
        F.when(n >= 3, 0.9).when(n >= 1, 0.6).otherwise(0.3),
    ]
    out = out.withColumn("confidence", total(parts) / 6)
    simple = (c("complexity") < 0.3) & (c("motion") < 0.4) & (c("duration_s") < 120)
    risk = F.array_compact(F.array(
        F.when(c("complexity") > 0.7, "high_complexity_content"), F.when(c("motion") > 0.8, "high_motion_content"),
        F.when(px > 3840 * 2160, "very_high_resolution"), F.when(c("duration_s") > 600, "very_long_duration"),
        F.when((c("bitrate") != 0) & (c("bitrate") < 500000), "very_low_bitrate"),
        F.when(c("scene_changes") > c("duration_s") / 3, "frequent_scene_changes"), F.when(c("codec") == "unknown", "unknown_codec"),
    ))
    cost = F.least(
        F.lit(300.0), F.least(F.lit(3.0), c("duration_s") / 60) * 30.0 * (px / (1920.0 * 1080.0)) * (c("complexity") * 0.5 + 1)
    )
    return out.withColumns({
        "confidence_level": confidence_level(c("confidence")),
        "skip": skip(c("confidence"), c("pred_vmaf"), c("pred_ssim"), threshold) & simple,
        "eval_cost_s": cost, "risk_factors": risk,
        "basis": F.when(n >= 3, "historical_data").when(n >= 1, "partial_historical_data").otherwise("heuristic_model"),
    })


def knn_quality(pairs: DataFrame, k: int = 5, least: int = 2, floor: float = 0.7) -> DataFrame:
    """Similarity-weighted scores from the k most similar results per asset.

    Pairs: asset_id, result_id, similarity, vmaf, ssim, psnr.  Each metric is averaged over the rows
    that have it, weighted by those rows' own similarity.
    """
    near = pairs.where(F.col("similarity") >= floor)
    w = Window.partitionBy("asset_id").orderBy(F.col("similarity").desc(), "result_id")
    top = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    size = near.groupBy("asset_id").agg(F.count(F.lit(1)).alias("similar_results"))

    def weighted(m: str) -> Column:
        weight = F.when(F.col(m).isNotNull(), F.col("similarity"))
        return F.try_divide(F.sum(F.col(m) * weight), F.sum(weight)).alias(m)

    best = top.groupBy("asset_id").agg(*[weighted(m) for m in ("vmaf", "ssim", "psnr")], F.max("similarity").alias("_top"))
    out = best.join(size, "asset_id").where((F.col("similar_results") >= least) & (F.col("vmaf").isNotNull() | F.col("ssim").isNotNull()))
    conf = F.least(F.lit(0.9), F.col("similar_results") * 0.15 + F.col("_top") * 0.5)
    return out.withColumn("confidence", conf).drop("_top")
