"""Queries for catalogue analyses and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.functions import scalars as S
from reelscope.operators import aggregates as A, windows as W
from reelscope.plans import content as C, gates as Q, ladders as L, planning as P, predict as PR, reports as R, router as RT
from reelscope.registry.aggregates import LOOKUP_STATS, LOOKUPS, OP_STATS, SESSION_SUMMARY, lookups
from reelscope.registry.base import query
from reelscope.registry.joins import HISTORY, NEIGHBOURS, history
from reelscope.registry.scalars import LEVEL, MIB
from reelscope.registry.sqlviews import _pick, _q
from reelscope.registry.windows import RUNS
from reelscope.sources import views as V
from reelscope.sources.views import pick

# ------------------------------------------------------------------ ladders


def spread_assets(spark, sf):
    return V.spread(content_assets(spark, sf), "asset_id")


def content_assets(spark, sf):
    return V.v_assets(spark, sf).withColumns({
        "spatial": F.col("complexity"), "noise": (F.col("asset_id") % 9).cast("double"), "stability": (F.col("asset_id") % 7 + 3).cast("double"),
        "scene_count": F.col("asset_id") % 60,
    })


CONTENT = "SELECT *, complexity AS spatial, CAST(asset_id % 9 AS DOUBLE) AS noise, CAST(asset_id % 7 + 3 AS DOUBLE) AS stability, asset_id % 60 AS scene_count FROM v_assets"
OPTIONS = """SELECT *, quality / greatest(est_mb, 0.1e0) AS efficiency FROM (
  SELECT *, greatest(0.0e0, least(1.0e0, least(video_kbps * 1000.0e0 / (opt_w * opt_h * 30) / 0.03e0, 1.0e0) * pq * CASE content_type WHEN 'animation' THEN 1.1e0 WHEN 'screen_recording' THEN 1.2e0 WHEN 'gaming' THEN 0.95e0 WHEN 'mixed' THEN 0.98e0 ELSE 1.0e0 END - (motion + spatial) / 20 * 0.2e0)) AS quality,
    (video_kbps + audio_kbps_out) * duration_s / 8192 AS est_mb
  FROM (SELECT *, CAST(trunc(total - audio_kbps_out) AS BIGINT) AS video_kbps FROM (
    SELECT *, least(128, greatest(32, CAST(floor(total * 0.1e0) AS BIGINT))) AS audio_kbps_out FROM (
      SELECT *, opt_w * opt_h * 30 * CASE content_type WHEN 'animation' THEN 0.012e0 WHEN 'screen_recording' THEN 0.006e0 WHEN 'gaming' THEN 0.016e0 WHEN 'mixed' THEN 0.018e0 ELSE 0.02e0 END * f / 1000 * ((motion + spatial) / 20 + 1) AS total FROM (
        SELECT a.*, s.i * 5 + t.i + 1 AS option_no, tier, res_name, preset, f, pq, CAST(coalesce(least(width, mw), width) AS BIGINT) AS opt_w, CAST(coalesce(least(height, mh), height) AS BIGINT) AS opt_h FROM content a
        CROSS JOIN (VALUES (0, 'Original', NULL, NULL), (1, '1080p', 1920, 1080), (2, '720p', 1280, 720), (3, '480p', 854, 480)) s(i, res_name, mw, mh)
        CROSS JOIN (VALUES (0, 'highest', 'veryslow', 1.4e0, 1.1e0), (1, 'high', 'slow', 1.2e0, 1.0e0), (2, 'balanced', 'medium', 1.0e0, 0.95e0), (3, 'fast', 'fast', 0.8e0, 0.9e0), (4, 'smallest', 'veryfast', 0.6e0, 0.8e0)) t(i, tier, preset, f, pq))))))
  WHERE est_mb <= target_mb * 1.5e0 OR tier = 'smallest'"""
LADDER = dict(content=CONTENT, opts=OPTIONS)
COLS = "asset_id, option_no, tier, res_name, opt_w, opt_h, preset, video_kbps, audio_kbps_out, est_mb, quality, efficiency"
TOP = """SELECT *, best_q - quality AS quality_loss, est_mb - small AS size_over_smallest FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY efficiency DESC, option_no) AS rank,
   max(quality) OVER (PARTITION BY asset_id) AS best_q, min(est_mb) OVER (PARTITION BY asset_id) AS small FROM opts) WHERE rank <= 8"""


def micro(df, *cols):
    """Cut to six decimals: sizes are dyadic, so rounding them would hit exact halves."""
    return df.withColumns({c: F.floor(F.col(c) * 1e6) / 1e6 for c in cols})


def _cut(c):
    return f"floor({c} * 1000000.0e0) / 1000000.0e0 AS {c}"


@query("ladder", f"SELECT * REPLACE ({_cut('est_mb')}) FROM (SELECT {COLS} FROM opts)", "v_assets", "quality efficiency", 9, **LADDER)
def _(spark, sf):
    return micro(L.ladder(spread_assets(spark, sf)), "est_mb")


@query("ladder_top8", f"SELECT * REPLACE ({_cut('est_mb')}, {_cut('size_over_smallest')}) FROM (SELECT {COLS}, rank, quality_loss, size_over_smallest FROM top)", "v_assets",
       "quality efficiency quality_loss", 9, **LADDER, top=TOP)
def _(spark, sf):
    return micro(L.ladder_top(content_assets(spark, sf)), "est_mb", "size_over_smallest").withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "pick_option",
    """SELECT 'maximize_quality' AS strategy, asset_id, option_no FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY est_mb <= target_mb * 1.2e0 DESC, quality DESC, rank) AS r FROM top) WHERE r = 1
    UNION ALL SELECT 'minimize_size', asset_id, option_no FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY est_mb, rank) AS r FROM top) WHERE r = 1
    UNION ALL SELECT 'balanced', asset_id, option_no FROM top WHERE rank = 1""",
    "v_assets", **LADDER, top=TOP,
)
def _(spark, sf):
    found = L.picks(spread_assets(spark, sf), ("maximize_quality", "minimize_size", "balanced"))
    return found.select("strategy", "asset_id", "option_no")


def _when(test, code):
    return f"CASE WHEN {test} THEN '{code}' END"


def _codes(*items):
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


TIER = lambda m: "CASE tier " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"


@query(
    "ladder_quality",
    f"""SELECT asset_id, option_no, CASE WHEN quality >= 0.9e0 THEN 'excellent' WHEN quality >= 0.75e0 THEN 'good' WHEN quality >= 0.6e0 THEN 'acceptable' WHEN quality >= 0.4e0 THEN 'poor' ELSE 'unacceptable' END AS level,
      {_codes(_when('est_mb / target_mb <= 0.8e0', 'well_under_limit'), _when('est_mb / target_mb > 0.8e0 AND est_mb / target_mb <= 1', 'meets_target'), _when('quality >= 0.9e0', 'excellent_quality'), _when('quality >= 0.75e0 AND quality < 0.9e0', 'good_quality'), _when('quality >= 0.6e0 AND quality < 0.75e0', 'acceptable_quality'),
        TIER({'highest': 'maximum_quality', 'high': 'high_quality_reasonable_time', 'balanced': 'good_balance', 'fast': 'fast_encoding', 'smallest': 'smallest_file'}), "CASE res_name WHEN 'Original' THEN 'original_resolution' WHEN '1080p' THEN 'high_definition' WHEN '720p' THEN 'widely_compatible' ELSE 'very_small_file' END")} AS pros,
      {_codes(_when('est_mb / target_mb > 1', 'exceeds_limit'), _when('quality < 0.6e0', 'quality_reduced'), TIER({'highest': 'very_slow', 'fast': 'quality_for_speed', 'smallest': 'significant_quality_reduction'}), _when("res_name = '480p'", 'less_detail'))} AS cons
    FROM opts""",
    "v_assets", **LADDER,
)
def _(spark, sf):
    a = spread_assets(spark, sf)
    opts = L.option_rows(a, "asset_id", "target_mb", "content_type")
    return L.with_recommendations(L.with_pros_cons(opts)).select("asset_id", "option_no", "level", "pros", "cons")


@query(
    "tradeoff_assess",
    f"""SELECT asset_id, size_severity, feasibility, challenge,
      {_codes(_when('size_severity > 0.8e0', 'size_very_tight'), _when('size_severity > 0.6e0 AND size_severity <= 0.8e0', 'size_challenging'), _when('feasibility < 0.4e0', 'hard_to_compress'), _when('feasibility >= 0.4e0 AND feasibility < 0.6e0', 'quality_limited'))} AS warnings,
      {_codes(_when("content_type = 'live_action' AND noise > 6", 'denoise_source'), _when('motion > 8', 'reduce_frame_rate'), _when('scene_count > 30', 'split_into_segments'))} AS suggestions,
      {_codes(_when("duration_s > 300 AND size_severity > 0.7e0", 'video_segmentation'), _when('noise > 6', 'preprocessing'), _when('size_severity > 0.6e0 AND spatial > 7', 'two_pass_encoding'), _when("content_type IN ('animation', 'screen_recording')", 'format_change'), _when('size_severity > 0.8e0', 'target_adjustment'))} AS alternatives
    FROM (SELECT *, CASE WHEN have >= need THEN 0.0e0 ELSE greatest(0.0e0, least(1.0e0, 1 - have / need)) END AS size_severity,
      greatest(0.0e0, least(1.0e0, CASE content_type WHEN 'animation' THEN 0.9e0 WHEN 'screen_recording' THEN 0.95e0 WHEN 'live_action' THEN 0.6e0 WHEN 'gaming' THEN 0.7e0 ELSE 0.65e0 END - (motion + spatial) / 20 * 0.3e0 - noise / 10 * 0.2e0 + stability / 10 * 0.2e0)) AS feasibility,
      greatest(0.0e0, least(1.0e0, motion / 10 * 0.3e0 + spatial / 10 * 0.3e0 + noise / 10 * 0.2e0 + least(scene_count / 50, 1.0e0) * 0.2e0)) AS challenge
      FROM (SELECT *, width * height * 30 * (CASE content_type WHEN 'animation' THEN 0.015e0 WHEN 'screen_recording' THEN 0.008e0 WHEN 'live_action' THEN 0.025e0 WHEN 'gaming' THEN 0.02e0 ELSE 0.022e0 END * ((motion + spatial) / 20 + 1)) / 1000 AS need, target_mb * 8 * 1048576 / (duration_s * 1000) AS have
        FROM (SELECT * REPLACE (duration_s * (1 + asset_id % 4) AS duration_s) FROM content)))""",
    "v_assets", "size_severity feasibility challenge", content=CONTENT,
)
def _(spark, sf):
    a = content_assets(spark, sf).withColumn("duration_s", F.col("duration_s") * (F.col("asset_id") % 4 + 1))
    return L.tradeoff(a).select("asset_id", "size_severity", "feasibility", "challenge", "warnings", "suggestions", "alternatives")


@query(
    "profile_rollup",
    """SELECT codec, count(*) AS assets, count(*) FILTER (best >= 0.9e0) / count(*) AS excellent_share, count(*) FILTER (best >= 0.75e0 AND best < 0.9e0) / count(*) AS good_share, count(*) FILTER (best >= 0.6e0 AND best < 0.75e0) / count(*) AS acceptable_share,
      count(*) FILTER (best >= 0.4e0 AND best < 0.6e0) / count(*) AS poor_share, count(*) FILTER (best < 0.4e0) / count(*) AS unacceptable_share, count(*) FILTER (feasible) / count(*) AS feasible_share
    FROM (SELECT asset_id, codec, max(quality) AS best, bool_or(est_mb <= target_mb) AS feasible FROM opts GROUP BY asset_id, codec) GROUP BY codec""",
    "v_assets", "excellent_share good_share acceptable_share poor_share unacceptable_share feasible_share", **LADDER,
)
def _(spark, sf):
    return L.ladder_rollup(content_assets(spark, sf), "codec")


# ------------------------------------------------------------------ prediction

UNIT = lambda x: f"least(1.0e0, {x})"
FEATS = """SELECT job_id, step, coalesce(vmaf, 0) AS laplacian_var, tax AS fft_score, tax / 2 AS noise_var, coalesce(vmaf / 3, 0) AS snr_db, tax / 3 AS edge_density, tax * 5 AS texture, size_mb * 3 AS gradient_magnitude,
  coalesce((vmaf - 50) / 50, 0) AS blur_score, tax * 8 AS noise_score, size_mb / 21 AS complexity_score, ssim - 0.4e0 AS motion_score, 1.4e0 - ssim AS temporal_stability, crf - 12 AS frames, crf / 8 AS analysis_s FROM v_encodes"""
SD = lambda *p: "sqrt((" + " + ".join(f"pow({x} - ({' + '.join(p)}) / {len(p)}, 2)" for x in p) + f") / {len(p)})"
BLUR3 = ("blur_score", "least(1.0e0, laplacian_var / 100)", "fft_score")
NOISE3 = ("noise_score", "least(1.0e0, noise_var / 0.1e0)", "greatest(0.0e0, least(1.0e0, 1 - snr_db / 40))")
CL = lambda x, hi: f"greatest(0.0e0, least({hi}, {x}))"


@query(
    "predict_statistical",
    f"""SELECT job_id, step, pred_vmaf, pred_ssim, vmaf_conf, ssim_conf, confidence, confidence >= 0.8e0 AND pred_vmaf >= 75 AND pred_ssim >= 0.9e0 AS skip, ib / (ib + iz + 0.2e0 + im + 0.05e0) AS importance_blur,
      {_codes(_when('complexity_score > 0.7e0', 'high_complexity_content'), _when('motion_score > 0.8e0', 'high_motion_content'), _when('blur_score > 0.6e0', 'high_blur'), _when('noise_score > 0.4e0', 'high_noise'))} AS risk_factors
    FROM (SELECT *, {CL("(vmaf_conf + ssim_conf) / 2 * 0.7e0 + (least(1.0e0, frames / 5) + temporal_stability + 1 - abs(analysis_s - 2) / 10) / 3 * 0.3e0", '1.0e0')} AS confidence,
      CASE WHEN blur_score > 0.7e0 THEN 0.42e0 ELSE 0.35e0 END AS ib, CASE WHEN noise_score > 0.3e0 THEN 0.325e0 ELSE 0.25e0 END AS iz, CASE WHEN motion_score > 0.5e0 THEN 0.165e0 ELSE 0.15e0 END AS im
      FROM (SELECT *, {CL(f"least(1.0e0, blur_score + 0.3e0) * 0.25e0 + (1 - noise_score) * 0.25e0 + least(1.0e0, frames / 10) * 0.15e0 + CASE WHEN pred_vmaf BETWEEN 30 AND 80 THEN 1.0e0 WHEN pred_vmaf BETWEEN 20 AND 90 THEN 0.8e0 ELSE 0.6e0 END * 0.2e0 + (greatest(0.0e0, least(1.0e0, 1 - {SD(*BLUR3)})) + greatest(0.0e0, least(1.0e0, 1 - {SD(*NOISE3)}))) / 2 * 0.15e0", '1.0e0')} AS vmaf_conf,
        {CL("(blur_score + texture) / 2 * 0.25e0 + (1 - noise_score) * 0.25e0 + temporal_stability * 0.2e0 + least(1.0e0, frames / 10) * 0.15e0 + CASE WHEN pred_ssim >= 0.85e0 THEN 1.0e0 WHEN pred_ssim >= 0.7e0 THEN 0.8e0 ELSE 0.6e0 END * 0.15e0", '1.0e0')} AS ssim_conf
        FROM (SELECT *, {CL("45 + blur_score * 35 + (1 - noise_score) * 25 + complexity_score * 8 + temporal_stability * 12 + least(1.0e0, laplacian_var / 100) * 15 + least(1.0e0, snr_db / 40) * 20 + edge_density * 10 + blur_score * (1 - noise_score) * 15 + complexity_score * temporal_stability * 5", '100.0e0')} AS pred_vmaf,
          {CL("0.75e0 + blur_score * 0.15e0 + (1 - noise_score) * 0.12e0 + texture * 0.08e0 + least(1.0e0, gradient_magnitude / 100) * 0.06e0 + temporal_stability * 0.1e0 + fft_score * 0.08e0 + blur_score * texture * 0.05e0 + (1 - noise_score) * temporal_stability * 0.04e0", '1.0e0')} AS pred_ssim FROM feats)))""",
    "v_encodes", "pred_vmaf pred_ssim vmaf_conf ssim_conf confidence importance_blur", feats=FEATS,
)
def _(spark, sf):
    c = F.col
    f = V.v_encodes(spark, sf).select(
        "job_id", "step", c("vmaf").alias("laplacian_var"), c("tax").alias("fft_score"), (c("tax") / 2).alias("noise_var"), (c("vmaf") / 3).alias("snr_db"),
        (c("tax") / 3).alias("edge_density"), (c("tax") * 5).alias("texture"), (c("size_mb") * 3).alias("gradient_magnitude"), ((c("vmaf") - 50) / 50).alias("blur_score"),
        (c("tax") * 8).alias("noise_score"), (c("size_mb") / 21).alias("complexity_score"), (c("ssim") - 0.4).alias("motion_score"), (1.4 - c("ssim")).alias("temporal_stability"),
        (c("crf") - 12).alias("frames"), (c("crf") / 8).alias("analysis_s"),
    )
    return PR.predict_stat(f).select("job_id", "step", "pred_vmaf", "pred_ssim", "vmaf_conf", "ssim_conf", "confidence", "skip", "importance_blur", "risk_factors")


CHARS = """SELECT asset_id, width, height, fps, duration_s * (1 + asset_id % 5) AS duration_s, CASE WHEN asset_id % 6 = 0 THEN NULL ELSE bitrate END AS bitrate, codec, complexity / 10 AS complexity, motion / 10 AS motion, asset_id % 70 AS scene_changes FROM v_assets"""
PRED = """SELECT *, greatest(0.0e0, least(100.0e0, 75 + width * height / 1000000.0e0 * 0.015e0 + coalesce(bitrate / 1000000.0e0, 0) * 0.008e0 - complexity * 15 - motion * 10 + fps * 0.1e0 + CASE WHEN codec = 'hevc' THEN 5 ELSE 0 END + CASE WHEN duration_s > 300 THEN duration_s * -0.05e0 ELSE 0 END)) AS pred_vmaf,
  greatest(0.0e0, least(1.0e0, 0.92e0 + width * height / 1000000.0e0 * 0.00008e0 + coalesce(bitrate / 1000000.0e0, 0) * 0.000005e0 - complexity * 0.08e0 - motion * 0.05e0 + fps * 0.0005e0 + CASE WHEN codec = 'hevc' THEN 0.02e0 ELSE 0 END + CASE WHEN duration_s > 300 THEN duration_s * -0.0001e0 ELSE 0 END)) AS pred_ssim FROM chars"""


def chars(spark, sf):
    c = F.col
    return V.v_assets(spark, sf).select(
        "asset_id", "width", "height", "fps", (c("duration_s") * (c("asset_id") % 5 + 1)).alias("duration_s"),
        F.when(c("asset_id") % 6 != 0, c("bitrate")).alias("bitrate"), "codec", (c("complexity") / 10).alias("complexity"), (c("motion") / 10).alias("motion"),
        (c("asset_id") % 70).alias("scene_changes"),
    )


@query("predict_chars", "SELECT asset_id, pred_vmaf, pred_ssim FROM pred", "v_assets", "pred_vmaf pred_ssim", 9, chars=CHARS, pred=PRED)
def _(spark, sf):
    return PR.predict_chars(chars(spark, sf)).select("asset_id", "pred_vmaf", "pred_ssim")


DECISION = f"""SELECT *, confidence >= 0.7e0 AND pred_vmaf >= 75 AND pred_ssim >= 0.9e0 AND complexity < 0.3e0 AND motion < 0.4e0 AND duration_s < 120 AS skip,
   least(300.0e0, least(3.0e0, duration_s / 60) * 30 * (width * height / 2073600.0e0) * (complexity * 0.5e0 + 1)) AS eval_cost_s,
   {_codes(_when('complexity > 0.7e0', 'high_complexity_content'), _when('motion > 0.8e0', 'high_motion_content'), _when('width * height > 8294400', 'very_high_resolution'), _when('duration_s > 600', 'very_long_duration'), _when('bitrate <> 0 AND bitrate < 500000', 'very_low_bitrate'), _when('scene_changes > duration_s / 3', 'frequent_scene_changes'), _when("codec = 'unknown'", 'unknown_codec'))} AS risk_factors
  FROM (SELECT *, (CASE WHEN width * height >= 2073600 THEN 0.9e0 WHEN width * height >= 921600 THEN 0.7e0 ELSE 0.5e0 END + CASE WHEN coalesce(bitrate, 0) <> 0 THEN 0.8e0 ELSE 0.4e0 END + (1 - complexity * 0.5e0) + (1 - motion * 0.3e0)
     + CASE WHEN duration_s < 60 THEN 0.9e0 WHEN duration_s < 300 THEN 0.7e0 ELSE 0.5e0 END + CASE WHEN similar_results >= 3 THEN 0.9e0 WHEN similar_results >= 1 THEN 0.6e0 ELSE 0.3e0 END) / 6 AS confidence
    FROM (SELECT p.*, coalesce(n.c, 0) AS similar_results FROM pred p LEFT JOIN (SELECT asset_id, count(*) AS c FROM near WHERE similarity > 0.7e0 GROUP BY asset_id) n USING (asset_id)))"""
NEAR = NEIGHBOURS.replace("duration_s, complexity / 10 AS complexity, motion / 10 AS motion, fps FROM v_assets) a", "duration_s, complexity, motion, fps FROM chars) a")
DEC = dict(chars=CHARS, pred=PRED, history=HISTORY, near=NEAR, decision=DECISION)


@query("predict_decision", "SELECT asset_id, similar_results, confidence, skip, eval_cost_s, risk_factors FROM decision", "v_assets v_encodes",
       "confidence eval_cost_s", 9, **DEC)
def _(spark, sf):
    out = PR.predict_decision(V.spread(chars(spark, sf), "asset_id"), history(spark, sf), threshold=0.7)
    return out.select("asset_id", "similar_results", "confidence", "skip", "eval_cost_s", "risk_factors")


KNN_PAIRS = """SELECT asset_id, job_id * 1000 + step AS result_id, 0.6e0 + (job_id * 7 + step * 3) % 41 / 100.0e0 AS similarity, vmaf, CASE WHEN crf % 3 <> 0 THEN ssim END AS ssim, CASE WHEN crf % 2 = 0 THEN size_mb + 30 END AS psnr FROM v_encodes"""


@query(
    "knn_quality",
    """SELECT asset_id, vmaf, ssim, psnr, n AS similar_results, least(0.9e0, n * 0.15e0 + mx * 0.5e0) AS confidence FROM (
    SELECT asset_id, sum(vmaf * similarity) / sum(similarity) FILTER (vmaf IS NOT NULL) AS vmaf, sum(ssim * similarity) / sum(similarity) FILTER (ssim IS NOT NULL) AS ssim, sum(psnr * similarity) / sum(similarity) FILTER (psnr IS NOT NULL) AS psnr, max(n) AS n, max(similarity) AS mx
    FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY similarity DESC, result_id) AS r, count(*) OVER (PARTITION BY asset_id) AS n FROM pairs WHERE similarity >= 0.7e0) WHERE r <= 5 GROUP BY asset_id) WHERE n >= 2 AND (vmaf IS NOT NULL OR ssim IS NOT NULL)""",
    "v_encodes", "vmaf ssim psnr confidence", pairs=KNN_PAIRS,
)
def _(spark, sf):
    c = F.col
    p = V.v_encodes(spark, sf).select(
        "asset_id", (c("job_id") * 1000 + c("step")).alias("result_id"), ((c("job_id") * 7 + c("step") * 3) % 41 / 100.0 + 0.6).alias("similarity"), "vmaf",
        F.when(c("crf") % 3 != 0, c("ssim")).alias("ssim"), F.when(c("crf") % 2 == 0, c("size_mb") + 30).alias("psnr"),
    )
    return PR.knn_quality(p)


# ------------------------------------------------------------------ gates


@query(
    "hybrid_score",
    """SELECT job_id, step, overall, floor_used, overall >= floor_used AS passes FROM (SELECT job_id, step, vmaf * 0.4e0 + size_mb * 5 * 0.2e0 + ssim * 100 * 0.2e0 + (100 - crf) * 0.2e0 AS overall,
      CASE WHEN tax > 0.04e0 THEN CASE least(3, step - 1) WHEN 0 THEN 70.0e0 WHEN 1 THEN 60.0e0 WHEN 2 THEN 50.0e0 ELSE 45.0e0 END ELSE 65.0e0 END AS floor_used FROM v_encodes)""",
    "v_encodes", "overall",
)
def _(spark, sf):
    c = F.col
    e = V.v_encodes(spark, sf).select(
        "job_id", "step", c("vmaf").alias("perceptual"), (c("size_mb") * 5).alias("size_score"), (c("ssim") * 100).alias("frame_score"),
        (100 - c("crf")).alias("tech_score"), (c("tax") > 0.04).alias("is_segment"), (c("step") - 1).alias("attempt"),
    )
    return Q.hybrid_score(e).select("job_id", "step", "overall", "floor_used", "passes")


GATE = """SELECT job_id, step, v, s, tax * 10 AS confidence FROM (SELECT *, CASE WHEN crf <> 22 THEN vmaf END AS v, CASE WHEN ssim < 0.98e0 THEN ssim END AS s FROM v_encodes)"""


@query(
    "quality_gate",
    """SELECT mode, job_id, step, fallback_reason, CASE WHEN fallback_reason IS NULL THEN raw ELSE mode <> 'strict' END AS passes FROM (
    SELECT job_id, step, coalesce(v >= 80, false) AND coalesce(s >= 0.94e0, false) AS raw, CASE WHEN v IS NULL AND s IS NULL THEN 'evaluation_failed' WHEN confidence < 0.3e0 THEN 'low_confidence' END AS fallback_reason FROM gate)
    CROSS JOIN (VALUES ('conservative'), ('strict')) m(mode)""",
    "v_encodes", gate=GATE,
)
def _(spark, sf):
    c = F.col
    e = V.v_encodes(spark, sf).select("job_id", "step", F.when(c("crf") != 22, c("vmaf")).alias("vmaf"), F.when(c("ssim") < 0.98, c("ssim")).alias("ssim"), (c("tax") * 10).alias("confidence"))
    parts = [Q.quality_gate(e, m).select(F.lit(m).alias("mode"), "job_id", "step", "fallback_reason", "passes") for m in ("conservative", "strict")]
    return parts[0].unionByName(parts[1])


FAIL_IN = f"""SELECT job_id, step, vmaf AS v, ssim - 0.03e0 AS s, tax * 2 AS blk, CASE WHEN crf % 3 <> 0 THEN tax * 1.7e0 END AS bnd, CASE WHEN crf % 2 = 0 THEN tax * 3 END AS blur, tax * 2.6e0 AS noise, bitrate_kbps // 3 AS rate, encoder,
  CASE preset WHEN 'fast' THEN 'ultrafast' WHEN 'medium' THEN 'p1' ELSE preset END AS preset, bitrate_kbps * 4 AS orig, {_pick('crf', *_q('low', 'medium', 'high'))} AS ml, {_pick('step', *_q('low', 'high'))} AS cl, size_mb / 7 - 0.1e0 AS room, crf % 4 <> 0 AS eval_ok, tax FROM v_encodes"""


def _sayl(test, *codes):
    return "CASE WHEN coalesce(" + test + ", false) THEN [" + ", ".join(f"'{c}'" for c in codes) + "] ELSE [] END"


def _cat(*items):
    return "flatten([" + ", ".join(items) + "])"


FAIL1 = f"""SELECT *, {_cat(_sayl('v < 80', 'low_vmaf'), _sayl('s < 0.94e0', 'low_ssim'), _sayl('blk > 0.12e0', 'high_blockiness', 'compression_artifacts'), _sayl('bnd > 0.1e0', 'high_banding', 'compression_artifacts'), _sayl('blur > 0.15e0', 'blur_artifacts'), _sayl('noise > 0.2e0', 'noise_artifacts'), _sayl('blk > 0.12e0 AND blur > 0.15e0', 'temporal_artifacts'))} AS f0 FROM fin"""
FAIL2 = f"""SELECT *, list_filter([{', '.join(f"'{x}'" for x in Q.FAILURES)}], lambda x: list_contains(f0, x) OR (x = 'combined_quality' AND (len(f0) >= 3 OR len(f0) = 0))) AS ft FROM f1"""
FAIL3 = f"""SELECT *, list_filter([{', '.join(f"'{x}'" for x in Q.CAUSES)}], lambda x: list_contains({_cat(_sayl('rate < 500 OR (rate < 1000 AND v < 70)', 'insufficient_bitrate'), _sayl("(encoder = 'libx264' AND preset IN ('ultrafast', 'superfast')) OR (contains(encoder, 'nvenc') AND preset IN ('p1', 'p2'))", 'poor_encoder_settings'), _sayl('orig > 0 AND rate < orig * 0.1e0', 'aggressive_compression'),
  _sayl("list_contains(ft, 'high_blockiness')", 'insufficient_bitrate', 'aggressive_compression'), _sayl("list_contains(ft, 'high_banding')", 'codec_limitations', 'aggressive_compression'), _sayl("list_contains(ft, 'blur_artifacts')", 'preprocessing_issues', 'poor_encoder_settings'), _sayl("list_contains(ft, 'temporal_artifacts')", 'temporal_compression'), _sayl("ml = 'high' AND v < 75", 'content_complexity'), _sayl("cl = 'high' AND s < 0.92e0", 'content_complexity'))}, x)) AS rc,
  list_reverse_sort(list_filter([CASE WHEN v < 40 THEN 1.0e0 WHEN v < 60 THEN 0.8e0 WHEN v < 80 THEN 0.6e0 WHEN v IS NOT NULL THEN 0.3e0 END, CASE WHEN s < 0.85e0 THEN 1.0e0 WHEN s < 0.9e0 THEN 0.8e0 WHEN s < 0.94e0 THEN 0.6e0 WHEN s IS NOT NULL THEN 0.3e0 END, CASE WHEN blk > 0.12e0 THEN least(1.0e0, (blk - 0.12e0) / 0.88e0) END, CASE WHEN bnd > 0.1e0 THEN least(1.0e0, (bnd - 0.1e0) / 0.9e0) END, CASE WHEN len(ft) >= 3 THEN 0.8e0 END], lambda x: x IS NOT NULL)) AS m FROM f2"""
FAIL4 = """SELECT *, CASE len(m) WHEN 0 THEN 0.5e0 WHEN 1 THEN m[1] WHEN 2 THEN m[1] * 0.7e0 + m[2] * 0.3e0 ELSE m[1] * 0.5e0 + m[2] * 0.3e0 + list_sum(m[3:]) * 0.2e0 / len(m[3:]) END AS severity,
  list_avg(list_filter([CASE WHEN v IS NOT NULL THEN 0.9e0 END, CASE WHEN s IS NOT NULL THEN 0.8e0 END, CASE WHEN blk IS NOT NULL THEN 0.7e0 END, CASE WHEN bnd IS NOT NULL THEN 0.7e0 END, 0.6e0, CASE WHEN eval_ok THEN 0.8e0 ELSE 0.3e0 END], lambda x: x IS NOT NULL)) AS sure,
  list_avg(list_filter([CASE WHEN room > 2 THEN 0.9e0 WHEN room > 0.5e0 THEN 0.7e0 WHEN room > 0.1e0 THEN 0.4e0 ELSE 0.1e0 END, CASE WHEN list_has_any(rc, ['insufficient_bitrate', 'poor_encoder_settings', 'aggressive_compression']) THEN 0.8e0 END, CASE WHEN list_has_any(ft, ['low_vmaf', 'low_ssim', 'high_blockiness', 'high_banding']) THEN 0.7e0 END,
    CASE WHEN encoder IN ('libx264', 'libx265') THEN 0.8e0 WHEN contains(encoder, 'nvenc') OR contains(encoder, 'amf') THEN 0.6e0 END], lambda x: x IS NOT NULL)) AS potential,
  list_reverse_sort(list_filter([""" + ", ".join(
    f"CASE WHEN list_contains(ft, '{x}') THEN (coalesce({w}, 0.5e0), {-i}, '{x}') END" for i, (x, w) in enumerate(zip(Q.FAILURES, (
        "greatest(0.0e0, (80 - v) / 80)", "greatest(0.0e0, (0.94e0 - s) / 0.94e0)", "least(1.0e0, (blk - 0.12e0) / 0.88e0)", "least(1.0e0, (bnd - 0.1e0) / 0.9e0)",
        "0.5e0", "0.5e0", "0.5e0", "0.5e0", "0.5e0")))) + """], lambda x: x IS NOT NULL))[1][3] AS issue FROM f3"""
FAILS = dict(fin=FAIL_IN, f1=FAIL1, f2=FAIL2, f3=FAIL3, f4=FAIL4)


def failing(spark, sf):
    c = F.col
    e = V.v_encodes(spark, sf).select(
        "job_id", "step", "vmaf", (c("ssim") - 0.03).alias("ssim"), (c("tax") * 2).alias("blockiness"), F.when(c("crf") % 3 != 0, c("tax") * 1.7).alias("banding"),
        F.when(c("crf") % 2 == 0, c("tax") * 3).alias("blur"), (c("tax") * 2.6).alias("noise"), F.floor(c("bitrate_kbps") / 3).alias("bitrate_kbps"), "encoder",
        F.when(c("preset") == "fast", "ultrafast").when(c("preset") == "medium", "p1").otherwise(c("preset")).alias("preset"), (c("bitrate_kbps") * 4).alias("original_kbps"),
        pick(c("crf"), "low", "medium", "high").alias("motion_level"), pick(c("step"), "low", "high").alias("complexity_level"),
        (c("size_mb") / 7 - 0.1).alias("headroom_mb"), (c("crf") % 4 != 0).alias("eval_ok"),
    )
    return Q.failure_analysis(e)


@query(
    "failure_analysis",
    """SELECT job_id, step, ft AS failure_types, rc AS root_causes, issue AS primary_issue, severity, sure AS analysis_confidence, potential, room > 0.1e0 AS can_improve,
      CASE WHEN issue = 'high_blockiness' AND list_contains(rc, 'insufficient_bitrate') THEN 'insufficient_bitrate' WHEN issue = 'high_blockiness' AND list_contains(rc, 'aggressive_compression') THEN 'aggressive_compression'
        WHEN issue = 'high_banding' AND list_contains(rc, 'codec_limitations') THEN 'codec_limitations' WHEN issue = 'high_banding' AND list_contains(rc, 'aggressive_compression') THEN 'aggressive_compression'
        WHEN issue IN ('low_vmaf', 'low_ssim') AND list_contains(rc, 'insufficient_bitrate') THEN 'insufficient_bitrate' WHEN issue IN ('low_vmaf', 'low_ssim') AND list_contains(rc, 'poor_encoder_settings') THEN 'poor_encoder_settings'
        WHEN list_contains(rc, 'insufficient_bitrate') OR len(rc) = 0 THEN 'insufficient_bitrate' ELSE rc[1] END AS primary_cause FROM f4""",
    "v_encodes", "severity analysis_confidence potential", **FAILS,
)
def _(spark, sf):
    return failing(spark, sf).select("job_id", "step", "failure_types", "root_causes", "primary_issue", "severity", "analysis_confidence", "potential", "can_improve", "primary_cause")


STRAT = f"""SELECT job_id, step, CASE WHEN len(k) = 0 THEN CASE WHEN room > 0.5e0 THEN ['increase_bitrate'] WHEN room > 0.1e0 THEN ['better_encoding'] ELSE []::VARCHAR[] END ELSE list_filter(k, lambda x, i: list_position(k, x) = i)[1:4] END AS strategies FROM (
  SELECT *, list_filter({_cat(_sayl("list_contains(rc, 'insufficient_bitrate') AND room > 0.5e0", 'increase_bitrate'), _sayl("list_contains(rc, 'poor_encoder_settings')", 'better_encoding'), _sayl("list_contains(rc, 'codec_limitations')", 'advanced_codec'), _sayl("list_contains(rc, 'temporal_compression')", 'temporal_optimization'),
    _sayl("list_contains(rc, 'aggressive_compression')", 'increase_bitrate', 'better_encoding'), _sayl("list_contains(ft, 'high_blockiness')", 'increase_bitrate', 'temporal_optimization'), _sayl("list_contains(ft, 'high_banding')", 'advanced_codec', 'perceptual_tuning'), _sayl("list_contains(ft, 'blur_artifacts')", 'better_encoding', 'perceptual_tuning'),
    _sayl("list_has_any(ft, ['low_vmaf', 'low_ssim'])", 'increase_bitrate', 'better_encoding'), _sayl('severity > 0.8e0', 'advanced_codec', 'temporal_optimization', 'perceptual_tuning'), _sayl('severity > 0.6e0 AND severity <= 0.8e0', 'better_encoding', 'temporal_optimization'))},
    lambda x: (potential >= 0.3e0 OR x IN ('increase_bitrate', 'advanced_codec')) AND (room >= 0.2e0 OR x <> 'increase_bitrate')) AS k FROM f4)"""


@query("strategy_list", STRAT, "v_encodes", **FAILS)
def _(spark, sf):
    return Q.strategies(failing(spark, sf)).select("job_id", "step", "strategies")


@query(
    "bitrate_recommend",
    """SELECT job_id, step, rec AS recommended_kbps, CASE WHEN rec > rate THEN least(25.0e0, 15 * ln(rec / rate) * CASE WHEN v < 50 THEN 1.5e0 WHEN v < 70 THEN 1.2e0 WHEN v < 85 OR v IS NULL THEN 1.0e0 ELSE 0.7e0 END * CASE encoder WHEN 'libx265' THEN 1.2e0 WHEN 'h264_nvenc' THEN 0.8e0 WHEN 'h264_amf' THEN 0.8e0 ELSE 1.0e0 END
        * CASE WHEN list_contains(ft, 'high_blockiness') THEN 1.3e0 WHEN list_contains(ft, 'high_banding') THEN 0.8e0 ELSE 1.0e0 END) ELSE 0.0e0 END AS expected_gain,
      CASE WHEN rec <= top THEN rec WHEN top >= 500 THEN top END AS fitted_kbps
    FROM (SELECT *, greatest(rate, CAST(floor(floor(base * rf * 0.9e0) * CASE encoder WHEN 'libx265' THEN 0.7e0 WHEN 'h264_nvenc' THEN 1.2e0 WHEN 'h264_amf' THEN 1.2e0 ELSE 1.0e0 END) AS BIGINT)) AS rec, CAST(floor(10 * 8 * 1024 * 0.95e0 / (20 + step * 15)) AS BIGINT) AS top
      FROM (SELECT *, 0.5e0 + tax AS rf, CASE WHEN severity > 0.8e0 THEN 10000 WHEN severity > 0.6e0 AND b0 = 1500 THEN 3000 ELSE b0 END AS base FROM (SELECT *, CASE WHEN v IS NULL THEN 3000 WHEN v < 60 THEN 10000 WHEN v < 75 THEN 6000 WHEN v < 85 THEN 3000 ELSE 1500 END AS b0 FROM f4)))""",
    "v_encodes", "expected_gain", **FAILS,
)
def _(spark, sf):
    c = F.col
    raw = V.v_encodes(spark, sf).select("job_id", "step", "tax")
    f = failing(spark, sf).join(raw, ["job_id", "step"]).withColumns(
        {"resolution_factor": c("tax") + 0.5, "fps_factor": F.lit(0.9), "size_limit_mb": F.lit(10.0), "duration_s": c("step") * 15 + 20}
    )
    return Q.recommend_bitrate(f).select("job_id", "step", "recommended_kbps", "expected_gain", "fitted_kbps")


# ------------------------------------------------------------------ content

FLAGS = [f for votes in C.VOTES.values() for f, _ in votes]


def flag_table(spark, sf):
    e = V._events(spark, sf)
    cols = [((F.col("k") + F.col("user_id") * (i + 3)) % (6 + i) < 2 + F.col("user_id") % 3).alias(f) for i, f in enumerate(FLAGS)]
    return e.withColumn("g", F.floor(F.col("event_id") / 40)).select(F.col("g").alias("video_id"), *cols)


FLAG_SQL = "SELECT event_id // 40 AS video_id, " + ", ".join(f"(k + user_id * {i + 3}) % {6 + i} < 2 + user_id % 3 AS {f}" for i, f in enumerate(FLAGS)) + " FROM v_events"
SCORE_SQL = "SELECT video_id, " + ", ".join(
    " + ".join(f"sum(CASE WHEN {f} THEN {p}e0 ELSE 0 END)" for f, p in votes) + f" AS {kind}_score" for kind, votes in C.VOTES.items()) + " FROM flags GROUP BY video_id"
KINDS = list(C.VOTES)


@query(
    "content_type",
    "SELECT *, CASE WHEN top < 3 OR " + " + ".join(f"CASE WHEN {k}_score > top * 0.7e0 THEN 1 ELSE 0 END" for k in KINDS) + " > 1 THEN 'mixed' ELSE CASE " +
    " ".join(f"WHEN {k}_score = top THEN '{k}'" for k in KINDS) + " END END AS content_type FROM (SELECT *, greatest(" + ", ".join(f"{k}_score" for k in KINDS) + ") AS top FROM scores)",
    "v_events", " ".join(f"{k}_score" for k in KINDS), flags=FLAG_SQL, scores=SCORE_SQL,
)
def _(spark, sf):
    out = C.content_type(flag_table(spark, sf))
    return out.withColumn("top", F.greatest(*[F.col(f"{k}_score") for k in KINDS]))


def _sqlv(v):
    return f"'{v}'" if isinstance(v, str) else (str(v).lower() if isinstance(v, bool) else (f"{v}e0" if isinstance(v, float) else str(v)))


PROFILE_VALUES = "SELECT * FROM (VALUES " + ", ".join(
    "('" + n + "', " + ", ".join(_sqlv(v) for v in vals) + ")" for n, vals in C.PROFILES.items()) + ") t(profile, preset, tune, crf, efficiency, audio_share, min_quality, quality_bias, gop_factor, b_frames, denoise, deband, sharpen, motion_sens, spatial_sens)"
PROFILED = """SELECT * FROM (SELECT *, CASE content_type WHEN 'animation' THEN CASE WHEN spatial > 7 THEN 'animation_high_detail' WHEN motion > 7 THEN 'animation_high_motion' ELSE 'animation_standard' END WHEN 'screen_recording' THEN 'screen_recording'
   WHEN 'gaming' THEN CASE WHEN motion > 8 THEN 'gaming_high_action' ELSE 'gaming_standard' END WHEN 'live_action' THEN CASE WHEN motion > 7 AND spatial > 7 THEN 'live_action_complex' WHEN motion > 7 THEN 'live_action_high_motion' WHEN spatial > 7 THEN 'live_action_high_detail' ELSE 'live_action_standard' END
   ELSE CASE WHEN motion > 6 OR spatial > 6 THEN 'mixed_complex' ELSE 'mixed_standard' END END AS profile FROM content) JOIN profiles USING (profile)"""
PROF = dict(content=CONTENT, profiles=PROFILE_VALUES, profiled=PROFILED)


@query(
    "profile_pick",
    """SELECT asset_id, profile, tune, 0.95e0 AS quality_bias, greatest(15, crf - 3) AS crf, CASE WHEN preset IN ('fast', 'medium') THEN 'slow' ELSE preset END AS preset FROM profiled""",
    "v_assets", **PROF,
)
def _(spark, sf):
    return C.pick_profile(content_assets(spark, sf), 0.95).select("asset_id", "profile", "tune", "quality_bias", "crf", "preset")


ADJ = lambda x, s, u, d: f"CASE WHEN {x} > 7 THEN ({x} - 7) * {s} * {u} WHEN {x} < 3 THEN ({x} - 3) * {s} * {d} ELSE 0 END"


@query(
    "bitrate_split",
    f"""SELECT asset_id, a AS audio_out_kbps, v AS video_out_kbps, complexity_factor, greatest(0.0e0, least(1.0e0, least(v / 2000, 1.0e0) - (motion + spatial) / 20 * 0.2e0 + quality_bias * 0.1e0)) AS predicted_quality,
      greatest(0.3e0, least(0.95e0, 0.7e0 + CASE content_type WHEN 'animation' THEN 0.2e0 WHEN 'screen_recording' THEN 0.2e0 WHEN 'mixed' THEN -0.1e0 ELSE 0 END + CASE WHEN stability > 7 THEN 0.1e0 ELSE 0 END - CASE WHEN scene_count > 20 THEN 0.1e0 ELSE 0 END)) AS split_confidence
    FROM (SELECT *, greatest(100, CAST(trunc(r - a) AS BIGINT)) AS v FROM (SELECT *, greatest(32, least(192, CAST(floor(r * audio_share) AS BIGINT))) AS a FROM (
      SELECT *, target_mb * 8 * 1048576 / (duration_s * 1000) * complexity_factor * efficiency * (1 + {ADJ('motion', 'motion_sens', '0.1e0', '0.05e0')} + {ADJ('spatial', 'spatial_sens', '0.08e0', '0.04e0')} + CASE content_type WHEN 'animation' THEN -0.1e0 WHEN 'screen_recording' THEN -0.2e0 WHEN 'gaming' THEN 0.05e0 WHEN 'mixed' THEN 0.02e0 ELSE 0 END) AS r
      FROM (SELECT *, 0.7e0 + (motion * motion_sens + spatial * spatial_sens) / 2 / 10 * 0.6e0 AS complexity_factor FROM profiled))))""",
    "v_assets", "complexity_factor predicted_quality split_confidence", **PROF,
)
def _(spark, sf):
    out = C.bitrate_split(C.pick_profile(content_assets(spark, sf)))
    return out.select("asset_id", "audio_out_kbps", "video_out_kbps", "complexity_factor", "predicted_quality", "split_confidence")


@query(
    "dynamic_params",
    f"""SELECT asset_id, greatest(15, least(35, crf + CASE WHEN spatial > 8 THEN -2 WHEN spatial < 3 THEN 1 ELSE 0 END + CASE WHEN noise > 6 THEN 1 ELSE 0 END)) AS out_crf,
      CASE WHEN motion > 8 AND quality_bias < 0.7e0 THEN CASE preset WHEN 'slow' THEN 'medium' WHEN 'medium' THEN 'fast' WHEN 'fast' THEN 'veryfast' ELSE preset END WHEN spatial > 8 AND quality_bias > 0.7e0 THEN CASE preset WHEN 'veryfast' THEN 'fast' WHEN 'fast' THEN 'medium' WHEN 'medium' THEN 'slow' ELSE preset END ELSE preset END AS out_preset,
      greatest(15, least(300, g + CASE WHEN motion > 7 THEN -CAST(floor(g * 0.3e0) AS BIGINT) WHEN stability > 8 THEN CAST(floor(g * 0.5e0) AS BIGINT) ELSE 0 END)) AS out_gop,
      CASE WHEN motion > 8 THEN greatest(1, b_frames - 2) WHEN content_type = 'screen_recording' THEN least(8, b_frames + 2) ELSE b_frames END AS out_b_frames,
      {_codes(_when('denoise AND noise > 3', 'denoise'), _when("deband AND (content_type = 'animation' OR stability < 4)", 'deband'), _when("sharpen AND (content_type = 'screen_recording' OR noise / 20 > 0.15e0)", 'sharpen'))} AS filters,
      {_codes(_when('spatial > 8', 'crf_reduced_detail'), _when('spatial < 3', 'crf_raised_flat'), _when('noise > 6', 'crf_raised_noise'), _when("motion > 8 AND quality_bias < 0.7e0 AND preset IN ('slow', 'medium', 'fast')", 'preset_faster'), _when("NOT (motion > 8 AND quality_bias < 0.7e0) AND spatial > 8 AND quality_bias > 0.7e0 AND preset IN ('veryfast', 'fast', 'medium')", 'preset_slower'),
        _when('motion > 7', 'gop_shorter'), _when('motion <= 7 AND stability > 8', 'gop_longer'), _when('motion > 8', 'b_frames_fewer'), _when("motion <= 8 AND content_type = 'screen_recording'", 'b_frames_more'), _when('denoise AND noise > 3', 'denoising'), _when("deband AND (content_type = 'animation' OR stability < 4)", 'debanding'), _when("sharpen AND (content_type = 'screen_recording' OR noise / 20 > 0.15e0)", 'sharpening'))} AS adjustments
    FROM (SELECT *, CAST(floor(30 * gop_factor) AS BIGINT) AS g FROM profiled)""",
    "v_assets", **PROF,
)
def _(spark, sf):
    a = content_assets(spark, sf).withColumns({"color_complexity": F.col("stability"), "edge_density": F.col("noise") / 20})
    return C.dynamic_params(C.pick_profile(a)).select("asset_id", "out_crf", "out_preset", "out_gop", "out_b_frames", "filters", "adjustments")


# ------------------------------------------------------------------ planning

ENCODERS = _pick("crf", *_q("libx264", "libx265", "h264_nvenc", "h264_amf"))
FLOOR_IN = f"""SELECT job_id, step, width, height, fps, bitrate_kbps // 300 AS rate, {ENCODERS} AS encoder, 64 AS audio, duration_s * CASE WHEN crf = 21 THEN 12 ELSE 1 END AS dur, size_mb AS target FROM v_encodes JOIN v_assets USING (asset_id)"""


def floor_input(spark, sf):
    c = F.col
    e = V.v_encodes(spark, sf).select(
        "job_id", "step", "asset_id", F.floor(c("bitrate_kbps") / 300).alias("bitrate_kbps"), "crf",
        pick(c("crf"), "libx264", "libx265", "h264_nvenc", "h264_amf").alias("encoder"), F.lit(64).alias("audio_kbps"), c("size_mb").alias("target_mb"),
    )
    a = V.v_assets(spark, sf).select("asset_id", "width", "height", "fps", "duration_s")
    return e.join(a, "asset_id").withColumn("duration_s", c("duration_s") * F.when(c("crf") == 21, 12).otherwise(1)).drop("crf")


FL1 = f"""SELECT *, CASE encoder WHEN 'libx264' THEN 300 WHEN 'libx265' THEN 15 ELSE 8 END AS mn, greatest(64, CAST(trunc(trunc((target * 8 * {MIB} - audio * 1000 * dur) / (dur * 1000)) / 1.1e0) AS BIGINT)) AS budget FROM fl0"""
FL_CANDS = """SELECT job_id, step, 1 + i AS ord, 'resolution' AS kind, w AS nw, h AS nh, fps AS nf, budget AS k, CASE WHEN w * h / (width * height) >= 0.8e0 THEN 'minimal' WHEN w * h / (width * height) >= 0.6e0 THEN 'moderate' ELSE 'significant' END AS imp FROM fl1 CROSS JOIN res WHERE NOT (w >= width AND h >= height)
  UNION ALL SELECT job_id, step, 10 + j, 'fps', width, height, greatest(10.0e0, fps * s), CAST(floor(floor(rate * (fps / greatest(10.0e0, fps * s))) / 1.1e0) AS BIGINT), CASE WHEN greatest(10.0e0, fps * s) / fps >= 0.8e0 THEN 'minimal' WHEN greatest(10.0e0, fps * s) / fps >= 0.6e0 THEN 'moderate' ELSE 'significant' END FROM fl1 CROSS JOIN steps WHERE greatest(10.0e0, fps * s) < fps
  UNION ALL SELECT job_id, step, 20 + i * 3 + j, 'combined', w, h, greatest(10.0e0, fps * s), CAST(floor(floor(rate * (fps / greatest(10.0e0, fps * s) * (1 / sqrt(w * h / (width * height))))) / 1.1e0) AS BIGINT),
    CASE WHEN w * h / (width * height) * (greatest(10.0e0, fps * s) / fps) >= 0.7e0 THEN 'minimal' WHEN w * h / (width * height) * (greatest(10.0e0, fps * s) / fps) >= 0.5e0 THEN 'moderate' ELSE 'significant' END FROM fl1 CROSS JOIN res CROSS JOIN steps WHERE NOT (w >= width AND h >= height) AND greatest(10.0e0, fps * s) < fps"""
FL_TRIES = """SELECT job_id, step, 0 AS ord, 320 AS nw, 180 AS nh, fps AS nf, budget AS k FROM fl1 UNION ALL SELECT job_id, step, 1, width, height, greatest(10.0e0, fps * 0.5e0), CAST(floor(floor(rate * (fps / greatest(10.0e0, fps * 0.5e0))) / 1.1e0) AS BIGINT) FROM fl1
  UNION ALL SELECT job_id, step, ord, nw, nh, nf, k FROM cands WHERE kind = 'combined'"""
RESN = ((1280, 720), (854, 480), (640, 360), (480, 270), (320, 180))


@query(
    "floor_adjust",
    """SELECT job_id, step, coalesce(rate >= mn, false) OR g.kind IS NOT NULL AS adjust_ok, CASE WHEN rate >= mn THEN 'none' ELSE coalesce(g.kind, 'failed') END AS adjustment,
      CAST(CASE WHEN rate >= mn THEN width ELSE coalesce(g.nw, t.nw) END AS BIGINT) AS new_width, CAST(CASE WHEN rate >= mn THEN height ELSE coalesce(g.nh, t.nh) END AS BIGINT) AS new_height, CASE WHEN rate >= mn THEN fps ELSE coalesce(g.nf, t.nf) END AS new_fps,
      CASE WHEN rate >= mn THEN rate ELSE coalesce(g.k, t.k) END AS new_kbps, CASE WHEN rate >= mn THEN 'minimal' ELSE coalesce(g.imp, 'significant') END AS impact
    FROM fl1 LEFT JOIN (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.job_id, c.step ORDER BY ord) AS r FROM cands c JOIN fl1 USING (job_id, step) WHERE k >= mn) WHERE r = 1) g USING (job_id, step)
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, step ORDER BY k DESC, ord) AS r FROM tries) WHERE r = 1) t USING (job_id, step)""",
    "v_assets v_encodes", "new_fps", fl0=FLOOR_IN, fl1=FL1, res="SELECT * FROM (VALUES (0, 1280, 720), (1, 854, 480), (2, 640, 360), (3, 480, 270), (4, 320, 180)) t(i, w, h)",
    steps="SELECT * FROM (VALUES (0, 0.8e0), (1, 0.6e0), (2, 0.5e0)) t(j, s)", cands=FL_CANDS, tries=FL_TRIES,
)
def _(spark, sf):
    minima = {"libx264": 300, "libx265": 15, "h264_nvenc": 8, "h264_amf": 8}
    out = P.floor_adjust(floor_input(spark, sf), RESN, (0, 0), 10.0, minima=minima)
    return out.select("job_id", "step", "adjust_ok", "adjustment", "new_width", "new_height", "new_fps", "new_kbps", "impact")


FSTEP = lambda s: f"CAST(floor(rate * (greatest(20.0e0, fps * {s}) / fps)) AS BIGINT)"
SUG = f"""SELECT *, CASE WHEN (1280 < width OR 720 < height) AND bud >= mn THEN 'resolution_reduction' WHEN {FSTEP('0.8e0')} >= mn OR {FSTEP('0.6e0')} >= mn OR {FSTEP('0.5e0')} >= mn THEN 'fps_reduction' ELSE 'segmentation' END AS advice
  FROM (SELECT *, CASE encoder WHEN 'libx264' THEN 300 WHEN 'libx265' THEN 15 ELSE 8 END AS mn, CAST(floor(greatest(target * 8 * {MIB} / greatest(dur, 1.0e0) / 1000 - audio, 64.0e0)) AS BIGINT) AS bud FROM fl0)"""


@query(
    "floor_suggest",
    f"""SELECT job_id, step, advice, CASE advice WHEN 'resolution_reduction' THEN bud WHEN 'segmentation' THEN rate ELSE CASE WHEN {FSTEP('0.8e0')} >= mn THEN {FSTEP('0.8e0')} WHEN {FSTEP('0.6e0')} >= mn THEN {FSTEP('0.6e0')} ELSE {FSTEP('0.5e0')} END END AS advised_kbps,
      (mn + 64) * 1000 * dur / (8 * {MIB}) <= target * 1.1e0 OR CAST(floor(greatest(target * 8 * {MIB} / greatest(dur, 1.0e0) / 1000 - 64, 64.0e0)) AS BIGINT) >= mn AS viable FROM sug""",
    "v_assets v_encodes", fl0=FLOOR_IN, sug=SUG,
)
def _(spark, sf):
    minima = {"libx264": 300, "libx265": 15, "h264_nvenc": 8, "h264_amf": 8}
    both = P.minimum_viable(P.suggest(floor_input(spark, sf), minima=minima), minima)
    return both.select("job_id", "step", "advice", "advised_kbps", "viable")


@query(
    "bpp_select",
    """SELECT asset_id, CASE WHEN kbps < 10 THEN 64 ELSE w END AS sel_w, CASE WHEN kbps < 10 THEN 48 ELSE h END AS sel_h, CASE WHEN kbps < 10 THEN 20.0e0 ELSE f END AS sel_fps, kbps >= 10 AND fit AS meets_bpp FROM (
    SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY fit DESC, hi, fi) AS r FROM (SELECT *, kbps * 1000.0e0 / (w * h * f) >= 0.023e0 AS fit FROM (
      SELECT asset_id, kbps, hi, fi, CAST(hh AS BIGINT) AS h, CASE WHEN hi = -1 THEN width ELSE greatest(64, CAST(floor(hh * (width / height)) AS BIGINT) - CAST(floor(hh * (width / height)) AS BIGINT) % 2) END AS w, f
      FROM (SELECT *, CAST(bitrate // 9000 AS BIGINT) - 10 AS kbps, """ + LEVEL + """ AS ml FROM v_assets) a JOIN (SELECT * FROM hs UNION ALL SELECT -1, 2160) hs ON hi >= 0 OR height = 2160 JOIN fs ON fs.g = CASE WHEN ml = 'low' THEN 'low' WHEN fps >= 30 THEN 'fast' ELSE 'slow' END WHERE hh <= height AND f >= 20))) WHERE r = 1""",
    "v_assets", hs="SELECT * FROM (VALUES (0, 1080), (1, 720), (2, 540), (3, 480), (4, 360), (5, 270), (6, 240), (7, 180), (8, 144), (9, 120)) t(hi, hh)",
    fs="SELECT * FROM (VALUES ('low', 0, 24.0e0), ('low', 1, 20.0e0), ('low', 2, 30.0e0), ('fast', 0, 30.0e0), ('fast', 1, 24.0e0), ('fast', 2, 20.0e0)) t(g, fi, f)",
)
def _(spark, sf):
    a = V.v_assets(spark, sf).withColumn("kbps", F.floor(F.col("bitrate") / 9000) - 10).withColumn("motion_level", S.motion_level(F.col("fps")))
    return P.select_res_fps(a, 0.023).select("asset_id", "sel_w", "sel_h", "sel_fps", "meets_bpp")


@query(
    "segment_decision",
    f"""SELECT asset_id, reason, reason IS NOT NULL AS split, CASE WHEN floor(greatest(target_mb * 8 * {MIB} / greatest(d, 1.0e0) / 1000 - 64, 64.0e0)) < 10 THEN least(greatest(45.0e0, least(240.0e0, target_mb * 8 * 1024 / 74 / 1.1e0)), by_content) ELSE by_content END AS segment_s
    FROM (SELECT *, greatest(45.0e0, least(240.0e0, CASE WHEN d > 0 AND d <= 528 THEN greatest(least(greatest(d / 2, 45.0e0), 240.0e0), 45.0e0) ELSE least(target_mb * 1.2e0 * 8 * {MIB} / bitrate * 3, d / 2) * CASE WHEN complexity >= 9 THEN 0.9e0 WHEN complexity >= 7 THEN 0.95e0 WHEN complexity < 5 THEN 1.15e0 ELSE 1.0e0 END END)) AS by_content,
      CASE WHEN e * 600 > target_mb * 1.8e0 THEN 'too_large_even_aggressive' WHEN e * 1000 > target_mb * 3 THEN 'size_threshold' WHEN e * 1000 > target_mb * 2.2e0 AND complexity >= 9 THEN 'complex_content' WHEN d > 300 THEN 'long_duration' END AS reason
      FROM (SELECT *, d * 1000 / (8 * {MIB}) * 1.15e0 AS e FROM (SELECT *, duration_s * (0.5e0 + asset_id % 9) AS d FROM v_assets)))""",
    "v_assets", "segment_s",
)
def _(spark, sf):
    a = V.v_assets(spark, sf).withColumns({"duration_s": F.col("duration_s") * (F.col("asset_id") % 9 + 0.5), "encoder": F.lit("libx264")})
    return P.segment_decision(a).select("asset_id", "reason", "split", "segment_s")


@query(
    "segment_bitrate",
    f"""SELECT asset_id, i + 1 AS segment_no, greatest(200, CAST(floor(floor(target_mb * 8 * {MIB} * 0.85e0 / (e - s) / 1000) * (CASE WHEN complexity > 7 THEN 1.2e0 WHEN complexity < 3 THEN 0.8e0 ELSE 1.0e0 END * CASE ml WHEN 'low' THEN 0.9e0 WHEN 'high' THEN 1.1e0 ELSE 1.0e0 END * CASE WHEN width * height > 2073600 THEN 1.3e0 WHEN width * height < 921600 THEN 0.8e0 ELSE 1.0e0 END)) AS BIGINT)) AS segment_kbps,
      CASE WHEN complexity > 7 THEN 28 WHEN complexity < 3 THEN 19 ELSE 23 END AS segment_crf, CASE ml WHEN 'high' THEN 'faster' WHEN 'low' THEN 'slower' ELSE 'medium' END AS segment_preset, least(fps, CASE ml WHEN 'low' THEN 24.0e0 ELSE 30.0e0 END) AS segment_fps
    FROM (SELECT *, i * len AS s, CASE WHEN i < n - 1 THEN (i + 1) * len ELSE duration_s END AS e FROM (SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, least(45.0e0, duration_s / n) AS len FROM (SELECT *, {LEVEL} AS ml, CAST(ceil(duration_s / 45) AS BIGINT) AS n FROM v_assets))))""",
    "v_assets",
)
def _(spark, sf):
    from reelscope.operators import generate as G

    a = V.v_assets(spark, sf)
    segs = G.plan_segments(a, F.lit(45.0)).select("asset_id", "segment_no", "start_s", "end_s")
    info = a.select("asset_id", "target_mb", "complexity", "width", "height", "fps", S.motion_level(F.col("fps")).alias("motion_level"))
    return P.segment_bitrate(segs.join(info, "asset_id")).select("asset_id", "segment_no", "segment_kbps", "segment_crf", "segment_preset", "segment_fps")


BAND = lambda a, b, c, d: f"CASE WHEN r < 0.3e0 THEN {a} WHEN r < 0.5e0 THEN {b} WHEN r < 0.7e0 THEN {c} ELSE {d} END"


@query(
    "gif_params",
    f"""SELECT asset_id, CASE WHEN r >= 1 THEN width ELSE greatest(360, CAST(floor(width * sz / 2) * 2 AS BIGINT)) END AS gif_w, CASE WHEN r >= 1 THEN height ELSE greatest(360, CAST(floor(height * sz / 2) * 2 AS BIGINT)) END AS gif_h,
      CASE WHEN r >= 1 THEN CAST(fps AS BIGINT) ELSE greatest(15, CAST(round_even(fps * (pow(r, {BAND('0.4e0', '0.5e0', '0.6e0', '0.7e0')}) * CASE ml WHEN 'low' THEN 0.85e0 WHEN 'high' THEN 1.15e0 ELSE 1.0e0 END), 0) AS BIGINT)) END AS gif_fps,
      CASE WHEN r >= 1 THEN 240 ELSE greatest(128, least(256, CAST(round_even(240 * (pow(r, {BAND('0.3e0', '0.4e0', '0.5e0', '0.6e0')}) * CASE cx WHEN 'low' THEN 0.85e0 WHEN 'high' THEN 1.15e0 ELSE 1.0e0 END), 0) AS BIGINT))) END AS gif_colors,
      CAST(CASE WHEN r >= 1 THEN asset_id % 80 ELSE least(120, asset_id % 80 + {BAND(120, 80, 50, 25)}) END AS BIGINT) AS gif_lossy
    FROM (SELECT *, pow(r, {BAND('1.0e0 / 3', '0.4e0', '0.5e0', '0.6e0')}) AS sz FROM (SELECT asset_id, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, fps, {LEVEL} AS ml, {_pick('asset_id', *_q('low', 'medium', 'high'))} AS cx, target_mb / (size_bytes / {MIB}) AS r FROM v_assets))""",
    "v_assets",
)
def _(spark, sf):
    a = V.v_assets(spark, sf).withColumns({
        "current_mb": F.col("size_bytes") / S.MIB, "colors": F.lit(240), "lossy": F.col("asset_id") % 80, "motion_level": S.motion_level(F.col("fps")),
        "complexity_level": pick(F.col("asset_id"), "low", "medium", "high"),
    })
    return P.gif_params(a).select("asset_id", "gif_w", "gif_h", "gif_fps", "gif_colors", "gif_lossy")


ALT = f"""SELECT asset_id, o, alternative, alt_w, alt_h, alt_kbps, alt_crf, alt_segments FROM (SELECT *, CAST(floor(width * 0.8e0) AS BIGINT) AS nw, CAST(floor(height * 0.8e0) AS BIGINT) AS nh FROM v_assets), LATERAL (
  SELECT 0 AS o, 'resolution_reduction' AS alternative, nw AS alt_w, nh AS alt_h, NULL::BIGINT AS alt_kbps, NULL::BIGINT AS alt_crf, NULL::BIGINT AS alt_segments WHERE fps > 26 AND nw >= 1280 AND nh >= 720
  UNION ALL SELECT 1, 'quality_adjustment', NULL, NULL, NULL, 28, NULL
  UNION ALL SELECT 2, 'bitrate_optimization', NULL, NULL, greatest(32, CAST(trunc((target_mb * 8 * {MIB} - duration_s * 64000) / duration_s / 1000) AS BIGINT)), NULL, NULL
  UNION ALL SELECT 3, 'segmentation', NULL, NULL, NULL, NULL, greatest(2, CAST(floor(duration_s / 120) AS BIGINT)) WHERE target_mb < size_bytes / {MIB} / 3 AND duration_s > 60)"""


@query(
    "alternatives",
    "SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY o) - 1 AS rank, alternative, alt_w, alt_h, alt_kbps, alt_crf, alt_segments FROM alt",
    "v_assets", alt=ALT,
)
def _(spark, sf):
    a = V.v_assets(spark, sf).withColumn("target_fps", F.lit(26.0))
    return P.alternatives(a).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "resolution_pick",
    f"""SELECT asset_id, CAST(CASE WHEN mb > 0 AND target_mb > mb * 2 THEN width WHEN fw > width THEN width - width % 2 ELSE fw END AS BIGINT) AS pick_w, CAST(CASE WHEN mb > 0 AND target_mb > mb * 2 THEN height WHEN fh > height THEN height - height % 2 ELSE fh END AS BIGINT) AS pick_h
    FROM (SELECT *, greatest(ow - ow % 2, CASE WHEN px > 1000000 THEN 720 ELSE 480 END) AS fw, greatest(oh - oh % 2, CASE WHEN px > 1000000 THEN 540 ELSE 360 END) AS fh FROM (
      SELECT *, greatest(CASE WHEN aff >= px THEN width ELSE CAST(floor(width * sc) AS BIGINT) END, 640, CAST(floor(width * 0.6e0) AS BIGINT)) AS ow, greatest(CASE WHEN aff >= px THEN height ELSE CAST(floor(height * sc) AS BIGINT) END, 480, CAST(floor(height * 0.6e0) AS BIGINT)) AS oh FROM (
        SELECT *, greatest(sqrt(aff / px), CASE WHEN px > 1000000 AND px <= 2000000 THEN 0.8e0 ELSE 0.6e0 END) AS sc FROM (SELECT *, CAST(floor(target_mb * 8 * {MIB} * 0.88e0 / duration_s * (1.0e0 / (0.025e0 * (complexity / 10 * 0.4e0 + 1))) / 24 * 0.35e0) AS BIGINT) AS aff FROM (
          SELECT asset_id, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, CAST(width AS BIGINT) * height AS px, size_bytes / {MIB} AS mb, target_mb * (1 + asset_id % 5) AS target_mb, duration_s, complexity FROM v_assets)))))""",
    "v_assets",
)
def _(spark, sf):
    a = V.v_assets(spark, sf).withColumn("target_mb", F.col("target_mb") * (F.col("asset_id") % 5 + 1))
    return P.pick_resolution(a).select("asset_id", "pick_w", "pick_h")


# ------------------------------------------------------------------ reports

SEV = lambda v, t, c: f"CASE WHEN {v} >= {c} THEN 'critical' WHEN {v} >= {t} * 2 THEN 'high' WHEN {v} >= {t} * 1.5e0 THEN 'medium' ELSE 'low' END"
FOUND = f"""SELECT 'slow_operation' AS kind, op_name, {SEV('avg_duration', 30, 120)} AS severity, avg_duration AS metric, CASE WHEN total_duration > 600 THEN 'high' WHEN total_duration > 180 THEN 'medium' ELSE 'low' END AS impact, n, max_duration / avg_duration AS variability, max_memory FROM st WHERE n >= 3 AND avg_duration > 30
  UNION ALL SELECT 'high_failure_rate', op_name, {SEV('(100 - success_rate)', 20, 50)}, success_rate, CASE WHEN success_rate < 50 THEN 'critical' WHEN success_rate < 70 THEN 'high' WHEN success_rate < 85 THEN 'medium' ELSE 'low' END, n, max_duration / avg_duration, max_memory FROM st WHERE n >= 3 AND success_rate < 80
  UNION ALL SELECT 'high_memory_usage', op_name, {SEV('avg_memory', 500, 1000)}, avg_memory, CASE WHEN max_memory > avg_memory * 3 OR avg_memory > 1000 THEN 'poor' WHEN avg_memory > 500 THEN 'moderate' ELSE 'good' END, n, max_duration / avg_duration, max_memory FROM st WHERE n >= 3 AND avg_memory > 500
  UNION ALL SELECT 'poor_cache_performance', NULL, {SEV('(30 - hit_rate)', 10, 30)}, hit_rate, CASE WHEN (80 - hit_rate) / 80 > 0.5e0 THEN 'high' ELSE 'medium' END, total_lookups, NULL, NULL FROM lk WHERE hit_rate < 30 AND total_lookups > 10"""
# The logs have durations around 50: the operation log is read with memory x4 and the lookups inverted, so that every rule fires.
OPS4 = "SELECT * REPLACE (memory_delta * 4 AS memory_delta, CASE op_name WHEN 'click' THEN 'quality_eval' WHEN 'view' THEN 'compression' WHEN 'error' THEN 'cache_read' ELSE op_name END AS op_name, CASE WHEN event_id_mod < 3 THEN false ELSE success END AS success) FROM (SELECT *, op_id % 8 AS event_id_mod FROM v_ops)"
REPORT = dict(ops4=OPS4, lookups=LOOKUPS.replace("success AS hit", "NOT success AS hit"), st=OP_STATS.replace("FROM v_ops", "FROM ops4"), lk=LOOKUP_STATS, found=FOUND)


def report_ops(spark, sf):
    ops = V.v_ops(spark, sf)
    name = F.when(F.col("op_name") == "click", "quality_eval").when(F.col("op_name") == "view", "compression").when(F.col("op_name") == "error", "cache_read").otherwise(F.col("op_name"))
    ok = F.when(F.col("op_id") % 8 < 3, False).otherwise(F.col("success"))
    return ops.withColumns({"memory_delta": F.col("memory_delta") * 4, "op_name": name, "success": ok})


def inverted_lookups(spark, sf):
    return lookups(spark, sf).withColumn("hit", ~F.col("hit"))


def found(spark, sf):
    return R.bottlenecks(A.op_stats(report_ops(spark, sf)), A.lookup_stats(inverted_lookups(spark, sf)))


@query("bottlenecks", "SELECT kind, op_name, severity, metric, impact, n FROM found ORDER BY 1, 2", "v_ops", "metric", **REPORT)
def _(spark, sf):
    return R.ranked(found(spark, sf)).select("kind", "op_name", "severity", "metric", "impact", "n")


@query("bottleneck_rules", "SELECT * FROM found", "v_ops", "metric variability max_memory", **REPORT)
def _(spark, sf):
    return found(spark, sf)


REC_RULES = (
    ("kind = 'slow_operation' AND contains(op, 'quality')", ("fast_quality_estimation", "quality_result_caching")),
    ("kind = 'slow_operation' AND contains(op, 'quality') AND metric > 60", ("evaluation_time_limits",)),
    ("kind = 'slow_operation' AND contains(op, 'compression')", ("optimize_encoder_parameters", "hardware_acceleration")),
    ("kind = 'slow_operation' AND contains(op, 'compression') AND variability > 2", ("investigate_compression_variability",)),
    ("kind = 'slow_operation' AND contains(op, 'cache')", ("review_cache_implementation", "cache_size_optimization")),
    ("kind = 'slow_operation' AND metric > 120", ("split_into_parallel_tasks",)),
    ("kind = 'slow_operation' AND variability > 3", ("investigate_input_variability",)),
    ("kind = 'high_failure_rate' AND metric < 50", ("immediate_investigation", "better_error_handling")),
    ("kind = 'high_failure_rate' AND contains(op, 'quality')", ("fallback_quality_estimation", "quality_input_validation")),
    ("kind = 'high_failure_rate' AND contains(op, 'compression')", ("parameter_validation_and_fallback", "progressive_quality_reduction")),
    ("kind = 'high_failure_rate'", ("retry_with_backoff", "input_validation_and_recovery")),
    ("kind = 'high_memory_usage' AND metric > 1000", ("memory_optimization", "process_in_chunks")),
    ("kind = 'high_memory_usage' AND max_memory > metric * 3", ("investigate_memory_leaks",)),
    ("kind = 'high_memory_usage' AND contains(op, 'quality')", ("reduce_quality_memory", "sampling_based_assessment")),
    ("kind = 'high_memory_usage'", ("memory_monitoring_and_cleanup", "memory_efficient_structures")),
    ("kind = 'poor_cache_performance' AND metric < 20", ("review_cache_keys", "increase_cache_size")),
    ("kind = 'poor_cache_performance' AND metric >= 20 AND metric < 50", ("cache_key_optimization",)),
    ("kind = 'poor_cache_performance' AND n > 100", ("cache_performance_optimization",)),
    ("kind = 'poor_cache_performance'", ("cache_warming", "review_eviction_policy")),
)


@query(
    "recommendations",
    "SELECT kind, op_name, severity, advice, CASE WHEN advice = 'hardware_acceleration' OR (advice = 'evaluation_time_limits' AND severity IN ('critical', 'high')) THEN 'high' WHEN contains(advice, 'optimization') OR contains(advice, 'fallback') THEN 'medium' ELSE 'low' END AS expected_impact FROM (SELECT *, unnest("
    + _cat(*[_sayl(t, *c) for t, c in REC_RULES]) + ") AS advice FROM (SELECT *, lower(coalesce(op_name, '')) AS op FROM found))",
    "v_ops", **REPORT,
)
def _(spark, sf):
    return R.recommend(found(spark, sf)).select("kind", "op_name", "severity", "advice", "expected_impact")


POTENTIAL = """SELECT reliability_gain, memory_saved_mb, bottlenecks, critical, least(s, 3.0e0) AS speedup, CASE WHEN s > 2 OR reliability_gain > 30 OR memory_saved_mb > 300 THEN 'high' WHEN s > 1.5e0 OR reliability_gain > 15 OR memory_saved_mb > 150 THEN 'medium' WHEN s > 1.2e0 OR reliability_gain > 5 OR memory_saved_mb > 50 THEN 'low' ELSE 'minimal' END AS overall
    FROM (SELECT coalesce(product(CASE WHEN kind = 'slow_operation' AND metric > 60 THEN 1.5e0 WHEN kind = 'slow_operation' AND metric > 30 THEN 1.3e0 WHEN kind = 'poor_cache_performance' AND metric < 30 THEN 2.0e0 END), 1) AS s,
      coalesce(max(CASE WHEN kind = 'high_failure_rate' THEN greatest(0.0e0, least(95 - metric, 50.0e0)) END), 0) AS reliability_gain, coalesce(max(CASE WHEN kind = 'high_memory_usage' THEN least(metric * 0.5e0, 500.0e0) END), 0) AS memory_saved_mb,
      count(*) AS bottlenecks, count(*) FILTER (severity = 'critical') AS critical FROM found)"""


@query(
    "potential",
    POTENTIAL,
    "v_ops", "reliability_gain memory_saved_mb speedup", **REPORT,
)
def _(spark, sf):
    return R.potential(found(spark, sf))


def whole_report(spark, sf):
    now = F.lit("2024-01-31").cast("timestamp")
    sessions = V.v_sessions(spark, sf).withColumn("start_ts", F.col("start_ts") + F.expr("INTERVAL 24 YEARS"))
    return R.build_report(sessions, report_ops(spark, sf), inverted_lookups(spark, sf), now)


@query("report_export")
def _(spark, sf):
    report = whole_report(spark, sf)
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))


@query(
    "report_rows",
    """SELECT section, item, metric, value FROM (
      SELECT 'summary' AS section, NULL::VARCHAR AS item, metric, value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM summary) ON * INTO NAME metric VALUE value)
      UNION ALL SELECT 'daily', item, metric, value FROM (UNPIVOT (SELECT item, COLUMNS(* EXCLUDE (item))::DOUBLE FROM daily) ON COLUMNS(* EXCLUDE (item)) INTO NAME metric VALUE value)
      UNION ALL SELECT 'platforms', item, metric, value FROM (UNPIVOT (SELECT item, COLUMNS(* EXCLUDE (item))::DOUBLE FROM platforms) ON COLUMNS(* EXCLUDE (item)) INTO NAME metric VALUE value)
      UNION ALL SELECT 'bottlenecks', concat_ws('/', kind, op_name), 'metric', metric FROM found
      UNION ALL SELECT 'potential', NULL, metric, value FROM (UNPIVOT (SELECT COLUMNS(* EXCLUDE (overall))::DOUBLE FROM potential) ON * INTO NAME metric VALUE value))
    WHERE value IS NOT NULL""",
    "v_ops v_sessions", "value", **REPORT, summary=SESSION_SUMMARY, potential=POTENTIAL,
    daily="""SELECT CAST(CAST(start_ts + INTERVAL 24 YEAR AS DATE) AS VARCHAR) AS item, count(*) AS sessions, coalesce(avg(nullif(duration, 0)), 0) AS avg_duration, coalesce(sum(duration), 0) AS total_time,
      100.0e0 * count(*) FILTER (success) / count(*) AS success_rate FROM v_sessions WHERE success GROUP BY 1""",
    platforms="""SELECT coalesce(platform, 'unknown') AS item, count(*) AS sessions, coalesce(avg(nullif(duration, 0)), 0) AS avg_duration,
      coalesce(avg(CASE WHEN final_mb <> 0 AND target_mb > 0 THEN final_mb / target_mb * 100 END), 0) AS avg_utilisation, 100.0e0 * count(*) FILTER (success) / count(*) AS success_rate
      FROM v_sessions WHERE success GROUP BY 1""",
)
def _(spark, sf):
    items = {"summary": (), "daily": ("day",), "platforms": ("platform",), "bottlenecks": ("kind", "op_name"), "potential": ()}
    return R.report_rows(whole_report(spark, sf), items).drop("report_ts")


ROUTE_NEAR = dict(**DEC, runs=RUNS.format(us=60 * 1000000))


@query(
    "eval_router",
    """SELECT request_id, session_id, asset_id, reason, CASE WHEN reason IN ('prediction_skip', 'high_risk_prediction') THEN 'prediction' WHEN reason IS NOT NULL THEN 'skipped' WHEN confidence > 0.8e0 AND eval_cost_s > 120 THEN 'ssim_only' ELSE 'combined' END AS method,
      CASE WHEN reason IS NULL THEN greatest(300, least(900, CAST(floor(duration_s * 2.5e0 * CASE WHEN height >= 1080 THEN 2.0e0 WHEN height >= 720 THEN 1.5e0 WHEN height >= 480 THEN 1.2e0 ELSE 1.0e0 END) AS BIGINT))) END AS timeout_s,
      CASE WHEN reason IN ('prediction_skip', 'high_risk_prediction') THEN coalesce(pred_vmaf >= 80, false) AND coalesce(pred_ssim >= 0.94e0, false) END AS passes
    FROM (SELECT q.*, p.confidence, p.eval_cost_s, p.pred_vmaf, p.pred_ssim, CASE WHEN coalesce(disabled, false) THEN 'frequency_limit_expensive_evaluations_disabled' WHEN coalesce(attempt_no, 0) >= 3 THEN 'frequency_limit_max_attempts_reached' WHEN coalesce(consecutive_failures, 0) >= 2 THEN 'frequency_limit_consecutive_failures'
        WHEN coalesce(total_time, 0) >= 300 THEN 'frequency_limit_time_budget_exceeded' WHEN coalesce(recent_failures, 0) >= 2 THEN 'frequency_limit_recent_failures' WHEN 300 - coalesce(total_time, 0) < 30 THEN 'insufficient_time_budget' WHEN p.skip THEN 'prediction_skip' WHEN len(risk_factors) >= 3 THEN 'high_risk_prediction' END AS reason
      FROM (SELECT o_orderkey AS request_id, o_custkey AS session_id, asset_id, duration_s, height FROM orders JOIN v_assets ON asset_id = o_orderkey % (SELECT max(asset_id) + 1 FROM v_assets)) q
      LEFT JOIN (SELECT session_id, arg_max(attempt_no, attempt_no) AS attempt_no, arg_max(consecutive_failures, attempt_no) AS consecutive_failures, arg_max(total_time, attempt_no) AS total_time, arg_max(recent_failures, attempt_no) AS recent_failures, bool_or(consecutive_failures >= 2) AS disabled FROM runs GROUP BY session_id) s USING (session_id)
      LEFT JOIN decision p USING (asset_id))""",
    "v_assets v_encodes v_attempts", **ROUTE_NEAR,
)
def _(spark, sf):
    assets = V.v_assets(spark, sf)
    last = assets.agg(F.max("asset_id") + 1).scalar()
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("session_id"), (F.col("o_orderkey") % last).alias("asset_id"))
    requests = o.join(assets.select("asset_id", "duration_s", "height"), "asset_id")
    state = RT.limiter_state(W.failure_runs(V.v_attempts(spark, sf)))
    pred = PR.predict_decision(V.spread(chars(spark, sf), "asset_id"), history(spark, sf), threshold=0.7).select(
        "asset_id", "pred_vmaf", "pred_ssim", "confidence", "skip", "eval_cost_s", "risk_factors")
    return RT.route_evals(requests, state, pred)
