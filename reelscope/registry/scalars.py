"""Queries for the scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.functions import constants as K, scalars as S
from reelscope.registry.base import query
from reelscope.registry.sqlviews import _pick, _q
from reelscope.sources import views as V
from reelscope.sources.views import pick

MIB = "1048576.0e0"

LEVEL = "CASE WHEN fps >= 50 THEN 'high' WHEN fps >= 30 THEN 'medium' ELSE 'low' END"
RATIO = f"CASE WHEN size_bytes > 0 THEN size_bytes / {MIB} / greatest(target_mb, 0.1e0) ELSE 1.0e0 END"

RATES = ("30000/1001", "30/1", "", "0/0", "abc", "29.97", "24000/1001", "60")


@query(
    "parse_fps",
    f"""SELECT asset_id, rate, coalesce(CASE WHEN contains(rate, '/')
      THEN CASE WHEN TRY_CAST(split_part(rate, '/', 2) AS BIGINT) <> 0 THEN TRY_CAST(split_part(rate, '/', 1) AS BIGINT) / TRY_CAST(split_part(rate, '/', 2) AS BIGINT) END
      ELSE TRY_CAST(rate AS DOUBLE) END, 30.0e0) AS fps
    FROM (SELECT p_partkey AS asset_id, {_pick('p_partkey', *_q(*RATES))} AS rate FROM part)""",
    rounds="fps",
)
def _(spark, sf):
    part = V.table(spark, sf, "part").select(F.col("p_partkey").alias("asset_id"), pick(F.col("p_partkey"), *RATES).alias("rate"))
    return part.withColumn("fps", S.parse_fps(F.col("rate")))


@query(
    "bits_per_pixel",
    """SELECT asset_id, CASE WHEN kbps > 0 AND fps > 0 THEN kbps * 1000.0e0 / (width * height * fps) ELSE 0.0e0 END AS bpp,
      kbps * 1000.0e0 / (greatest(1, width * height) * greatest(1.0e0, fps)) >= 0.023e0 AS meets_min_bpp,
      CASE WHEN kbps > 0 AND fps > 0 THEN kbps * 1000.0e0 / (width * height * fps) ELSE 0.0e0 END >= 0.012e0 AS acceptable,
      CASE WHEN kbps > 0 AND fps > 0 THEN kbps * 1000.0e0 / (width * height * fps) ELSE 0.0e0 END >= 0.018e0 AS recommended,
      greatest(500, least(8000, CAST(floor(width * height * fps * 0.15e0 / 1000) AS BIGINT))) AS safe_cap_kbps
    FROM (SELECT asset_id, width, height, fps, bitrate // 1000 AS kbps FROM v_assets)""",
    "v_assets", "bpp",
)
def _(spark, sf):
    assets = V.v_assets(spark, sf).withColumn("kbps", S.whole(F.col("bitrate") / 1000))
    return S.with_bpp(assets).select("asset_id", "bpp", "meets_min_bpp", "acceptable", "recommended", "safe_cap_kbps")


@query(
    "size_bitrate",
    f"""SELECT *, (video_kbps + audio_kbps) * 1000 * duration_s / (8 * {MIB}) AS required_mb FROM (
      SELECT asset_id, duration_s, audio_kbps, CAST(trunc(greatest(target_mb * 8 * {MIB} / greatest(duration_s, 1.0e0) / 1000 - audio_kbps, 64.0e0)) AS BIGINT) AS video_kbps
      FROM v_assets)""",
    "v_assets", "duration_s required_mb",
)
def _(spark, sf):
    a = V.v_assets(spark, sf).select(
        "asset_id", "duration_s", "audio_kbps",
        S.target_kbps(F.col("target_mb"), F.col("duration_s"), F.col("audio_kbps")).alias("video_kbps"),
    )
    return a.withColumn("required_mb", S.required_mb(F.col("video_kbps"), F.col("duration_s"), F.col("audio_kbps")))


@query(
    "content_scores",
    f"""SELECT asset_id, greatest(0.0e0, least(10.0e0, log10(width * height) / 6 * 10 * 0.4e0
        + CASE WHEN bitrate > 0 THEN least(bitrate / (width * height * 3.0e0) * 3, 10.0e0) ELSE 5.0e0 END * 0.6e0)) AS content_complexity,
      {LEVEL} AS motion_level, greatest(1, CAST(floor(duration_s / 4) AS BIGINT)) AS scene_estimate
    FROM v_assets""",
    "v_assets", "content_complexity",
)
def _(spark, sf):
    return S.with_content_scores(V.v_assets(spark, sf)).select("asset_id", "content_complexity", "motion_level", "scene_estimate")


@query(
    "audio_budget",
    """SELECT asset_id, CAST(CASE WHEN wanted >= 160 THEN least(192, audio_kbps) WHEN wanted >= 112 THEN least(128, audio_kbps)
        WHEN wanted >= 80 THEN least(96, audio_kbps) WHEN wanted >= 56 THEN 64 WHEN wanted >= 40 THEN 48 ELSE 32 END AS BIGINT) AS audio_out
    FROM (SELECT asset_id, audio_kbps, least(CAST(audio_kbps AS DOUBLE), target_mb * 8 * 1024 / greatest(duration_s, 1.0e0) * 0.12e0) AS wanted FROM v_assets)""",
    "v_assets",
)
def _(spark, sf):
    return V.v_assets(spark, sf).select(
        "asset_id", S.audio_kbps(F.col("audio_kbps"), F.col("target_mb"), F.col("duration_s")).alias("audio_out")
    )


@query(
    "fps_policy",
    """SELECT asset_id, greatest(base, 20.0e0) AS quality_first,
      CASE WHEN base * 0.8e0 >= 20 THEN base * 0.8e0 WHEN base * 0.6e0 >= 20 THEN base * 0.6e0 WHEN base * 0.5e0 >= 20 THEN base * 0.5e0 ELSE 20.0e0 END AS size_first,
      greatest(base * CASE WHEN ratio > 10 THEN 0.6e0 WHEN ratio > 5 THEN 0.8e0 ELSE 0.9e0 END, 20.0e0) AS balanced,
      greatest(20.0e0, least(60.0e0, CASE WHEN ratio > 15 THEN greatest(agg * 0.6e0, 20.0e0) ELSE agg END)) AS encoder_aggressive
    FROM (SELECT *, CASE WHEN ratio > 10 THEN least(base * 0.5e0, 24.0e0) WHEN ratio > 5 THEN least(base * 0.7e0, 30.0e0) ELSE base END AS agg
      FROM (SELECT asset_id, ratio, CASE level WHEN 'high' THEN least(fps, 60.0e0) WHEN 'low' THEN 24.0e0 ELSE 30.0e0 END AS base
        FROM (SELECT asset_id, fps, """ + LEVEL + " AS level, " + RATIO + """ AS ratio FROM v_assets)))""",
    "v_assets", "quality_first size_first balanced encoder_aggressive",
)
def _(spark, sf):
    a = V.v_assets(spark, sf)
    level = S.motion_level(F.col("fps"))
    ratio = S.compression_ratio(F.col("size_bytes"), F.col("target_mb"))
    base = S.motion_fps(F.col("fps"), level)
    return a.select(
        "asset_id",
        *[S.strategy_fps(base, ratio, s).alias(s) for s in ("quality_first", "size_first", "balanced")],
        S.encoder_fps(F.col("fps"), level, ratio, "aggressive").alias("encoder_aggressive"),
    )


@query(
    "fps_impact",
    """SELECT asset_id, target_fps, (fps - target_fps) / fps * 100 AS reduction_percent,
      CASE WHEN (fps - target_fps) / fps * 100 <= 20 THEN 'minimal' WHEN (fps - target_fps) / fps * 100 <= 40 THEN 'moderate'
        WHEN (fps - target_fps) / fps * 100 <= 60 THEN 'significant' ELSE 'severe' END AS impact_level,
      target_fps >= 20 AS respects_minimum
    FROM (SELECT asset_id, fps, greatest(CASE """ + LEVEL + """ WHEN 'high' THEN least(fps, 60.0e0) WHEN 'low' THEN 24.0e0 ELSE 30.0e0 END
      * CASE WHEN """ + RATIO + " > 10 THEN 0.6e0 WHEN " + RATIO + """ > 5 THEN 0.8e0 ELSE 0.9e0 END, 20.0e0) AS target_fps FROM v_assets)""",
    "v_assets", "target_fps reduction_percent",
)
def _(spark, sf):
    out = S.with_fps_impact(S.with_target_fps(V.v_assets(spark, sf)))
    return out.select("asset_id", "target_fps", "reduction_percent", "impact_level", "respects_minimum")


@query(
    "size_efficiency",
    """SELECT job_id, step, CASE WHEN size_mb > 10 THEN greatest(0.0e0, 100 - (size_mb - 10) / 10 * 200)
      ELSE greatest(0.0e0, least(100.0e0, CASE WHEN size_mb / 10 BETWEEN 0.85e0 AND 0.98e0 THEN 100.0e0 WHEN size_mb / 10 < 0.85e0 THEN size_mb / 10 / 0.85e0 * 30 + 70 ELSE 95.0e0 END * 0.6e0
        + CASE WHEN size_mb / orig < 0.3e0 THEN 100.0e0 WHEN size_mb / orig < 0.5e0 THEN 90.0e0 WHEN size_mb / orig < 0.7e0 THEN 75.0e0 ELSE 60.0e0 END * 0.4e0)) END AS efficiency
    FROM (SELECT *, 12 + crf AS orig FROM v_encodes)""",
    "v_encodes", "efficiency",
)
def _(spark, sf):
    e = V.v_encodes(spark, sf)
    return e.select("job_id", "step", S.size_efficiency(F.col("crf") + 12, F.col("size_mb"), F.lit(10.0)).alias("efficiency"))


PAIRS_SQL = """SELECT job_id, step, asset_id, floor(size_mb * 1000) AS size_bytes, crf % 13 <> 0 AS readable, crf % 11 <> 0 AS has_video,
  CAST(floor(size_mb) AS BIGINT) AS frame_count, crf % 17 <> 0 AS exists_, duration_s AS orig_duration,
  CASE WHEN crf <> 21 THEN duration_s * (0.1e0 + vmaf / 70) END AS comp_duration,
  'out/clip' || CASE CAST(step AS BIGINT) % 3 WHEN 0 THEN '_segment_1.gif' WHEN 1 THEN '.gif' ELSE '.mp4' END AS comp_path
FROM v_encodes JOIN v_assets USING (asset_id)"""


def pairs(spark, sf):
    enc = V.v_encodes(spark, sf)
    assets = V.v_assets(spark, sf).select("asset_id", "duration_s")
    return enc.join(assets, "asset_id").select(
        "job_id", "step", "asset_id", F.floor(F.col("size_mb") * 1000).alias("size_bytes"),
        (F.col("crf") % 13 != 0).alias("readable"), (F.col("crf") % 11 != 0).alias("has_video"),
        F.floor("size_mb").alias("frame_count"), (F.col("crf") % 17 != 0).alias("exists"),
        F.col("duration_s").alias("orig_duration"),
        F.when(F.col("crf") != 21, F.col("duration_s") * (F.col("vmaf") / 70 + 0.1)).alias("comp_duration"),
        F.concat(F.lit("out/clip"), pick(F.col("step"), "_segment_1.gif", ".gif", ".mp4")).alias("comp_path"),
    )


@query(
    "tech_validity",
    """SELECT job_id, step, CASE WHEN NOT exists_ OR size_bytes = 0 THEN 0.0e0 ELSE greatest(0.0e0, least(100.0e0, 100 - CASE WHEN NOT readable THEN 30.0e0 ELSE
        CASE WHEN comp_duration IS NULL THEN 0.0e0
          WHEN (ends_with(comp_path, '.gif') OR contains(comp_path, '_segment_')) THEN CASE WHEN comp_duration / orig_duration < 0.2e0 OR comp_duration / orig_duration > 1.5e0 THEN 5.0e0 ELSE 0.0e0 END
          ELSE CASE WHEN comp_duration / orig_duration < 0.8e0 OR comp_duration / orig_duration > 1.2e0 THEN 15.0e0 ELSE 0.0e0 END END
        + CASE WHEN has_video THEN 0.0e0 ELSE 40.0e0 END + CASE WHEN frame_count < 5 THEN 20.0e0 ELSE 0.0e0 END END)) END AS tech_score
    FROM pairs""",
    "v_assets v_encodes", "tech_score", pairs=PAIRS_SQL,
)
def _(spark, sf):
    return S.tech_validity(pairs(spark, sf)).select("job_id", "step", "tech_score")


@query(
    "length_check",
    """SELECT job_id, step, reason AS length_reason, reason IS NULL AS length_ok FROM (
    SELECT job_id, step, CASE WHEN contains(comp_path, '_segment_') THEN NULL
      WHEN coalesce(comp_duration, 0) <= 0 THEN 'no_duration'
      WHEN comp_duration / orig_duration < CASE WHEN ends_with(comp_path, '.gif') THEN 0.3e0 ELSE 0.8e0 END THEN 'too_short'
      WHEN comp_duration / orig_duration > CASE WHEN ends_with(comp_path, '.gif') THEN 1.5e0 ELSE 1.25e0 END THEN 'too_long' END AS reason
    FROM pairs)""",
    "v_assets v_encodes", pairs=PAIRS_SQL,
)
def _(spark, sf):
    return S.length_check(pairs(spark, sf)).select("job_id", "step", "length_reason", "length_ok")


@query(
    "sanitize_names",
    r"""SELECT doc_id, CASE WHEN length(t) > 180 THEN coalesce(nullif(regexp_replace(substr(t, 1, 180), '[._ ]+$', ''), ''), 'segments_summary') ELSE t END AS safe_name
    FROM (SELECT doc_id, CASE WHEN t = '' THEN 'segments_summary' ELSE t END AS t FROM (
      SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        CASE WHEN s = '' THEN 'segments_summary' ELSE s END, '[\x00-\x1f]', '', 'g'), '[<>:"/\\|?*]|[^\x00-\x7f]', '_', 'g'), '^\s+|\s+$', '', 'g'), '^[._ ]+|[._ ]+$', '', 'g') AS t
      FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents)))""",
)
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", S.sanitize(F.col("text")).alias("safe_name"))


FOLDERS = ("/in/", "/in/clip_segments/", "/in/a/Segments old/", "/in/party/")
NAMES = ("%s.mp4", "%s_segment_03.gif", "%s_part_01.mp4", "%s partial.mp4", "%s split 2.mp4")


@query(
    "segment_predicate",
    r"""SELECT asset_id, path, regexp_matches(regexp_extract(lower(path), '^(.*)/[^/]*$', 1), 'segments')
      OR regexp_matches(regexp_replace(regexp_extract(lower(path), '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '(^|[^a-z0-9])(segment|part|split)([\s_-]*\d+)?($|[^a-z0-9])')
      OR regexp_matches(regexp_extract(lower(path), '([^/]*)$', 1), '_(segment|part)_\d+\.') AS is_segment
    FROM (SELECT p_partkey AS asset_id, """ + _pick("p_partkey", *_q(*FOLDERS)) + " || replace("
    + _pick("p_size", *_q(*NAMES)) + """, '%s', p_name) AS path FROM part)""",
)
def _(spark, sf):
    name = F.replace(pick(F.col("p_size"), *NAMES), F.lit("%s"), F.col("p_name"))
    path = F.concat(pick(F.col("p_partkey"), *FOLDERS), name)
    out = V.table(spark, sf, "part").select(F.col("p_partkey").alias("asset_id"), path.alias("path"))
    return out.withColumn("is_segment", S.is_segment(F.col("path")))


@query(
    "cache_key",
    """SELECT job_id, step, params_key, substr(content_hash, 1, 16) || '_' || params_key AS cache_key, content_hash FROM (
    SELECT job_id, step, sha256(codec || CAST(asset_id AS VARCHAR)) AS content_hash, substr(sha256('{"additional": null, "bitrate": ' || bitrate_kbps || ', "codec": "' || codec || '", "crf": ' || crf ||
      ', "fps": ' || CAST(fps AS VARCHAR) || ', "preset": "' || preset || '", "resolution": [' || width || ', ' || height || ']}'), 1, 16) AS params_key
    FROM v_encodes JOIN v_assets USING (asset_id))""",
    "v_assets v_encodes",
)
def _(spark, sf):
    enc = V.v_encodes(spark, sf).select("job_id", "step", "asset_id", F.col("bitrate_kbps").alias("bitrate"), "crf", "preset")
    assets = V.v_assets(spark, sf).select("asset_id", "codec", "fps", "width", "height")
    both = enc.join(assets, "asset_id").withColumn("content_hash", F.sha2(F.concat("codec", F.col("asset_id").cast("string")), 256))
    return S.with_cache_key(both).select("job_id", "step", "params_key", "cache_key", "content_hash")


ERROR_CASE = """CASE WHEN contains(low, 'bitrate') AND (contains(low, 'minimum') OR contains(low, 'floor')) THEN 'bitrate_validation'
  WHEN contains(low, 'segmentation') THEN 'segmentation' WHEN contains(low, 'encoder') OR contains(low, 'ffmpeg') THEN 'encoder'
  WHEN contains(low, 'timeout') OR contains(low, 'timed out') THEN 'timeout' WHEN contains(low, 'memory') THEN 'memory'
  WHEN contains(low, 'permission') OR contains(low, 'access denied') THEN 'permission'
  WHEN contains(low, 'network') OR contains(low, 'connection') THEN 'network'
  WHEN contains(low, 'invalid') OR contains(low, 'corrupt') OR contains(low, 'format') THEN 'file_validation' ELSE 'general' END"""
CLASSIFIED = f"""SELECT seq, message, path, category,
  CASE WHEN category IN ('timeout', 'network', 'file_validation') THEN 'warning' ELSE 'error' END AS severity,
  category NOT IN ('memory', 'permission', 'file_validation') AS retryable
FROM (SELECT *, {ERROR_CASE} AS category FROM (SELECT *, lower(message) AS low FROM v_errors))"""


@query("classify_errors", f"SELECT seq, category, severity, retryable FROM ({CLASSIFIED})", "v_errors")
def _(spark, sf):
    return S.classify_errors(V.v_errors(spark, sf)).select("seq", "category", "severity", "retryable")


STDERR = (
    "No such file: a.mp4", "Invalid argument given", "Permission denied", "no space left on device",
    "no option name near x", "error in libvmaf", "device busy", "request timeout", "out of memory",
    "ssim stats broken", "nothing known", "still nothing",
)
STDERR_CASES = (
    ("no such file", "file_not_found", "critical", False), ("invalid argument", "invalid_format", "critical", False),
    ("permission denied", "permission_error", "high", False), ("no space left", "disk_space", "high", False),
    ("no option name near", "vmaf_filter_parameter_error", "high", True), ("libvmaf", "vmaf_filter_error", "medium", True),
    ("device busy", "resource_busy", "medium", True), ("timeout", "network_error", "medium", True),
    ("out of memory", "memory_error", "high", True), ("ssim stats", "ssim_filter_error", "medium", True),
)


def _stderr_case(i: int, by_code: tuple, default: str) -> str:
    fmt = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    arms = " ".join(f"WHEN contains(low, '{c[0]}') THEN {fmt(c[i])}" for c in STDERR_CASES)
    return f"CASE {arms} WHEN returncode = 1 THEN {fmt(by_code[0])} WHEN returncode = 2 THEN {fmt(by_code[1])} ELSE {default} END"


@query(
    "classify_stderr",
    f"""SELECT *, category IN ('vmaf_filter_parameter_error', 'resource_busy', 'memory_error') AND attempt < 3 AS auto_recovery,
      retryable AND attempt < 3 AS retry_hint
    FROM (SELECT seq, returncode, attempt, {_stderr_case(1, ('generic_ffmpeg_error', 'invalid_arguments'), "'unknown_error'")} AS category,
      {_stderr_case(3, (True, False), 'true')} AS retryable, {_stderr_case(2, ('medium', 'high'), "'medium'")} AS severity,
      CASE {' '.join(f"WHEN contains(low, '{c[0]}') THEN '{c[0]}'" for c in STDERR_CASES)} END AS specific_error
      FROM (SELECT event_id AS seq, lower({_pick('k', *_q(*STDERR))}) AS low, k % 4 AS returncode, k % 3 + 1 AS attempt FROM v_events))""",
    "v_events",
)
def _(spark, sf):
    ev = V._events(spark, sf).select(
        F.col("event_id").alias("seq"), pick(F.col("k"), *STDERR).alias("text"),
        (F.col("k") % 4).alias("returncode"), (F.col("k") % 3 + 1).alias("attempt"),
    )
    return S.classify_stderr(ev).drop("text")


@query(
    "guardrail_flag",
    """SELECT asset_id, guardrail_candidate, guardrail_active,
      CASE WHEN guardrail_active THEN greatest(1.0e0, least(base * 0.5e0, 14.0e0)) ELSE base END AS guarded_fps,
      CASE WHEN guardrail_active THEN greatest(2, least(colors, 208, greatest(2, CAST(floor(colors * 0.7e0) AS BIGINT)))) ELSE colors END AS guarded_colors
    FROM (SELECT asset_id, duration_s >= 22.5e0 OR duration_s * fps >= 540 AS guardrail_candidate,
      duration_s >= 45 OR greatest(1.0e0, fps) * duration_s >= 900 AS guardrail_active, greatest(1.0e0, fps) AS base, greatest(2, least(256, colors)) AS colors
      FROM (SELECT asset_id, duration_s / 8 AS duration_s, fps / 2 AS fps, bitrate // 10000 AS colors FROM v_assets))""",
    "v_assets", "guarded_fps",
)
def _(spark, sf):
    a = V.v_assets(spark, sf).select(
        "asset_id", (F.col("duration_s") / 8).alias("duration_s"), (F.col("fps") / 2).alias("fps"),
        S.whole(F.col("bitrate") / 10000).alias("colors"),
    )
    return S.with_guardrail(a).select("asset_id", "guardrail_candidate", "guardrail_active", "guarded_fps", "guarded_colors")


@query(
    "gif_size_model",
    f"""SELECT asset_id, width * height * (fps * duration_s) * 0.5e0 * pow(colors / 256.0e0, 0.7e0) * (1 - lossy / 400.0e0) / {MIB} AS gif_mb,
      greatest(0.1e0, width * height * floor(duration_s * 20) * 0.5e0 * (1 - 60 / 150.0e0 * 0.4e0) / {MIB}) AS rough_mb,
      CASE WHEN width > 360 THEN floor(width * (360.0e0 / width)) * floor(height * (360.0e0 / width)) ELSE width * height END * (duration_s * fps) * 0.1e0 / {MIB} AS scaled_mb
    FROM (SELECT *, 32 * (1 + asset_id % 8) AS colors, asset_id % 200 AS lossy FROM v_assets)""",
    "v_assets", "gif_mb rough_mb scaled_mb", 4,
)
def _(spark, sf):
    a = V.v_assets(spark, sf).withColumn("colors", (F.col("asset_id") % 8 + 1) * 32).withColumn("lossy", F.col("asset_id") % 200)
    w, h, fps, dur = (F.col(c) for c in ("width", "height", "fps", "duration_s"))
    return a.select(
        "asset_id", S.gif_size_mb(w, h, fps, dur, F.col("colors"), F.col("lossy")).alias("gif_mb"),
        S.gif_size_rough_mb(w, h, dur).alias("rough_mb"), S.gif_size_scaled_mb(w, h, fps, dur).alias("scaled_mb"),
    )


@query(
    "param_audit",
    """SELECT job_id, step, unnest(list_filter([CASE WHEN fps < 20 THEN 'fps_below_minimum' END, CASE WHEN width < 1280 THEN 'width_below_minimum' END,
      CASE WHEN height < 720 THEN 'height_below_minimum' END, CASE WHEN bitrate_kbps < 15 THEN 'bitrate_below_encoder_minimums' END,
      CASE WHEN bpp < 0.02e0 THEN 'very_low_bpp' END, CASE WHEN bpp >= 0.02e0 AND bpp < 0.05e0 THEN 'low_bpp' END,
      CASE WHEN crf < 0 OR crf > 51 THEN 'invalid_crf' END, CASE WHEN crf > 35 AND crf <= 51 THEN 'high_crf' END,
      CASE WHEN preset NOT IN ('ultrafast','superfast','veryfast','faster','fast','medium','slow','slower','veryslow') THEN 'invalid_preset' END,
      CASE WHEN encoder NOT IN ('libx264','libx265','h264_nvenc','h264_amf','h264_qsv','h264_videotoolbox') THEN 'invalid_encoder' END], lambda x: x IS NOT NULL)) AS violation
    FROM (SELECT job_id, step, bitrate_kbps // 10 AS bitrate_kbps, (crf - 18) * 9 AS crf, encoder, fps, width, height,
      CASE preset WHEN 'slow' THEN 'placebo' ELSE preset END AS preset,
      (bitrate_kbps // 10) * 1000.0e0 / (width * height * fps) AS bpp FROM v_encodes JOIN v_assets USING (asset_id))""",
    "v_assets v_encodes",
)
def _(spark, sf):
    enc = V.v_encodes(spark, sf).select(
        "job_id", "step", "asset_id", S.whole(F.col("bitrate_kbps") / 10).alias("bitrate_kbps"),
        ((F.col("crf") - 18) * 9).alias("crf"), "encoder",
        F.when(F.col("preset") == "slow", "placebo").otherwise(F.col("preset")).alias("preset"),
    )
    both = enc.join(V.v_assets(spark, sf).select("asset_id", "fps", "width", "height"), "asset_id")
    return S.audit_params(both, ["job_id", "step"])


@query(
    "score_sanity",
    """SELECT job_id, step, CASE WHEN vmaf BETWEEN 0 AND 100 THEN vmaf END AS vmaf, CASE WHEN ssim BETWEEN 0 AND 1 THEN ssim END AS ssim,
      greatest(0.0e0, least(1.0e0, confidence)) AS confidence, coalesce(vmaf BETWEEN 0 AND 100 AND vmaf >= 80, false) AS vmaf_ok
    FROM (SELECT job_id, step, vmaf * 1.1e0 - 4 AS vmaf, ssim * 1.05e0 AS ssim, size_mb / 15 - 0.1e0 AS confidence FROM v_encodes)""",
    "v_encodes", "vmaf ssim confidence",
)
def _(spark, sf):
    e = V.v_encodes(spark, sf).select(
        "job_id", "step", (F.col("vmaf") * 1.1 - 4).alias("vmaf"), (F.col("ssim") * 1.05).alias("ssim"),
        (F.col("size_mb") / 15 - 0.1).alias("confidence"),
    )
    return S.clean_scores(e).withColumn("vmaf_ok", S.at_least(F.col("vmaf"), 80))


@query(
    "cache_ttl",
    """SELECT *, created_at + to_hours(CAST(ttl_hours AS BIGINT)) AS expires_at FROM (
    SELECT attempt_id, confidence, method, ts AS created_at, CAST(floor(CASE WHEN confidence > 0.9e0 THEN 2.0e0 WHEN confidence > 0.7e0 THEN 1.5e0 WHEN confidence > 0.5e0 THEN 1.0e0 ELSE 0.5e0 END
      * CASE method WHEN 'full' THEN 1.5e0 WHEN 'predicted' THEN 0.7e0 ELSE 1.0e0 END * 24) AS BIGINT) AS ttl_hours
    FROM (SELECT *, CASE eval_type WHEN 'vmaf' THEN 'full' WHEN 'ssim' THEN 'fast' ELSE 'predicted' END AS method FROM v_attempts))""",
    "v_attempts", "confidence",
)
def _(spark, sf):
    method = F.when(F.col("eval_type") == "vmaf", "full").when(F.col("eval_type") == "ssim", "fast").otherwise("predicted")
    a = V.v_attempts(spark, sf).select("attempt_id", "confidence", method.alias("method"), F.col("ts").alias("created_at"))
    return S.with_ttl(a)


@query(
    "resolution_mismatch",
    """SELECT asset_id, orig_w <> comp_w OR orig_h <> comp_h AS size_mismatch, abs(orig_w / orig_h - comp_w / comp_h) > 0.01e0 AS aspect_mismatch,
      CASE WHEN orig_w * orig_h <= comp_w * comp_h THEN orig_w ELSE comp_w END AS target_w,
      CASE WHEN orig_w * orig_h <= comp_w * comp_h THEN orig_h ELSE comp_h END AS target_h,
      CASE WHEN orig_w * orig_h <= comp_w * comp_h THEN 'original' ELSE 'compressed' END AS smaller
    FROM (SELECT asset_id, width AS orig_w, height AS orig_h, """ + _pick("asset_id", "1920", "1280", "640") + " AS comp_w, "
    + _pick("asset_id", "1080", "720", "480") + " AS comp_h FROM v_assets)",
    "v_assets",
)
def _(spark, sf):
    a = V.v_assets(spark, sf).select(
        "asset_id", F.col("width").alias("orig_w"), F.col("height").alias("orig_h"),
        pick(F.col("asset_id"), 1920, 1280, 640).alias("comp_w"), pick(F.col("asset_id"), 1080, 720, 480).alias("comp_h"),
    )
    return S.resolution_mismatch(a).drop("orig_w", "orig_h", "comp_w", "comp_h")


@query(
    "encode_time_model",
    """SELECT asset_id, duration_s * CASE preset WHEN 'fast' THEN 1.8e0 WHEN 'slow' THEN 5.0e0 WHEN 'veryslow' THEN 12.0e0 ELSE 3.0e0 END * (width * height / 2073600.0e0) AS encode_s,
      greatest(0.5e0, 1.0e0 - CASE WHEN width > 1920 OR height > 1080 THEN 0.1e0 ELSE 0.0e0 END - CASE WHEN preset = 'veryslow' THEN 0.05e0 ELSE 0.0e0 END) AS compatibility
    FROM (SELECT *, """ + _pick("asset_id", *_q("fast", "slow", "veryslow", "custom")) + " AS preset FROM v_assets)",
    "v_assets", "encode_s compatibility",
)
def _(spark, sf):
    preset = pick(F.col("asset_id"), "fast", "slow", "veryslow", "custom")
    return V.v_assets(spark, sf).select(
        "asset_id", S.encode_time(F.col("duration_s"), preset, F.col("width"), F.col("height")).alias("encode_s"),
        S.compatibility(F.col("width"), F.col("height"), preset).alias("compatibility"),
    )


@query(
    "utilisation",
    f"""SELECT job_id, step, ratio, CASE WHEN ratio > 1 THEN 'over' WHEN ratio >= 0.92e0 THEN 'in_range' ELSE 'under' END AS band
    FROM (SELECT job_id, step, floor(size_mb * {MIB}) / (10 * {MIB}) AS ratio FROM v_encodes)""",
    "v_encodes", "ratio",
)
def _(spark, sf):
    e = V.v_encodes(spark, sf)
    out = e.select("job_id", "step", S.utilisation(F.floor(F.col("size_mb") * S.MIB), F.lit(10.0)).alias("ratio"))
    return out.withColumn("band", S.utilisation_band(F.col("ratio")))


@query(
    "param_score",
    """SELECT job_id, step, greatest(0.0e0, least(10.0e0, 10.0e0 * (921600.0e0 / (width * height)) * greatest(0.0e0, (40 - crf) / 22.0e0)
        * least(bitrate_kbps * 1000.0e0 / (921600 * 24.0e0) / 0.03e0, 1.2e0) * greatest(24.0e0 / fps, 0.7e0))) AS heuristic,
      greatest(0.0e0, least(10.0e0, 5 + CASE WHEN size_mb / 10 <= 1 THEN size_mb / 10 * 2 ELSE -5.0e0 END
        + CASE preset WHEN 'fast' THEN 1.0e0 ELSE 2.0e0 END + CASE WHEN crf = 19 THEN 1.0e0 ELSE 0.0e0 END + (crf - 18) * 0.1e0)) AS priority_score
    FROM v_encodes JOIN v_assets USING (asset_id)""",
    "v_assets v_encodes", "heuristic priority_score",
)
def _(spark, sf):
    both = V.v_encodes(spark, sf).join(V.v_assets(spark, sf).select("asset_id", "width", "height", "fps"), "asset_id")
    px = S.pixels(F.col("width"), F.col("height"))
    bpp = S.bits_per_pixel(F.col("bitrate_kbps"), F.lit(1280), F.lit(720), F.lit(24.0))
    priority = F.when(F.col("preset") == "fast", "size").otherwise("balanced")
    return both.select(
        "job_id", "step", S.param_score(921600.0 / px, F.col("crf"), bpp, 24.0 / F.col("fps")).alias("heuristic"),
        S.priority_score(F.col("size_mb"), F.lit(10.0), priority, F.col("crf") == 19, F.col("crf") - 18).alias("priority_score"),
    )


@query(
    "media_valid",
    """SELECT asset_id, kind, reason AS invalid_reason, reason IS NULL AS valid FROM (
    SELECT asset_id, kind, CASE WHEN asset_id % 19 = 0 THEN 'missing' WHEN size_bytes = 0 THEN 'empty' WHEN size_bytes > 40 * 1048576 THEN 'too_large'
      WHEN kind = 'video' THEN CASE WHEN asset_id % 7 = 0 THEN 'no_video_stream' WHEN TRY_CAST(nb AS BIGINT) <= 0 THEN 'no_frames' WHEN TRY_CAST(nb AS BIGINT) IS NULL AND duration_s <= 0 THEN 'no_duration_or_frames' END
      ELSE CASE WHEN header NOT IN ('GIF87a', 'GIF89a') THEN 'bad_header' WHEN asset_id % 11 = 0 THEN 'missing_trailer' WHEN asset_id % 5 = 0 THEN 'not_animated' WHEN coalesce(TRY_CAST(nb AS BIGINT), 0) <= 0 THEN 'no_frames' END END AS reason
    FROM (SELECT asset_id, CASE WHEN asset_id % 2 = 0 THEN 'video' ELSE 'gif' END AS kind, CASE WHEN asset_id % 23 = 0 THEN 0 ELSE size_bytes END AS size_bytes,
      """ + _pick("asset_id", *_q("120", "N/A", "0", "77")) + " AS nb, CASE WHEN asset_id % 3 = 0 THEN 0.0e0 ELSE duration_s END AS duration_s, "
    + _pick("asset_id", *_q("GIF89a", "GIF87a", "RIFFxx")) + " AS header FROM v_assets))",
    "v_assets",
)
def _(spark, sf):
    key = F.col("asset_id")
    a = V.v_assets(spark, sf).select(
        "asset_id", F.when(key % 2 == 0, "video").otherwise("gif").alias("kind"), (key % 19 != 0).alias("exists"),
        F.when(key % 23 == 0, 0).otherwise(F.col("size_bytes")).alias("size_bytes"), (key % 7 != 0).alias("has_video"),
        pick(key, "120", "N/A", "0", "77").alias("nb_frames"),
        F.when(key % 3 == 0, 0.0).otherwise(F.col("duration_s")).alias("duration_s"),
        pick(key, "GIF89a", "GIF87a", "RIFFxx").alias("gif_header"), (key % 11 != 0).alias("gif_trailer"),
        (key % 5 != 0).alias("animated"),
    )
    return S.media_valid(a, 40.0).select("asset_id", "kind", "invalid_reason", "valid")
