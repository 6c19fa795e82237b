"""Scalar rules over one row of a catalogue: pure column expressions, no Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reelscope.functions import constants as K

MIB = float(K.MIB)


def lookup(key: Column, mapping: dict, default=None) -> Column:
    """A constant dictionary as a CASE expression (stays inside codegen, needs no join)."""
    out = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), mapping.items(), F.when(F.lit(False), None))
    return out.otherwise(F.lit(default))


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def whole(x: Column) -> Column:
    """Truncate towards zero to a long."""
    return x.cast("bigint")


def pixels(w: Column, h: Column) -> Column:
    return w.cast("bigint") * h.cast("bigint")


def even(x: Column) -> Column:
    return x - x % 2


def parse_fps(rate: Column) -> Column:
    """``30000/1001`` or ``29.97`` as a double; anything unusable becomes 30."""
    parts = F.split(F.trim(rate), "/")
    ratio = F.try_divide(
        F.get(parts, F.lit(0)).try_cast("bigint").cast("double"),
        F.get(parts, F.lit(1)).try_cast("bigint").cast("double"),
    )
    number = F.when(F.trim(rate) != "", F.trim(rate).try_cast("double"))
    return F.coalesce(F.when(rate.contains("/"), ratio).otherwise(number), F.lit(30.0))


def bits_per_pixel(kbps: Column, w: Column, h: Column, fps: Column) -> Column:
    usable = (kbps > 0) & (w > 0) & (h > 0) & (fps > 0)
    return F.when(usable, kbps * 1000.0 / (pixels(w, h) * fps)).otherwise(F.lit(0.0))


def safe_bitrate_cap(w: Column, h: Column, fps: Column) -> Column:
    return clamp(whole(pixels(w, h) * fps * 0.15 / 1000), 500, 8000).cast("bigint")


def with_bpp(df: DataFrame, kbps: str = "kbps", min_bpp: float = 0.023) -> DataFrame:
    w, h, fps, rate = F.col("width"), F.col("height"), F.col("fps"), F.col(kbps)
    floor_rate = rate * 1000.0 / (F.greatest(F.lit(1), pixels(w, h)) * F.greatest(F.lit(1.0), fps))
    return df.withColumns(
        {
            "bpp": bits_per_pixel(rate, w, h, fps),
            "meets_min_bpp": floor_rate >= min_bpp,
            "safe_cap_kbps": safe_bitrate_cap(w, h, fps),
        }
    ).withColumns({"acceptable": F.col("bpp") >= 0.012, "recommended": F.col("bpp") >= 0.018})


def target_kbps(size_mb: Column, duration: Column, audio_kbps: Column) -> Column:
    """Video kbps that fill ``size_mb`` (binary megabytes, 1000-bit kilobits), at least 64."""
    total = size_mb * 8 * MIB / F.greatest(duration, F.lit(1.0)) / 1000
    return whole(F.greatest(total - audio_kbps, F.lit(64.0)))


def required_mb(video_kbps: Column, duration: Column, audio_kbps: Column) -> Column:
    return (video_kbps + audio_kbps) * 1000 * duration / (8 * MIB)


def content_complexity(w: Column, h: Column, bitrate: Column) -> Column:
    px = pixels(w, h)
    by_rate = F.when(bitrate > 0, F.least(bitrate / (px * 3.0) * 3, F.lit(10.0))).otherwise(F.lit(5.0))
    return clamp(F.log10(px.cast("double")) / 6 * 10 * 0.4 + by_rate * 0.6, 0.0, 10.0)


def motion_level(fps: Column) -> Column:
    return F.when(fps >= 50, "high").when(fps >= 30, "medium").otherwise("low")


def scene_estimate(duration: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), whole(duration / 4))


def with_content_scores(assets: DataFrame) -> DataFrame:
    return assets.withColumns(
        {
            "content_complexity": content_complexity(F.col("width"), F.col("height"), F.col("bitrate")),
            "motion_level": motion_level(F.col("fps")),
            "scene_estimate": scene_estimate(F.col("duration_s")),
        }
    )


def audio_kbps(input_kbps: Column, size_mb: Column, duration: Column) -> Column:
    """Largest standard audio rate within 12 % of the bit budget and not above the input."""
    budget = size_mb * 8 * 1024 / F.greatest(duration, F.lit(1.0)) * 0.12
    wanted = F.least(input_kbps.cast("double"), budget)
    out = F.when(F.lit(False), F.lit(0))
    for floor, rate in K.AUDIO_STEPS:
        value = F.least(F.lit(rate), input_kbps) if rate >= 96 else F.lit(rate)
        out = out.when(wanted >= floor, value)
    return out.otherwise(F.lit(32)).cast("bigint")


def compression_ratio(size_bytes: Column, target_mb: Column) -> Column:
    size = size_bytes / MIB
    return F.when(size > 0, size / F.greatest(target_mb, F.lit(0.1))).otherwise(F.lit(1.0))


def motion_fps(fps: Column, level: Column) -> Column:
    return F.when(level == "high", F.least(fps, F.lit(60.0))).when(level == "low", 24.0).otherwise(30.0)


def strategy_fps(base: Column, ratio: Column, strategy: str, min_fps: float = K.MIN_FPS, steps=K.FPS_STEPS) -> Column:
    if strategy == "quality_first":
        wanted = base
    elif strategy == "size_first":
        kept = F.filter(F.array(*[base * s for s in steps]), lambda x: x >= min_fps)
        wanted = F.coalesce(F.get(kept, F.lit(0)), F.lit(min_fps))
    elif strategy in ("balanced", "aggressive"):
        wanted = base * F.when(ratio > 10, 0.6).when(ratio > 5, 0.8).otherwise(0.9)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return F.greatest(wanted, F.lit(min_fps))


def encoder_fps(fps: Column, level: Column, ratio: Column, strategy: str, min_fps: float = K.MIN_FPS) -> Column:
    base = motion_fps(fps, level)
    if strategy == "aggressive":
        base = (
            F.when(ratio > 10, F.least(base * 0.5, F.lit(24.0)))
            .when(ratio > 5, F.least(base * 0.7, F.lit(30.0)))
            .otherwise(base)
        )
    elif strategy == "quality":
        base = F.least(fps, F.lit(60.0))
    base = F.when(ratio > 15, F.greatest(base * 0.6, F.lit(min_fps))).otherwise(base)
    return clamp(base, min_fps, 60.0)


def with_target_fps(assets: DataFrame, strategy: str = "balanced", min_fps: float = K.MIN_FPS) -> DataFrame:
    level = motion_level(F.col("fps"))
    ratio = compression_ratio(F.col("size_bytes"), F.col("target_mb"))
    return assets.withColumn("target_fps", strategy_fps(motion_fps(F.col("fps"), level), ratio, strategy, min_fps))


def fps_reduction(original: Column, target: Column) -> Column:
    return F.when(original > 0, (original - target) / original * 100).otherwise(F.lit(0.0))


def with_fps_impact(df: DataFrame, original="fps", target="target_fps", min_fps: float = K.MIN_FPS) -> DataFrame:
    drop = fps_reduction(F.col(original), F.col(target))
    return df.withColumns(
        {
            "reduction_percent": drop,
            "impact_level": F.when(drop <= 20, "minimal").when(drop <= 40, "moderate")
            .when(drop <= 60, "significant").otherwise("severe"),
            "respects_minimum": F.col(target) >= min_fps,
        }
    )


def size_efficiency(original_mb: Column, compressed_mb: Column, target_mb: Column) -> Column:
    over = F.greatest(F.lit(0.0), 100 - (compressed_mb - target_mb) / target_mb * 200)
    used = compressed_mb / target_mb
    ratio = F.try_divide(compressed_mb, original_mb)
    use_score = (
        F.when((used >= 0.85) & (used <= 0.98), 100.0).when(used < 0.85, used / 0.85 * 30 + 70).otherwise(95.0)
    )
    ratio_score = F.when(ratio < 0.3, 100.0).when(ratio < 0.5, 90.0).when(ratio < 0.7, 75.0).otherwise(60.0)
    return F.when(compressed_mb > target_mb, over).otherwise(clamp(use_score * 0.6 + ratio_score * 0.4, 0.0, 100.0))


def tech_validity(pairs: DataFrame) -> DataFrame:
    """Score 0-100 of an output against its source.

    Needs: exists, size_bytes, readable, has_video, frame_count, orig_duration, comp_duration, comp_path.
    """
    path = F.lower("comp_path")
    lenient = path.endswith(".gif") | path.contains("_segment_")
    ratio = F.try_divide(F.col("comp_duration"), F.col("orig_duration"))
    has_ratio = F.col("comp_duration").isNotNull() & (F.col("orig_duration") > 0)
    length = (
        F.when(has_ratio & lenient & ((ratio < 0.2) | (ratio > 1.5)), 5.0)
        .when(has_ratio & ~lenient & ((ratio < 0.8) | (ratio > 1.2)), 15.0)
        .otherwise(0.0)
    )
    stream = F.when(F.coalesce("has_video", F.lit(False)), 0.0).otherwise(40.0)
    frames = F.when(F.coalesce(F.col("frame_count"), F.lit(0)) < 5, 20.0).otherwise(0.0)
    penalty = F.when(~F.col("readable"), F.lit(30.0)).otherwise(length + stream + frames)
    absent = ~F.col("exists") | (F.coalesce(F.col("size_bytes"), F.lit(0)) == 0)
    return pairs.withColumn("tech_score", F.when(absent, 0.0).otherwise(clamp(100 - penalty, 0.0, 100.0)))


def length_check(pairs: DataFrame) -> DataFrame:
    """``length_reason`` is null when the output's length is acceptable."""
    path = F.lower("comp_path")
    gif = path.endswith(".gif")
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    exempt = gif & (path.contains("_segment_") | folder.contains("_segments"))
    ratio = F.try_divide(F.col("comp_duration"), F.col("orig_duration"))
    low = F.when(gif, 0.30).otherwise(0.80)
    high = F.when(gif, 1.50).otherwise(1.25)
    reason = (
        F.when(exempt | F.col("orig_duration").isNull() | (F.col("orig_duration") <= 0), None)
        .when(F.coalesce(F.col("comp_duration"), F.lit(0.0)) <= 0, F.lit("no_duration"))
        .when(ratio < low, F.lit("too_short"))
        .when(ratio > high, F.lit("too_long"))
    )
    return pairs.withColumn("length_reason", reason).withColumn("length_ok", F.col("length_reason").isNull())


def sanitize(name: Column, fallback: str = "segments_summary", limit: int = 180) -> Column:
    """A file-system-safe base name."""
    # Each step uses the one before once (a text named twice is cleaned twice), and a run that does not end the text is tried at its start only.
    tail = lambda c, chars: F.regexp_replace(c, rf"(?<![{chars}])[{chars}]++\z", "")
    ends = lambda c, chars: tail(F.regexp_replace(c, f"^[{chars}]+", ""), chars)
    given = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(fallback))
    text = given(ends(F.coalesce(name, F.lit("")), r"\s"))
    text = F.regexp_replace(text, r"[\x00-\x1f]", "")
    text = F.regexp_replace(text, r'[<>:"/\\|?*]|[^\x00-\x7f]', "_")
    text = given(ends(ends(text, r"\s"), "._ "))
    cut = lambda t: F.when(F.length(t) > limit, given(tail(F.substring(t, 1, limit), "._ "))).otherwise(t)
    return F.get(F.transform(F.array(text), cut), F.lit(0))


def summary_name(folder: Column) -> Column:
    """Canonical summary file name of a segments folder path."""
    base = F.regexp_extract(folder, "([^/]*)/*$", 1)
    stem = F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    stem = F.regexp_replace(stem, "_segments$", "")
    return F.concat(F.lit("~"), sanitize(stem), F.lit("_comprehensive_summary.txt"))


def is_segment(path: Column) -> Column:
    low = F.lower(path)
    folder = F.regexp_extract(low, "^(.*)/[^/]*$", 1)
    name = F.regexp_extract(low, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(.)\.[^.]*$", "$1")
    return (
        folder.contains("segments")
        | stem.rlike(r"(^|[^a-z0-9])(segment|part|split)([\s_-]*\d+)?($|[^a-z0-9])")
        | name.rlike(r"_(segment|part)_\d+\.")
    )


def json_text(value: Column) -> Column:
    """A nullable string as a JSON string literal."""
    escaped = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\\\\\"), '"', r'\\\\"')
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def json_number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def params_json(codec, bitrate, width, height, fps, preset, crf) -> Column:
    """Canonical JSON of encode settings: sorted keys, one space after separators."""
    size = F.when(
        width.isNotNull() & height.isNotNull(),
        F.concat(F.lit("["), width.cast("string"), F.lit(", "), height.cast("string"), F.lit("]")),
    ).otherwise(F.lit("null"))
    return F.concat(
        F.lit('{"additional": null, "bitrate": '), json_number(bitrate),
        F.lit(', "codec": '), json_text(codec),
        F.lit(', "crf": '), json_number(crf),
        F.lit(', "fps": '), json_number(fps),
        F.lit(', "preset": '), json_text(preset),
        F.lit(', "resolution": '), size, F.lit("}"),
    )


def with_cache_key(df: DataFrame) -> DataFrame:
    """Add ``params_key`` and ``cache_key``; equal inputs always give equal keys."""
    params = params_json(*[F.col(c) for c in ("codec", "bitrate", "width", "height", "fps", "preset", "crf")])
    key = F.substring(F.sha2(params, 256), 1, 16)
    return df.withColumn("params_key", key).withColumn(
        "cache_key", F.concat_ws("_", F.substring("content_hash", 1, 16), "params_key")
    )


def metadata_hash(*columns: str) -> Column:
    """md5 of the named columns as JSON in the given order."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def classify_errors(df: DataFrame, message: str = "message") -> DataFrame:
    low = F.lower(F.col(message))
    picked = F.when(F.lit(False), F.struct(*_named(K.ERROR_DEFAULT)))
    for category, severity, retryable, groups in K.ERROR_RULES:
        test = reduce(
            lambda a, b: a & b, [reduce(lambda a, b: a | b, [low.contains(w) for w in g]) for g in groups]
        )
        picked = picked.when(test, F.struct(*_named((category, severity, retryable))))
    picked = picked.otherwise(F.struct(*_named(K.ERROR_DEFAULT)))
    return df.withColumn("_e", picked).select("*", "_e.category", "_e.severity", "_e.retryable").drop("_e")


def _named(values, names=("category", "severity", "retryable")):
    return [F.lit(v).alias(n) for v, n in zip(values, names)]


def classify_stderr(df: DataFrame, text: str = "text", code: str = "returncode", attempt: str = "attempt") -> DataFrame:
    """Evaluator output to category, retry flag, severity and the literal that matched."""
    low = F.lower(F.col(text))
    names = ("category", "retryable", "severity", "specific_error")
    none = F.lit(None).cast("string").alias("specific_error")
    picked = F.when(F.lit(False), F.struct(*_named((*K.STDERR_UNKNOWN, ""), names)))
    for category, retryable, severity, literals in K.STDERR_RULES:
        for literal in literals:
            picked = picked.when(low.contains(literal), F.struct(*_named((category, retryable, severity, literal), names)))
    for returncode, row in K.STDERR_BY_RETURNCODE.items():
        picked = picked.when(F.col(code) == returncode, F.struct(*_named(row, names[:3]), none))
    picked = picked.otherwise(F.struct(*_named(K.STDERR_UNKNOWN, names[:3]), none))
    out = df.withColumn("_e", picked).select("*", *[F.col(f"_e.{n}").alias(n) for n in names]).drop("_e")
    auto = F.col("category").isin(*K.AUTO_RECOVERABLE) & (F.col(attempt) < 3)
    return out.withColumn("auto_recovery", auto).withColumn("retry_hint", F.col("retryable") & (F.col(attempt) < 3))


def hardware_family(text: Column, code: Column) -> Column:
    """Which accelerator an encoder failure points to; null when it is not a hardware failure."""
    low = F.lower(text)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for family, words in K.HARDWARE_WORDS.items():
        out = out.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(family))
    return out.when(code.isin(*K.HARDWARE_CODES), F.lit("unknown"))


def clamp_colors(x: Column) -> Column:
    return F.coalesce(clamp(x.cast("bigint"), 2, 256), F.lit(256)).cast("bigint")


def with_guardrail(df: DataFrame, cfg: dict = K.GIF_GUARDRAIL) -> DataFrame:
    """Long-clip guardrail: whether a clip is a candidate, whether it trips, and the capped settings."""
    duration = F.coalesce(F.col("duration_s"), F.lit(0.0))
    rate = F.coalesce(F.nullif(F.col("fps"), F.lit(0.0)), F.lit(cfg["palette_fps_cap"]))
    frames = duration * F.greatest(rate, F.lit(0.0))
    base = F.greatest(F.lit(1.0), F.coalesce(F.nullif(F.col("fps"), F.lit(0.0)), F.lit(20.0)))
    colors = clamp_colors(F.col("colors"))
    trips = (duration >= cfg["duration_seconds"]) | (base * duration >= cfg["frame_budget"])
    capped_fps = F.greatest(F.lit(1.0), F.least(base * cfg["fps_multiplier"], F.lit(cfg["palette_fps_cap"])))
    capped_colors = F.greatest(
        F.lit(2).cast("bigint"),
        F.least(colors, F.lit(cfg["palette_max_colors"]).cast("bigint"),
                F.greatest(F.lit(2).cast("bigint"), whole(colors * cfg["color_multiplier"]))),
    )
    return df.withColumns(
        {
            "guardrail_candidate": (duration >= cfg["duration_seconds"] * cfg["segment_duration_ratio"])
            | (frames >= cfg["frame_budget"] * cfg["segment_frame_budget_ratio"]),
            "guardrail_active": trips,
            "guarded_fps": F.when(trips, capped_fps).otherwise(base),
            "guarded_colors": F.when(trips, capped_colors).otherwise(colors),
        }
    )


def gif_size_mb(w: Column, h: Column, fps: Column, duration: Column, colors: Column, lossy: Column) -> Column:
    raw = pixels(w, h) * (fps * duration) * 0.5
    return raw * F.pow(colors / 256.0, F.lit(0.7)) * (1 - lossy / 400.0) / MIB


def gif_size_rough_mb(w: Column, h: Column, duration: Column, fps=20, colors=256, lossy=60) -> Column:
    """Cruder estimate with fixed rate, palette and loss, at least 0.1 MB."""
    h = F.when(h == -1, w).otherwise(h)
    raw = pixels(w, h) * whole(duration * fps) * (colors / 256.0 * 0.5) * (1.0 - lossy / 150.0 * 0.4)
    return F.greatest(F.lit(0.1), raw / MIB)


def gif_size_scaled_mb(w: Column, h: Column, fps: Column, duration: Column, target_width: int = 360) -> Column:
    """Cruder estimate after scaling to ``target_width``, a tenth of a byte per pixel."""
    scale = F.lit(float(target_width)) / w
    sw = F.when(w > target_width, whole(w * scale)).otherwise(w.cast("bigint"))
    sh = F.when(w > target_width, whole(h * scale)).otherwise(h.cast("bigint"))
    return sw * sh * (duration * fps) * 0.1 / MIB


def audit_params(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per broken rule; columns checked: fps, bitrate_kbps, width, height, crf, preset, encoder."""
    fps, rate, crf = F.col("fps"), F.col("bitrate_kbps"), F.col("crf")
    px = pixels(F.col("width"), F.col("height")) * fps
    bpp = F.try_divide(rate * 1000.0, px)
    rules = (
        ("fps_below_minimum", fps < K.MIN_FPS),
        ("width_below_minimum", F.col("width") < K.MIN_WIDTH),
        ("height_below_minimum", F.col("height") < K.MIN_HEIGHT),
        ("bitrate_below_encoder_minimums", rate < max(K.ENCODER_MIN_KBPS.values())),
        ("very_low_bpp", (px > 0) & (bpp < 0.02)),
        ("low_bpp", (px > 0) & (bpp >= 0.02) & (bpp < 0.05)),
        ("invalid_crf", (crf < 0) | (crf > 51)),
        ("high_crf", (crf > 35) & (crf <= 51)),
        ("invalid_preset", ~F.col("preset").isin(*K.PRESETS)),
        ("invalid_encoder", ~F.col("encoder").isin(*K.ENCODER_MIN_KBPS)),
    )
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    return df.select(*key, F.explode(broken).alias("violation"))


def at_least(score: Column, threshold) -> Column:
    """Null-safe comparison: a missing score never passes."""
    return F.coalesce(score >= threshold, F.lit(False))


def clean_scores(df: DataFrame) -> DataFrame:
    vmaf, ssim = F.col("vmaf"), F.col("ssim")
    return df.withColumns(
        {
            "vmaf": F.when(vmaf.between(0, 100), vmaf),
            "ssim": F.when(ssim.between(0, 1), ssim),
            "confidence": clamp(F.coalesce(F.col("confidence"), F.lit(0.0)), 0.0, 1.0),
        }
    )


def ttl_hours(confidence: Column, method: Column) -> Column:
    by_conf = F.when(confidence > 0.9, 2.0).when(confidence > 0.7, 1.5).when(confidence > 0.5, 1.0).otherwise(0.5)
    by_method = F.when(method == "full", 1.5).when(method == "predicted", 0.7).otherwise(1.0)
    return whole(by_conf * by_method * 24)


def with_ttl(results: DataFrame, created: str = "created_at") -> DataFrame:
    return results.withColumn("ttl_hours", ttl_hours(F.col("confidence"), F.col("method"))).withColumn(
        "expires_at", F.col(created) + F.make_dt_interval(hours=F.col("ttl_hours").cast("int"))
    )


def resolution_mismatch(pairs: DataFrame) -> DataFrame:
    ow, oh, cw, ch = (F.col(c) for c in ("orig_w", "orig_h", "comp_w", "comp_h"))
    aspect = lambda w, h: F.when(h > 0, w / h).otherwise(F.lit(1.0))
    orig_smaller = pixels(ow, oh) <= pixels(cw, ch)
    return pairs.withColumns(
        {
            "size_mismatch": (ow != cw) | (oh != ch),
            "aspect_mismatch": F.abs(aspect(ow, oh) - aspect(cw, ch)) > 0.01,
            "target_w": F.when(orig_smaller, ow).otherwise(cw),
            "target_h": F.when(orig_smaller, oh).otherwise(ch),
            "smaller": F.when(orig_smaller, "original").otherwise("compressed"),
        }
    )


def encode_time(duration: Column, preset: Column, w: Column, h: Column) -> Column:
    return duration * lookup(preset, K.ENCODE_TIME_FACTOR, 3.0) * (pixels(w, h) / (1920.0 * 1080.0))


def compatibility(w: Column, h: Column, preset: Column) -> Column:
    large = F.when((w > 1920) | (h > 1080), 0.1).otherwise(0.0)
    slow = F.when(preset.isin("veryslow", "slower"), 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.5), 1.0 - large - slow)


def utilisation(size_bytes: Column, target_mb: Column) -> Column:
    return size_bytes / F.greatest(target_mb * MIB, F.lit(1.0))


def utilisation_band(ratio: Column, low: float = 0.92) -> Column:
    return F.when(ratio > 1, "over").when(ratio >= low, "in_range").otherwise("under")


def param_score(pixel_ratio: Column, crf: Column, bpp: Column, fps_ratio: Column) -> Column:
    score = pixel_ratio * 10.0
    score = score * F.when(F.coalesce(crf, F.lit(0)) != 0, F.greatest(F.lit(0.0), (40 - crf) / 22.0)).otherwise(1.0)
    score = score * F.when(F.coalesce(bpp, F.lit(0.0)) > 0, F.least(bpp / 0.03, F.lit(1.2))).otherwise(1.0)
    return clamp(score * F.greatest(fps_ratio, F.lit(0.7)), 0.0, 10.0)


def priority_score(size_mb: Column, target_mb: Column, priority: Column, two_pass: Column, options: Column) -> Column:
    used = size_mb / target_mb
    bonus = F.when(used <= 1, used * 2).otherwise(-5.0)
    extra = F.when(two_pass, 1.0).otherwise(0.0) + options * 0.1
    return clamp(bonus + lookup(priority, K.PRIORITY_BONUS, 2.0) + extra + 5.0, 0.0, 10.0)


def media_valid(assets: DataFrame, max_mb: float | None = 10.0) -> DataFrame:
    """First failing reason per probed file (null when valid).

    Needs: kind ('video' or 'gif'), exists, size_bytes, has_video, nb_frames (text), duration_s,
    gif_header, gif_trailer, animated.
    """
    gif = F.col("kind") == "gif"
    frames = F.col("nb_frames").try_cast("bigint")
    no_duration = F.coalesce(F.col("duration_s"), F.lit(0.0)) <= 0
    too_large = F.lit(False) if max_mb is None else F.col("size_bytes") > max_mb * MIB
    reason = (
        F.when(~F.col("exists"), "missing")
        .when(F.coalesce(F.col("size_bytes"), F.lit(0)) == 0, "empty")
        .when(too_large, "too_large")
        .when(~gif & ~F.coalesce(F.col("has_video"), F.lit(False)), "no_video_stream")
        .when(~gif & (frames <= 0), "no_frames")
        .when(~gif & frames.isNull() & no_duration, "no_duration_or_frames")
        .when(gif & ~F.coalesce(F.col("gif_header").isin("GIF87a", "GIF89a"), F.lit(False)), "bad_header")
        .when(gif & ~F.coalesce(F.col("gif_trailer"), F.lit(False)), "missing_trailer")
        .when(gif & ~F.coalesce(F.col("animated"), F.lit(False)), "not_animated")
        .when(gif & (F.coalesce(frames, F.lit(0)) <= 0), "no_frames")
    )
    return assets.withColumn("invalid_reason", reason).withColumn("valid", F.col("invalid_reason").isNull())
