"""Content type, encoding profile, bitrate split and content-driven encoder settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelscope.functions import scalars as S

# Fixed votes: content type -> (frame flag, points).
VOTES = {
    "animation": (("limited_palette", 2.0), ("sharp_edges", 1.0), ("flat_colors", 1.5)),
    "live_action": (("natural_textures", 2.0), ("smooth_gradients", 1.0), ("noise_present", 1.0)),
    "screen_recording": (("text_detected", 2.0), ("ui_elements", 1.5), ("high_contrast", 1.0)),
    "gaming": (("hud_elements", 2.0), ("particle_effects", 1.5), ("rapid_changes", 1.0)),
}
# Fixed profiles: preset, tune, crf, efficiency, audio share, min quality, quality-over-size, gop factor, b-frames,
# denoise, deband, sharpen, motion sensitivity, spatial sensitivity.
PROFILE_FIELDS = (
    "preset", "tune", "crf", "efficiency", "audio_share", "min_quality", "quality_bias", "gop_factor", "b_frames",
    "denoise", "deband", "sharpen", "motion_sens", "spatial_sens",
)
PROFILES = {
    "animation_standard": ("medium", "animation", 20, 0.8, 0.1, 0.85, 0.7, 1.2, 8, False, True, False, 0.6, 0.9),
    "animation_high_detail": ("slow", "animation", 18, 1.1, 0.08, 0.9, 0.8, 1.0, 4, False, True, True, 0.5, 1.2),
    "animation_high_motion": ("fast", "animation", 22, 1.2, 0.12, 0.8, 0.6, 0.8, 2, False, True, False, 1.2, 0.7),
    "live_action_standard": ("medium", "film", 23, 1.0, 0.12, 0.8, 0.6, 1.0, 4, True, False, False, 1.0, 1.0),
    "live_action_high_motion": ("fast", "film", 24, 1.3, 0.1, 0.75, 0.5, 0.7, 2, True, False, False, 1.4, 0.8),
    "live_action_high_detail": ("slow", "film", 21, 1.2, 0.08, 0.85, 0.8, 1.1, 8, True, False, True, 0.8, 1.3),
    "live_action_complex": ("medium", "film", 22, 1.4, 0.1, 0.8, 0.7, 0.9, 4, True, False, True, 1.2, 1.2),
    "screen_recording": ("fast", "stillimage", 18, 0.7, 0.15, 0.9, 0.8, 2.0, 8, False, False, True, 0.3, 1.5),
    "gaming_standard": ("fast", "film", 22, 1.1, 0.12, 0.8, 0.6, 0.8, 4, False, True, True, 1.1, 1.1),
    "gaming_high_action": ("veryfast", "film", 24, 1.4, 0.1, 0.75, 0.5, 0.6, 2, False, True, False, 1.5, 0.9),
    "mixed_standard": ("medium", "film", 22, 1.1, 0.12, 0.8, 0.65, 1.0, 4, True, True, False, 1.0, 1.0),
    "mixed_complex": ("slow", "film", 21, 1.3, 0.1, 0.82, 0.75, 0.9, 4, True, True, True, 1.1, 1.1),
}
TYPE_SHIFT = {"animation": -0.1, "live_action": 0.0, "screen_recording": -0.2, "gaming": 0.05, "mixed": 0.02}


def content_type(flags: DataFrame) -> DataFrame:
    """Vote over frame flags per video; weak or close votes are ``mixed``."""
    total = lambda kind: sum(
        (F.sum(F.when(F.col(f), pts).otherwise(0.0)) for f, pts in VOTES[kind][1:]), F.sum(F.when(F.col(VOTES[kind][0][0]), VOTES[kind][0][1]).otherwise(0.0))
    )
    agg = flags.groupBy("video_id").agg(*[total(k).alias(f"{k}_score") for k in VOTES])
    scores = [F.col(f"{k}_score") for k in VOTES]
    top = F.greatest(*scores)
    close = sum((F.when(s > top * 0.7, 1).otherwise(0) for s in scores[1:]), F.when(scores[0] > top * 0.7, 1).otherwise(0))
    winner = F.when(F.lit(False), "")
    for k, s in zip(VOTES, scores):
        winner = winner.when(s == top, k)
    return agg.withColumn("content_type", F.when((top < 3.0) | (close > 1), "mixed").otherwise(winner))


def profile_name(kind: Column, motion: Column, spatial: Column) -> Column:
    anim = F.when(spatial > 7, "animation_high_detail").when(motion > 7, "animation_high_motion").otherwise("animation_standard")
    live = (
        F.when((motion > 7) & (spatial > 7), "live_action_complex").when(motion > 7, "live_action_high_motion")
        .when(spatial > 7, "live_action_high_detail").otherwise("live_action_standard")
    )
    return (
        F.when(kind == "animation", anim).when(kind == "screen_recording", "screen_recording")
        .when(kind == "gaming", F.when(motion > 8, "gaming_high_action").otherwise("gaming_standard"))
        .when(kind == "live_action", live)
        .otherwise(F.when((motion > 6) | (spatial > 6), "mixed_complex").otherwise("mixed_standard"))
    )


def profile_map() -> Column:
    """The twelve profiles as a constant map, so a profile is looked up without a join."""
    row = lambda values: F.struct(*[F.lit(v).alias(n) for n, v in zip(PROFILE_FIELDS, values)])
    return F.create_map(*[x for name, values in PROFILES.items() for x in (F.lit(name), row(values))])


def pick_profile(content: DataFrame, quality_target: float = 0.8) -> DataFrame:
    """Profile columns per video, shifted when the quality target is not the default 0.8."""
    named = content.withColumn("profile", profile_name(F.col("content_type"), F.col("motion"), F.col("spatial")))
    out = named.withColumn("_p", F.element_at(profile_map(), F.col("profile"))).select("*", *[F.col(f"_p.{f}").alias(f) for f in PROFILE_FIELDS]).drop("_p")
    if quality_target == 0.8:
        return out
    shifted = {"quality_bias": F.lit(quality_target)}
    if quality_target > 0.9:
        shifted["crf"] = F.greatest(F.lit(15), F.col("crf") - 3)
        shifted["preset"] = F.when(F.col("preset").isin("fast", "medium"), "slow").otherwise(F.col("preset"))
    elif quality_target < 0.6:
        shifted["crf"] = F.least(F.lit(30), F.col("crf") + 3)
        shifted["preset"] = F.when(F.col("preset").isin("slow", "medium"), "fast").otherwise(F.col("preset"))
    return out.withColumns(shifted)


def adjustment(x: Column, sensitivity: Column, up: float, down: float) -> Column:
    return F.when(x > 7, (x - 7) * sensitivity * up).when(x < 3, (x - 3) * sensitivity * down).otherwise(0.0)


def bitrate_split(profiled: DataFrame) -> DataFrame:
    """Video and audio kbps, predicted quality and confidence. Adds to the columns of ``pick_profile``:
    target_mb, duration_s, stability, scene_count."""
    c = F.col
    motion, spatial = c("motion"), c("spatial")
    base = c("target_mb") * 8 * 1024 * 1024 / (c("duration_s") * 1000)
    load = (motion * c("motion_sens") + spatial * c("spatial_sens")) / 2.0 / 10.0 * 0.6 + 0.7
    shift = adjustment(motion, c("motion_sens"), 0.1, 0.05) + adjustment(spatial, c("spatial_sens"), 0.08, 0.04) + S.lookup(c("content_type"), TYPE_SHIFT, 0.0)
    out = profiled.withColumn("_r", base * load * c("efficiency") * (shift + 1.0))
    out = out.withColumn("audio_out_kbps", S.clamp(S.whole(c("_r") * c("audio_share")), 32, 192).cast("bigint"))
    out = out.withColumn("video_out_kbps", F.greatest(F.lit(100).cast("bigint"), S.whole(c("_r") - c("audio_out_kbps")))).drop("_r")
    quality = F.least(c("video_out_kbps") / 2000.0, F.lit(1.0)) - (motion + spatial) / 20.0 * 0.2 + c("quality_bias") * 0.1
    conf = (
        F.when(c("content_type").isin("animation", "screen_recording"), 0.2).when(c("content_type") == "mixed", -0.1).otherwise(0.0)
        + F.when(c("stability") > 7, 0.1).otherwise(0.0) - F.when(c("scene_count") > 20, 0.1).otherwise(0.0) + 0.7
    )
    return out.withColumns({
        "total_out_kbps": c("audio_out_kbps") + c("video_out_kbps"), "complexity_factor": load,
        "predicted_quality": S.clamp(quality, 0.0, 1.0), "split_confidence": S.clamp(conf, 0.3, 0.95),
    })


FASTER = {"slow": "medium", "medium": "fast", "fast": "veryfast"}
SLOWER = {"veryfast": "fast", "fast": "medium", "medium": "slow"}


def dynamic_params(profiled: DataFrame) -> DataFrame:
    """Adjusted CRF, preset, GOP and B-frames, filters, and what was changed.

    Needs the columns of ``pick_profile`` plus noise, stability, color_complexity, edge_density.
    """
    c = F.col
    motion, spatial, noise = c("motion"), c("spatial"), c("noise")
    crf = F.when(spatial > 8, -2).when(spatial < 3, 1).otherwise(0) + F.when(noise > 6, 1).otherwise(0)
    hurry, relax = (motion > 8) & (c("quality_bias") < 0.7), (spatial > 8) & (c("quality_bias") > 0.7)
    faster, slower = S.lookup(c("preset"), FASTER), S.lookup(c("preset"), SLOWER)
    relax = relax & ~hurry
    gop = S.whole(c("gop_factor") * 30)
    gop_shift = F.when(motion > 7, -S.whole(gop * 0.3)).when(c("stability") > 8, S.whole(gop * 0.5)).otherwise(0)
    screen = c("content_type") == "screen_recording"
    b = F.when(motion > 8, F.greatest(F.lit(1), c("b_frames") - 2)).when(screen, F.least(F.lit(8), c("b_frames") + 2)).otherwise(c("b_frames"))
    denoise, deband = c("denoise") & (noise > 3), c("deband") & ((c("content_type") == "animation") | (c("color_complexity") < 4))
    sharpen = c("sharpen") & (screen | (c("edge_density") > 0.15))
    told = lambda test, code: F.when(test, F.lit(code))
    return profiled.withColumns({
        "out_crf": S.clamp(c("crf") + crf, 15, 35),
        "out_preset": F.when(hurry, F.coalesce(faster, c("preset"))).when(relax, F.coalesce(slower, c("preset"))).otherwise(c("preset")),
        "out_gop": S.clamp(gop + gop_shift, 15, 300).cast("bigint"), "out_b_frames": b,
        "filters": F.array_compact(F.array(told(denoise, "denoise"), told(deband, "deband"), told(sharpen, "sharpen"))),
        "adjustments": F.array_compact(F.array(
            told(spatial > 8, "crf_reduced_detail"), told(spatial < 3, "crf_raised_flat"), told(noise > 6, "crf_raised_noise"),
            told(hurry & faster.isNotNull(), "preset_faster"), told(relax & slower.isNotNull(), "preset_slower"),
            told(motion > 7, "gop_shorter"), told((motion <= 7) & (c("stability") > 8), "gop_longer"),
            told(motion > 8, "b_frames_fewer"), told((motion <= 8) & screen, "b_frames_more"),
            told(denoise, "denoising"), told(deband, "debanding"), told(sharpen, "sharpening"),
        )),
    })
