"""Quality gates: hybrid score, threshold gate with fallback, failure analysis, remedies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelscope.functions import scalars as S

SINGLE_FLOOR = 65.0
SEGMENT_FLOORS = (70.0, 60.0, 50.0, 45.0)
WEIGHTS = {"perceptual": 0.40, "size_score": 0.20, "frame_score": 0.20, "tech_score": 0.20}

# Fixed order used for listing and for ties.
FAILURES = (
    "low_vmaf", "low_ssim", "high_blockiness", "high_banding", "blur_artifacts", "noise_artifacts", "temporal_artifacts",
    "compression_artifacts", "combined_quality",
)
CAUSES = (
    "insufficient_bitrate", "poor_encoder_settings", "aggressive_compression", "content_complexity", "codec_limitations",
    "preprocessing_issues", "temporal_compression",
)
BITRATE_NEED = {"libx264": 1.0, "libx265": 0.7, "h264_nvenc": 1.2, "h264_amf": 1.2, "hevc_nvenc": 0.8, "hevc_amf": 0.8}
BITRATE_GAIN = {"libx264": 1.0, "libx265": 1.2, "h264_nvenc": 0.8, "h264_amf": 0.8, "hevc_nvenc": 1.1, "hevc_amf": 1.1}


def say(test: Column, *codes: str) -> Column:
    """The codes when the test holds, else nothing (null tests count as false)."""
    return F.when(yes(test), F.array(*[F.lit(c) for c in codes])).otherwise(F.array().cast("array<string>"))


def segment_floor(attempt: Column) -> Column:
    floors = F.array(*[F.lit(x) for x in SEGMENT_FLOORS])
    return F.element_at(floors, (F.least(F.greatest(attempt, F.lit(0)), F.lit(len(SEGMENT_FLOORS) - 1)) + 1).cast("int"))


def hybrid_score(pairs: DataFrame) -> DataFrame:
    """Weighted score against a floor: 65 for single files, stepping down by attempt for segments.

    Needs perceptual, size_score, frame_score, tech_score (0-100), is_segment, attempt.
    """
    terms = [F.col(c) * w for c, w in WEIGHTS.items()]
    floor = F.when(F.col("is_segment"), segment_floor(F.col("attempt"))).otherwise(SINGLE_FLOOR)
    return pairs.withColumns({"overall": sum(terms[1:], terms[0]), "floor_used": floor}).withColumn("passes", F.col("overall") >= F.col("floor_used"))


def quality_gate(results: DataFrame, mode: str = "conservative", vmaf_min: float = 80.0, ssim_min: float = 0.94, least: float = 0.3) -> DataFrame:
    """Pass when both scores reach their thresholds; fall back when nothing was measured or confidence is low.

    Conservative and permissive fallbacks both pass, strict fails.
    """
    ok = S.at_least(F.col("vmaf"), vmaf_min) & S.at_least(F.col("ssim"), ssim_min)
    measured = F.col("vmaf").isNotNull() | F.col("ssim").isNotNull()
    reason = F.when(~measured, "evaluation_failed").when(F.coalesce("confidence", F.lit(0.0)) < least, "low_confidence")
    return results.withColumns({"raw_pass": ok, "evaluated": measured, "fallback_reason": reason}).withColumn(
        "passes", F.when(F.col("fallback_reason").isNull(), F.col("raw_pass")).otherwise(F.lit(mode != "strict"))
    )


def listed(flags: dict[str, Column]) -> Column:
    """Names of the flags that hold, in their given order.

    The filter also keeps many rules apart: Spark writes rules that follow each other into one method, and the JVM never
    compiles a method of more than 8,000 bytes, so ``failure_analysis`` as one method is interpreted, some four times slower.
    """
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in flags.items()]), lambda name: name.isNotNull())


def yes(test: Column) -> Column:
    """A test with null counting as false."""
    return F.coalesce(test, F.lit(False))


def bit(test: Column) -> Column:
    return F.when(test, 1).otherwise(0)


def average(items: list[Column]) -> Column:
    """Mean of the non-null items."""
    total = [F.coalesce(x, F.lit(0.0)) for x in items]
    count = [bit(x.isNotNull()) for x in items]
    return F.try_divide(sum(total[1:], total[0]), sum(count[1:], count[0]).cast("double"))


def failure_flags() -> tuple[dict[str, Column], dict[str, Column]]:
    """Flag per failure type and per root cause, as plain boolean columns."""
    c = F.col
    v, s = c("vmaf"), c("ssim")
    low_v, low_s = yes(v < 80), yes(s < 0.94)
    blocky, banded, blurred, noisy = yes(c("blockiness") > 0.12), yes(c("banding") > 0.10), yes(c("blur") > 0.15), yes(c("noise") > 0.20)
    timed = blocky & blurred
    raised = bit(low_v) + bit(low_s) + bit(blocky) * 2 + bit(banded) * 2 + bit(blurred) + bit(noisy) + bit(timed)
    flags = (low_v, low_s, blocky, banded, blurred, noisy, timed, blocky | banded, (raised >= 3) | (raised == 0))
    rate, known = c("bitrate_kbps"), c("bitrate_kbps").isNotNull()
    starved = yes(known & ((rate < 500) | ((rate < 1000) & (v < 70))))
    weak = yes(((c("encoder") == "libx264") & c("preset").isin("ultrafast", "superfast")) | (c("encoder").contains("nvenc") & c("preset").isin("p1", "p2")))
    squeezed = yes((c("original_kbps") > 0) & (rate < c("original_kbps") * 0.1))
    hard = yes((c("motion_level") == "high") & (v < 75)) | yes((c("complexity_level") == "high") & (s < 0.92))
    causes = (starved | blocky, weak | blurred, squeezed | blocky | banded, hard, banded, blurred, timed)
    return dict(zip(FAILURES, flags)), dict(zip(CAUSES, causes))


def failure_analysis(df: DataFrame) -> DataFrame:
    """Failure types, causes, primary issue and cause, severity, confidence and improvement potential.

    Needs (nullable) vmaf, ssim, blockiness, banding, blur, noise; bitrate_kbps, encoder, preset,
    original_kbps, motion_level, complexity_level, headroom_mb, eval_ok.
    """
    c = F.col
    v, s, blk, bnd = c("vmaf"), c("ssim"), c("blockiness"), c("banding")
    types, causes = failure_flags()
    marked = df.withColumns({**{f"_f_{n}": t for n, t in types.items()}, **{f"_c_{n}": t for n, t in causes.items()}})
    has, caused = (lambda n: c(f"_f_{n}")), (lambda n: c(f"_c_{n}"))
    count = [bit(has(n)) for n in FAILURES]
    weight = {
        "low_vmaf": F.greatest(F.lit(0.0), (80 - v) / 80), "low_ssim": F.greatest(F.lit(0.0), (0.94 - s) / 0.94),
        "high_blockiness": F.least(F.lit(1.0), (blk - 0.12) / 0.88), "high_banding": F.least(F.lit(1.0), (bnd - 0.10) / 0.90),
    }
    ranked = [
        F.when(has(f), F.struct(F.coalesce(weight.get(f, F.lit(0.5)), F.lit(0.5)).alias("w"), F.lit(-i).alias("r"), F.lit(f).alias("f")))
        for i, f in enumerate(FAILURES)
    ]
    band = lambda x, cuts: F.when(x < cuts[0], 1.0).when(x < cuts[1], 0.8).when(x < cuts[2], 0.6).when(x.isNotNull(), 0.3)
    marks = [
        band(v, (40, 60, 80)), band(s, (0.85, 0.90, 0.94)), F.when(has("high_blockiness"), weight["high_blockiness"]),
        F.when(has("high_banding"), weight["high_banding"]), F.when(sum(count[1:], count[0]) >= 3, 0.8),
    ]
    out = marked.withColumns({
        "failure_types": listed({n: has(n) for n in FAILURES}), "root_causes": listed({n: caused(n) for n in CAUSES}),
        "primary_issue": F.greatest(*ranked)["f"], "_m": F.sort_array(F.array(*marks), asc=False),
    })
    wanted = {
        "high_blockiness": ("insufficient_bitrate", "aggressive_compression"), "high_banding": ("codec_limitations", "aggressive_compression"),
        "low_vmaf": ("insufficient_bitrate", "poor_encoder_settings"), "low_ssim": ("insufficient_bitrate", "poor_encoder_settings"),
    }
    cause = F.when(F.lit(False), "")
    for issue, pair in wanted.items():
        for name in pair:
            cause = cause.when((c("primary_issue") == issue) & caused(name), name)
    for name in CAUSES:  # otherwise the first cause, which is the default when there is none
        cause = cause.when(caused(name), name)
    m = [F.get("_m", F.lit(i)) for i in range(5)]
    rest = F.coalesce(average(m[2:]), F.lit(0.0))
    severity = (
        F.when(m[0].isNull(), 0.5).when(m[1].isNull(), m[0]).when(m[2].isNull(), m[0] * 0.7 + m[1] * 0.3)
        .otherwise(m[0] * 0.5 + m[1] * 0.3 + rest * 0.2)
    )
    room = c("headroom_mb")
    given = lambda test, value: F.when(test, F.lit(value))
    sure = [
        given(v.isNotNull(), 0.9), given(s.isNotNull(), 0.8), given(blk.isNotNull(), 0.7), given(bnd.isNotNull(), 0.7),
        given(c("bitrate_kbps").isNotNull(), 0.6), F.when(yes(c("eval_ok")), 0.8).otherwise(0.3),
    ]
    chance = [
        F.when(room > 2, 0.9).when(room > 0.5, 0.7).when(room > 0.1, 0.4).otherwise(0.1),
        given(caused("insufficient_bitrate") | caused("poor_encoder_settings") | caused("aggressive_compression"), 0.8),
        given(has("low_vmaf") | has("low_ssim") | has("high_blockiness") | has("high_banding"), 0.7),
        F.when(c("encoder").isin("libx264", "libx265"), 0.8).when(c("encoder").contains("nvenc") | c("encoder").contains("amf"), 0.6),
    ]
    final = out.withColumns({
        "primary_cause": cause.otherwise("insufficient_bitrate"), "severity": severity, "analysis_confidence": average(sure),
        "potential": average(chance), "can_improve": room > 0.1,
    })
    return final.drop("_m", *[f"_f_{n}" for n in FAILURES], *[f"_c_{n}" for n in CAUSES])


def strategies(failures: DataFrame) -> DataFrame:
    """At most four remedies in rule order. Needs the columns of ``failure_analysis``."""
    c = F.col
    f = lambda code: F.array_contains("failure_types", code)
    r = lambda code: F.array_contains("root_causes", code)
    room, sev = c("headroom_mb"), c("severity")
    up, enc, codec, time, tune = "increase_bitrate", "better_encoding", "advanced_codec", "temporal_optimization", "perceptual_tuning"
    rules = F.concat(
        say(r("insufficient_bitrate") & (room > 0.5), up), say(r("poor_encoder_settings"), enc), say(r("codec_limitations"), codec),
        say(r("temporal_compression"), time), say(r("aggressive_compression"), up, enc), say(f("high_blockiness"), up, time),
        say(f("high_banding"), codec, tune), say(f("blur_artifacts"), enc, tune), say(f("low_vmaf") | f("low_ssim"), up, enc),
        say(sev > 0.8, codec, time, tune), say((sev > 0.6) & (sev <= 0.8), enc, time),
    )
    out = failures.withColumn("_s", rules)
    kept = F.filter("_s", lambda x: ((c("potential") >= 0.3) | x.isin(up, codec)) & ((room >= 0.2) | (x != up)))
    out = out.withColumn("_s", kept)
    spare = F.when((F.size("_s") == 0) & (room > 0.5), F.array(F.lit(up))).when((F.size("_s") == 0) & (room > 0.1), F.array(F.lit(enc)))
    return out.withColumn("strategies", F.slice(F.array_distinct(F.coalesce(spare, F.col("_s"))), 1, 4)).drop("_s")


def recommend_bitrate(df: DataFrame) -> DataFrame:
    """Recommended kbps (never below current), expected gain, and the rate that fits the size limit.

    Needs vmaf, severity, bitrate_kbps, encoder, resolution_factor, fps_factor, failure_types, size_limit_mb, duration_s.
    """
    c = F.col
    v, sev = c("vmaf"), c("severity")
    base = F.when(v.isNull(), 3000).when(v < 60, 10000).when(v < 75, 6000).when(v < 85, 3000).otherwise(1500)
    base = F.when(sev > 0.8, 10000).when((sev > 0.6) & (base == 1500), 3000).otherwise(base)
    wanted = S.whole(S.whole(base * c("resolution_factor") * c("fps_factor")) * S.lookup(c("encoder"), BITRATE_NEED, 1.0))
    out = df.withColumn("recommended_kbps", F.greatest(wanted, c("bitrate_kbps")))
    ratio = c("recommended_kbps") / c("bitrate_kbps")
    lift = F.when(v < 50, 1.5).when(v < 70, 1.2).when((v < 85) | v.isNull(), 1.0).otherwise(0.7)
    kind = F.when(F.array_contains("failure_types", "high_blockiness"), 1.3).when(F.array_contains("failure_types", "high_banding"), 0.8).otherwise(1.0)
    gain = F.least(F.ln(ratio) * 15.0 * lift * S.lookup(c("encoder"), BITRATE_GAIN, 1.0) * kind, F.lit(25.0))
    top = S.whole(c("size_limit_mb") * 8 * 1024 * 0.95 / c("duration_s"))
    fitted = F.when(c("recommended_kbps") <= top, c("recommended_kbps")).when(top >= 500, top)
    return out.withColumns({"expected_gain": F.when(ratio > 1, gain).otherwise(0.0), "fitted_kbps": fitted})
