"""Row generators: nested records, sample grids, segment plans, stage sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelscope.functions import constants as K, scalars as S


def explode_nested(sessions: DataFrame, array: str, keep: list[str] | None = None) -> DataFrame:
    """One row per element of a nested array of structs, with its position."""
    out = sessions.select(*(keep or ["session_id"]), F.posexplode(array).alias("pos", "_e"))
    return out.select("*", "_e.*").drop("_e")


def index(n: Column) -> Column:
    """0 .. n-1 as an array (empty for n < 1)."""
    return F.when(n >= 1, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))


def interval_samples(assets: DataFrame, every_s: float = 5.0, length_s: float = 1.0) -> DataFrame:
    """A sample of ``length_s`` every ``every_s`` seconds, cut at the end."""
    n = F.ceil(F.col("duration_s") / every_s)
    out = assets.select("asset_id", "duration_s", F.explode(index(n)).alias("sample_no"))
    start = F.col("sample_no") * every_s
    return out.select("asset_id", "sample_no", start.alias("start_s"), F.least(start + length_s, "duration_s").alias("end_s")).where("end_s > start_s")


def temporal_samples(assets: DataFrame, every_s: float = 5.0, max_s: float | None = None, length_s: float = 2.0) -> DataFrame:
    """Evenly spread samples over the whole asset, or over its first ``max_s`` seconds if the caller wants that."""
    span = F.least(F.col("duration_s"), F.lit(max_s)) if max_s else F.col("duration_s")
    n = F.greatest(F.lit(1).cast("bigint"), S.whole(span / every_s))
    out = assets.select("asset_id", span.alias("_span"), n.alias("_n"), F.explode(index(n)).alias("sample_no"))
    start = F.col("sample_no") * (F.col("_span") / F.col("_n"))
    cut = out.select("asset_id", "sample_no", start.alias("start_s"), F.least(start + length_s, "_span").alias("end_s"))
    return cut.where("end_s > start_s")


def scene_samples(scenes: DataFrame, per_scene: int = 2, length_s: float = 1.5, min_s: float = 1.0) -> DataFrame:
    """``per_scene`` samples in the first 80 % of each scene of at least ``min_s``."""
    length = F.col("end_s") - F.col("start_s")
    offsets = F.array(*[F.lit((j + 0.5) / per_scene * 0.8) for j in range(per_scene)])
    out = scenes.where(length >= min_s).select(
        "*", F.posexplode(offsets).alias("sample_no", "_at")
    ).withColumn("sample_start_s", F.col("start_s") + F.col("_at") * (F.col("end_s") - F.col("start_s")))
    return out.withColumn("sample_end_s", F.least(F.col("sample_start_s") + length_s, "end_s")).where("sample_end_s > sample_start_s").drop("_at")


def plan_segments(assets: DataFrame, seconds: Column) -> DataFrame:
    """Equal video segments of at most ``seconds``; the last ends exactly at the end."""
    n = F.ceil(F.col("duration_s") / seconds)
    equal = F.least(seconds, F.col("duration_s") / n)
    out = assets.withColumn("segments", n).withColumn("segment_s", equal).withColumn("_i", F.explode(index(F.col("segments"))))
    start = F.col("_i") * F.col("segment_s")
    end = F.when(F.col("_i") < F.col("segments") - 1, (F.col("_i") + 1) * F.col("segment_s")).otherwise(F.col("duration_s"))
    return out.select(
        "asset_id", "segments", (F.col("_i") + 1).alias("segment_no"), start.alias("start_s"), end.alias("end_s"),
        F.concat(S.sanitize(F.col("path")), F.lit("_segment_"), F.lpad((F.col("_i") + 1).cast("string"), 3, "0"), F.lit(".mp4")).alias("name"),
    ).where("end_s > start_s")


# Fixed bands: longest clip, preferred segment length.
GIF_BANDS = ((40.0, 18.0), (80.0, 22.0), (120.0, 25.0))
GIF_LAST_BAND = 28.0


def plan_gif_segments(assets: DataFrame, max_s: float = 30.0, min_s: float = 12.0, cap_s: float = 35.0) -> DataFrame:
    """GIF segments: preferred length by duration band, clamped, then equalised.

    Long segments get their frame rate and palette reduced by a tenth.
    """
    top = min(max_s, cap_s)
    want = F.when(F.lit(False), 0.0)
    for limit, length in GIF_BANDS:
        want = want.when(F.col("duration_s") <= limit, length)
    first = F.least(F.lit(top), F.greatest(F.lit(min_s), want.otherwise(GIF_LAST_BAND)))
    n = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("duration_s") / first))
    equal = F.least(F.lit(top), F.greatest(F.lit(min_s), F.col("duration_s") / n))
    out = assets.withColumn("segments", n).withColumn("_len", equal).withColumn("_i", F.explode(index(F.col("segments"))))
    start = F.col("_i") * F.col("_len")
    end = F.when(F.col("_i") == F.col("segments") - 1, F.col("duration_s")).otherwise(F.least("duration_s", start + F.col("_len")))
    span = end - start
    long = span > top * 0.8
    return out.select(
        "asset_id", "segments", (F.col("_i") + 1).alias("segment_no"), start.alias("start_s"), end.alias("end_s"),
        F.when(long, S.whole(F.col("gif_fps") * 0.9)).otherwise(S.whole(F.col("gif_fps"))).alias("fps"),
        F.when(long, S.clamp_colors(S.whole(F.col("colors") * 0.9))).otherwise(F.col("colors").cast("bigint")).alias("colors"),
    ).where("end_s > start_s")


# Which of the six stages each strategy walks, in order.
STAGE_ORDER = {"quality": (0, 1, 2), "size": (5, 4, 3), "balanced": (2, 3, 4)}
ADAPTIVE_STEPS = (0.95, 0.90, 0.85, 0.80)


def stage_array(strategy: str) -> Column:
    """The parameter sequence of a strategy as an array of structs (columns width, fps, colors, motion_level, complexity_level)."""
    w, fps, colors = F.col("width"), F.col("fps"), F.col("colors")
    item = lambda no, width, rate, col, dither, lossy: F.struct(
        F.lit(no).alias("stage"), S.whole(width).alias("stage_width"), S.whole(rate).alias("stage_fps"),
        col.cast("bigint").alias("stage_colors"), dither.alias("dither"), F.lit(lossy).alias("lossy"),
    )
    if strategy == "adaptive":
        level, busy = F.col("motion_level"), F.col("complexity_level")
        rate = S.lookup(level, {"low": 0.85, "high": 0.95}, 0.9)
        shade = S.lookup(busy, {"low": 0.8, "high": 0.95}, 0.9)
        dither = F.when(busy == "high", "floyd_steinberg").otherwise("bayer")
        big = lambda x, low: F.greatest(S.whole(x), F.lit(low).cast("bigint"))
        return F.array(*[
            item(i, big(w * m, 360), big(fps * rate, 15), big(colors * shade, 128), dither, int(60 * (1.0 - m)))
            for i, m in enumerate(ADAPTIVE_STEPS)
        ])
    stages = [K.GIF_STAGES[i] for i in STAGE_ORDER.get(strategy, STAGE_ORDER["balanced"])]
    return F.array(*[
        item(i, w * res, fps * mult, F.lit(col), F.lit(dither), lossy) for i, (_, col, mult, res, lossy, dither) in enumerate(stages)
    ])


def stage_params(assets: DataFrame, strategy: str) -> DataFrame:
    return assets.select("asset_id", F.explode(stage_array(strategy)).alias("_s")).select("asset_id", "_s.*")


# ---------------------------------------------------------------- pluggable parameter strategies


def _ratio() -> Column:
    return F.when(F.col("target_mb") > 0, F.col("size_mb") / F.col("target_mb")).otherwise(1.0)


def _steps(limits, column: str, scales, floors):
    """Width-style rule: scale by size pressure, not below a floor per band; None keeps the value."""
    base = F.col(column)
    pick = lambda m, low: base.cast("bigint") if m is None else F.greatest(S.whole(base * m), F.lit(low).cast("bigint"))
    out = F.when(_ratio() > limits[0], pick(scales[0], floors[0])).when(_ratio() > limits[1], pick(scales[1], floors[1]))
    return out.otherwise(pick(scales[2], floors[2]))


def _lossy(limits, values):
    out = F.when(_ratio() > limits[0], values[0]).when(_ratio() > limits[1], values[1])
    return out.otherwise(values[2]).cast("bigint")


def quality_first(df: DataFrame) -> DataFrame:
    lim = (1.5, 1.2)
    return df.withColumns({
        "out_width": _steps(lim, "width", (0.85, 0.92, 0.96), (360, 360, 360)),
        "out_fps": _steps(lim, "fps", (0.9, 0.95, None), (15, 15, 0)),
        "out_colors": _steps(lim, "colors", (0.9, 0.95, None), (192, 224, 0)),
        "out_dither": F.lit("floyd_steinberg"), "out_lossy": F.least(F.col("lossy"), F.lit(40)).cast("bigint"),
    })


def size_first(df: DataFrame) -> DataFrame:
    lim = (2.0, 1.5)
    colors = F.when(_ratio() > 2.0, 96).when(_ratio() > 1.5, 128).otherwise(160).cast("bigint")
    return df.withColumns({
        "out_width": _steps(lim, "width", (0.0, 0.75, 0.85), (360, 360, 360)),
        "out_fps": _steps(lim, "fps", (0.0, 0.8, 0.85), (15, 15, 15)),
        "out_colors": colors, "out_dither": F.lit("bayer"), "out_lossy": _lossy(lim, (120, 100, 80)),
    })


def balanced(df: DataFrame) -> DataFrame:
    lim = (1.5, 1.2)
    out = df.withColumns({
        "out_width": _steps(lim, "width", (0.88, 0.92, 0.96), (360, 360, 360)),
        "out_fps": _steps(lim, "fps", (0.9, 0.95, None), (15, 15, 0)),
        "out_colors": _steps(lim, "colors", (0.85, 0.9, None), (160, 192, 0)),
        "out_lossy": _lossy(lim, (60, 40, 20)),
    })
    return out.withColumn("out_dither", F.when(F.col("out_colors") > 192, "floyd_steinberg").otherwise("bayer"))


def adaptive(df: DataFrame) -> DataFrame:
    lim = (1.5, 1.2)
    rate = S.lookup(F.col("motion_level"), {"low": 0.85, "high": 0.95}, 0.9)
    shade = S.lookup(F.col("complexity_level"), {"low": 0.8, "high": 0.95}, 0.9)
    big = lambda x, low: F.greatest(S.whole(x), F.lit(low).cast("bigint"))
    tight, near = _ratio() > lim[0], _ratio() > lim[1]
    fps, colors = F.col("fps") * rate, F.col("colors") * shade
    return df.withColumns({
        "out_width": _steps(lim, "width", (0.85, 0.92, 0.96), (360, 360, 360)),
        "out_fps": F.when(tight, big(fps * 0.9, 15)).otherwise(big(fps, 15)),
        "out_colors": F.when(tight, big(colors * 0.9, 128)).when(near, big(colors, 192)).otherwise(big(colors, 224)),
        "out_lossy": _lossy(lim, (60, 40, 20)),
        "out_dither": F.when(F.col("complexity_level") == "low", "bayer").otherwise("floyd_steinberg"),
    })


STRATEGIES = {"quality": quality_first, "size": size_first, "balanced": balanced, "adaptive": adaptive}


def register_strategy(name: str, fn) -> None:
    """Add a strategy: a function from DataFrame to DataFrame, for ``df.transform``."""
    STRATEGIES[name.lower()] = fn


def get_strategy(name: str):
    return STRATEGIES.get(name.lower(), balanced)
