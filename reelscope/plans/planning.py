"""Catalogue-wide encode planning. Candidate grids are arrays inside each row: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelscope.functions import constants as K, scalars as S

FALLBACK_RESOLUTIONS = ((1280, 720),)
GRID_HEIGHTS = (1080, 720, 540, 480, 360, 270, 240, 180, 144, 120)
STEP_HEIGHTS = (1080, 720, 540, 480, 360, 270)


def first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


# ---------------------------------------------------------------- bitrate floor


def safe_kbps(target_mb: Column, duration: Column, audio: Column, margin: float) -> Column:
    d = F.when(duration > 0, duration).otherwise(60.0)
    video = S.whole((target_mb * 8 * S.MIB - audio * 1000 * d) / (d * 1000))
    return F.greatest(F.lit(64).cast("bigint"), S.whole(video / margin))


def impact(ratio: Column, high: float, low: float) -> Column:
    return F.when(ratio >= high, "minimal").when(ratio >= low, "moderate").otherwise("significant")


def floor_adjust(
    df: DataFrame, resolutions=FALLBACK_RESOLUTIONS, min_size=(K.MIN_WIDTH, K.MIN_HEIGHT), min_fps: float = K.MIN_FPS,
    steps=K.FPS_STEPS, margin: float = K.SAFETY_MARGIN, minima: dict = K.ENCODER_MIN_KBPS,
) -> DataFrame:
    """Settings that meet the encoder's bitrate floor: untouched, smaller, slower, or both; else the best try.

    Needs width, height, fps, bitrate_kbps, encoder, audio_kbps, duration_s, target_mb.  The
    size-budget rate of the resolution step does not depend on the resolution, so that step
    succeeds whenever the budget meets the floor and a smaller resolution is allowed.
    """
    c = F.col
    w, h, fps, rate = c("width"), c("height"), c("fps"), c("bitrate_kbps").cast("bigint")
    floor = S.lookup(c("encoder"), minima, K.DEFAULT_ENCODER_MIN_KBPS).cast("bigint")
    allowed = [(a, b) for a, b in resolutions if a >= min_size[0] and b >= min_size[1]]
    def cand(name, cw, ch, f, k, imp):
        return F.struct(F.lit(name).alias("kind"), cw.cast("bigint").alias("w"), ch.cast("bigint").alias("h"), f.cast("double").alias("fps"),
                        k.cast("bigint").alias("kbps"), imp.alias("impact"))

    budget = safe_kbps(c("target_mb"), c("duration_s"), c("audio_kbps"), margin)
    sizes = F.array(*[F.struct(F.lit(a).cast("bigint").alias("w"), F.lit(b).cast("bigint").alias("h")) for a, b in allowed])
    if not allowed:
        sizes = F.array().cast("array<struct<w:bigint,h:bigint>>")
    slower = lambda s: F.greatest(F.lit(float(min_fps)), fps * s)
    lowest = slower(F.lit(float(min(steps))))
    worst = F.lit("significant")
    staged = df.withColumns({
        "min_kbps": floor, "_budget": budget,
        "_sizes": F.filter(sizes, lambda x: ~((x["w"] >= w) & (x["h"] >= h))),
        "_rates": F.filter(F.transform(F.array(*[F.lit(float(s)) for s in steps]), slower), lambda f: f < fps),
    })
    share = lambda x: (x["w"] * x["h"]).cast("double") / S.pixels(w, h)
    slow_kbps = lambda gain: S.whole(S.whole(rate * gain) / margin)
    by_size = F.transform("_sizes", lambda x: cand("resolution", x["w"], x["h"], fps, c("_budget"), impact(share(x), 0.8, 0.6)))
    by_fps = F.transform("_rates", lambda f: cand("fps", w, h, f, slow_kbps(fps / f), impact(f / fps, 0.8, 0.6)))
    both = F.flatten(F.transform("_sizes", lambda x: F.transform("_rates", lambda f: cand(
        "combined", x["w"], x["h"], f, slow_kbps(fps / f * (1.0 / F.sqrt(share(x)))), impact(share(x) * (f / fps), 0.7, 0.5)))))
    smallest = allowed[-1] if allowed else None
    tries = F.array(
        cand("resolution", F.lit(smallest[0]), F.lit(smallest[1]), fps, c("_budget"), worst) if smallest else cand("resolution", w, h, fps, rate, worst),
        cand("fps", w, h, lowest, slow_kbps(fps / lowest), worst),
    )
    staged = staged.withColumn("_both", F.when(rate < c("min_kbps"), both))  # only short rates need candidates
    staged = staged.withColumn("_good", F.when(
        rate < c("min_kbps"), F.filter(F.concat(by_size, by_fps, "_both"), lambda x: x["kbps"] >= F.col("min_kbps"))))
    tried = F.transform(F.concat(tries, "_both"), lambda x, i: F.struct(x["kbps"].alias("k"), (-i).alias("i"), x.alias("x")))
    staged = staged.withColumn("_best", F.when(F.size("_good") == 0, F.array_max(tried)["x"]))
    same = cand("none", w, h, fps, rate, F.lit("minimal"))
    out = staged.withColumn("_g", F.when(rate >= c("min_kbps"), same).otherwise(first(c("_good"))))
    found = c("_g").isNotNull()
    use = lambda f: F.when(found, c(f"_g.{f}")).otherwise(c(f"_best.{f}"))
    return out.withColumns({
        "adjust_ok": found, "adjustment": F.when(found, c("_g.kind")).otherwise("failed"),
        "new_width": use("w"), "new_height": use("h"), "new_fps": use("fps"), "new_kbps": use("kbps"),
        "impact": F.when(found, c("_g.impact")).otherwise("significant"),
    }).drop("_budget", "_sizes", "_rates", "_both", "_good", "_best", "_g")


def suggest(df: DataFrame, resolutions=FALLBACK_RESOLUTIONS, min_fps: float = K.MIN_FPS, steps=K.FPS_STEPS, minima: dict = K.ENCODER_MIN_KBPS) -> DataFrame:
    """Simple advice per encode: smaller resolution, lower frame rate, or segmentation."""
    c = F.col
    w, h, fps, rate = c("width"), c("height"), c("fps"), c("bitrate_kbps")
    floor = S.lookup(c("encoder"), minima, K.DEFAULT_ENCODER_MIN_KBPS)
    budget = S.target_kbps(c("target_mb"), c("duration_s"), c("audio_kbps"))
    px = S.pixels(w, h)
    out = F.when(F.lit(False), F.struct(F.lit("").alias("advice"), F.lit(0).cast("bigint").alias("advised_kbps"), F.lit("").alias("advised_impact")))
    item = lambda name, k, imp: F.struct(F.lit(name).alias("advice"), k.cast("bigint").alias("advised_kbps"), imp.alias("advised_impact"))
    for a, b in resolutions:
        ratio = F.lit(float(a * b)) / px
        size = F.when(ratio > 0.7, "minimal").when(ratio > 0.4, "moderate").otherwise("significant")
        out = out.when(((F.lit(a) < w) | (F.lit(b) < h)) & (budget >= floor), item("resolution_reduction", budget, size))
    for s in steps:
        k = S.whole(rate * (F.greatest(F.lit(float(min_fps)), fps * s) / fps))
        out = out.when(k >= floor, item("fps_reduction", k, F.lit("moderate" if s >= 0.6 else "significant")))
    out = out.otherwise(item("segmentation", rate, F.lit("minimal")))
    return df.withColumn("_a", out).select("*", "_a.*").drop("_a")


def minimum_viable(df: DataFrame, minima: dict = K.ENCODER_MIN_KBPS, audio: int = 64) -> DataFrame:
    """Whether the size limit allows the encoder's minimum rate (10 % slack), else segmentation."""
    c = F.col
    floor = S.lookup(c("encoder"), minima, K.DEFAULT_ENCODER_MIN_KBPS)
    have = S.target_kbps(c("target_mb"), c("duration_s"), F.lit(audio))
    need = S.required_mb(floor, c("duration_s"), F.lit(audio))
    ok = have >= floor
    return df.withColumns({
        "viable_kbps": F.when(ok, have).otherwise(floor.cast("bigint")),
        "viable": ok | (need <= c("target_mb") * 1.1), "needs_segments": ~ok & (need > c("target_mb") * 1.1),
    })


# ---------------------------------------------------------------- resolution and frame rate by bits per pixel


def even_width(height: Column, aspect: Column, low: int = 64) -> Column:
    return F.greatest(S.even(S.whole(height * aspect)), F.lit(low).cast("bigint"))


def select_res_fps(assets: DataFrame, bpp_min: float, kbps: str = "kbps", floor_kbps: int = 10, min_fps: float = K.MIN_FPS,
                   min_size: tuple[int, int] | None = None) -> DataFrame:
    """Largest height, then preferred frame rate, that meets the bits-per-pixel floor.

    ``min_size``: (width, height) no picture may go below.  Where it leaves no size at all, the asset's
    own size stays, raised to the minimum.

    Without one, the first candidate at all while the encoder floor holds; below the floor, a
    progressively smaller picture is pointless, so the absolute minimum is returned.
    """
    c = F.col
    aspect = c("width") / c("height")
    rate = c(kbps)
    original = F.when(~c("height").isin(*GRID_HEIGHTS), F.struct(c("width").cast("bigint").alias("w"), c("height").cast("bigint").alias("h")))
    sizes = F.array_compact(F.array(original, *[
        F.when(c("height") >= h, F.struct(even_width(F.lit(h), aspect).alias("w"), F.lit(h).cast("bigint").alias("h"))) for h in GRID_HEIGHTS
    ]))
    low_w, low_h = min_size or (64, 48)
    if min_size:
        allowed = F.filter(sizes, lambda s: (s["w"] >= low_w) & (s["h"] >= low_h))
        raised = F.struct(*[F.greatest(c(n), F.lit(v)).cast("bigint").alias(k) for n, v, k in (("width", low_w, "w"), ("height", low_h, "h"))])
        sizes = F.when(F.size(allowed) > 0, allowed).otherwise(F.array(raised))
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    rates = (
        F.when(c("motion_level") == "low", lit((24, 20, 15, 12, 8, 6, 30)))
        .when(c("fps") >= 30, lit((30, 24, 20, 15, 12, 8, 6)))
        .otherwise(F.concat(lit((24, 20, 15, 12, 8, 6)), F.array(S.whole(c("fps")).cast("double"))))
    )
    staged = assets.withColumns({"_s": sizes, "_f": F.filter(rates, lambda x: x >= min_fps)})
    grid = F.flatten(F.transform("_s", lambda s: F.transform("_f", lambda f: F.struct(s["w"].alias("w"), s["h"].alias("h"), f.alias("f")))))
    staged = staged.withColumn("_g", grid)
    fits = F.filter("_g", lambda g: rate * 1000 / (g["w"] * g["h"] * g["f"]) >= bpp_min)
    staged = staged.withColumn("_fit", first(fits))
    pixels = rate * 1000 / (min_fps * bpp_min)
    max_h = S.whole(F.sqrt(pixels / aspect))
    calc = F.struct(
        F.greatest(F.lit(low_w).cast("bigint"), S.even(S.whole(max_h * aspect))).alias("w"),
        F.greatest(F.lit(low_h).cast("bigint"), S.even(max_h)).alias("h"), F.lit(float(min_fps)).alias("f"),
    )
    least = F.struct(F.lit(low_w).cast("bigint").alias("w"), F.lit(low_h).cast("bigint").alias("h"), F.lit(float(min_fps)).alias("f"))
    calc = F.when(rate * 1000 / (calc["w"] * calc["h"] * min_fps) >= bpp_min, calc).otherwise(least)
    chosen = (
        F.when(rate < floor_kbps, least).when(c("_fit").isNotNull(), c("_fit"))
        .when(F.size("_g") > 0, first(c("_g"))).otherwise(calc)
    )
    out = staged.withColumn("_x", chosen).withColumn("meets_bpp", (rate >= floor_kbps) & c("_fit").isNotNull())
    return out.select("*", F.col("_x.w").alias("sel_w"), F.col("_x.h").alias("sel_h"), F.col("_x.f").alias("sel_fps")).drop("_s", "_f", "_g", "_fit", "_x")


def codec_efficiency(codec_key: Column, complexity: Column) -> Column:
    """Pixels per bit at a complexity of 0-10."""
    return 1.0 / (S.lookup(codec_key, K.CODEC_BASE_BPP, 0.025) * (complexity / 10.0 * 0.4 + 1.0))


def pick_resolution(assets: DataFrame, max_w: str | None = None, max_h: str | None = None) -> DataFrame:
    """Resolution whose pixels the bit budget affords, within scale floors, platform caps and minimum sizes.

    Needs width, height, duration_s, size_bytes, target_mb, complexity (0-10).
    """
    c = F.col
    w, h = c("width").cast("bigint"), c("height").cast("bigint")
    px = S.pixels(w, h)
    original_mb = c("size_bytes") / S.MIB
    bits = c("target_mb") * 8 * S.MIB * 0.88 / c("duration_s")
    affordable = S.whole(bits * codec_efficiency(F.lit("h264_8bit"), c("complexity")) / 24 * 0.35)
    scale = F.greatest(F.sqrt(affordable / px), F.when((px > 1000000) & (px <= 2000000), 0.8).otherwise(0.6))
    scaled = lambda x: F.when(affordable >= px, x).otherwise(S.whole(x * scale))
    out = assets.withColumns({"_w": scaled(w), "_h": scaled(h)})
    if max_w and max_h:
        cut = F.least(F.when(c("_w") > c(max_w), c(max_w) / c("_w")).otherwise(1.0), F.when(c("_h") > c(max_h), c(max_h) / c("_h")).otherwise(1.0))
        out = out.withColumn("_cut", cut).withColumns({"_w": S.whole(c("_w") * c("_cut")), "_h": S.whole(c("_h") * c("_cut"))}).drop("_cut")
    else:
        tall = h > w
        low_w = F.when(tall, F.greatest(F.lit(480), S.whole(w * 0.65))).otherwise(F.greatest(F.lit(640), S.whole(w * 0.6)))
        low_h = F.when(tall, F.greatest(F.lit(640), S.whole(h * 0.65))).otherwise(F.greatest(F.lit(480), S.whole(h * 0.6)))
        out = out.withColumns({"_w": F.greatest("_w", low_w), "_h": F.greatest("_h", low_h)})
    big = px > 1000000
    final_w = F.greatest(S.even(c("_w")), F.when(big, 720).otherwise(480))
    final_h = F.greatest(S.even(c("_h")), F.when(big, 540).otherwise(360))
    roomy = (original_mb > 0) & (c("target_mb") > original_mb * 2)
    capped = lambda x, top: F.when(roomy, top).when(x > top, S.even(top)).otherwise(x)
    return out.withColumns({"pick_w": capped(final_w, w).cast("bigint"), "pick_h": capped(final_h, h).cast("bigint")}).drop("_w", "_h")


def step_down(w: Column, h: Column) -> Column:
    """One step smaller as a struct (w, h)."""
    aspect = w / F.greatest(h, F.lit(1))
    new_h = F.when(F.lit(False), F.lit(0).cast("bigint"))
    for here, below in zip(STEP_HEIGHTS, STEP_HEIGHTS[1:]):
        new_h = new_h.when(h >= here, F.lit(below).cast("bigint"))
    new_h = new_h.otherwise(S.even(S.whole(h * 0.75)))
    return F.struct(S.even(S.whole(new_h * aspect)).alias("w"), new_h.alias("h"))


# ---------------------------------------------------------------- segmentation


def est_mb(kbps: float, duration: Column) -> Column:
    return duration * (kbps * 1000) / (8 * S.MIB) * 1.15


def content_seconds(duration: Column, target_mb: Column, bitrate: Column, complexity: Column, low: float = 45.0, high: float = 240.0) -> Column:
    """Segment length from content: bit budget, complexity factor, and a two-part rule for shorter videos."""
    parts = lambda least, most, unit: F.greatest(F.lit(least), F.least(F.lit(most), S.whole(duration / unit)))
    by_time = duration / F.when(duration <= 300, parts(1, 3, 120)).when(duration <= 600, parts(2, 4, 150)).otherwise(parts(3, 6, 180))
    by_rate = F.least(target_mb * 1.2 * 8 * S.MIB / bitrate * 3, duration / 2)
    base = F.when(bitrate > 0, by_rate).otherwise(by_time)
    base = base * F.when(complexity >= 9, 0.9).when(complexity >= 7, 0.95).when(complexity < 5, 1.15).otherwise(1.0)
    halves = F.greatest(F.least(F.greatest(duration / 2.0, F.lit(low)), F.lit(high)), F.lit(low))
    base = F.when((duration > 0) & (duration <= high * 2.2), halves).otherwise(base)
    return F.greatest(F.lit(low), F.least(F.lit(high), base))


def floor_seconds(target_mb: Column, encoder: Column, low: float = 45.0, high: float = 240.0, margin: float = K.SAFETY_MARGIN) -> Column:
    """Longest segment whose budget still meets the encoder's minimum rate (1024-bit kilobits)."""
    rate = S.lookup(encoder, K.ENCODER_MIN_KBPS, K.DEFAULT_ENCODER_MIN_KBPS) + 64
    return F.greatest(F.lit(low), F.least(F.lit(high), target_mb * 8 * 1024 / rate / margin))


def segment_decision(assets: DataFrame, multiplier: float = 3.0, limit_s: float = 300.0) -> DataFrame:
    """Whether to split, why, and the segment length. Needs duration_s, target_mb, complexity, bitrate, encoder."""
    c = F.col
    d, t = c("duration_s"), c("target_mb")
    reason = (
        F.when(est_mb(600, d) > t * 1.8, "too_large_even_aggressive").when(est_mb(1000, d) > t * multiplier, "size_threshold")
        .when((est_mb(1000, d) > t * 2.2) & (c("complexity") >= 9), "complex_content").when(d > limit_s, "long_duration")
    )
    by_content = content_seconds(d, t, c("bitrate"), c("complexity"))
    short_rate = S.target_kbps(t, d, F.lit(64)) < S.lookup(c("encoder"), K.ENCODER_MIN_KBPS, K.DEFAULT_ENCODER_MIN_KBPS)
    seconds = F.when(short_rate, F.least(floor_seconds(t, c("encoder")), by_content)).otherwise(by_content)
    return assets.withColumn("reason", reason).withColumns({"split": c("reason").isNotNull(), "segment_s": seconds})


def gif_should_segment(gifs: DataFrame, limit_s: float = 180.0, multiplier: float = 2.5, max_mb: float = 10.0, prefer_single: bool = True, max_s: float = 30.0) -> DataFrame:
    """Needs duration_s, width, height; ``current_mb`` (nullable) also triggers."""
    c = F.col
    est = S.gif_size_rough_mb(c("width"), c("height"), c("duration_s"))
    split = (c("duration_s") > limit_s) | (est > max_mb * multiplier) | F.coalesce(c("current_mb") > max_mb * multiplier, F.lit(False))
    if not prefer_single:
        split = split | (c("duration_s") > max_s)
    return gifs.withColumn("split", split)


def segment_bitrate(segments: DataFrame, base_crf: int = 23) -> DataFrame:
    """Rate, CRF, preset and frame rate per segment. Needs start_s, end_s, target_mb, complexity, motion_level, width, height, fps."""
    c = F.col
    d = c("end_s") - c("start_s")
    base = S.whole(c("target_mb") * 8 * S.MIB * 0.85 / d / 1000)
    load = F.when(c("complexity") > 7, 1.2).when(c("complexity") < 3, 0.8).otherwise(1.0)
    px = S.pixels(c("width"), c("height"))
    mult = load * S.lookup(c("motion_level"), {"low": 0.9, "high": 1.1}, 1.0) * F.when(px > 1920 * 1080, 1.3).when(px < 1280 * 720, 0.8).otherwise(1.0)
    crf = F.when(c("complexity") > 7, F.least(F.lit(base_crf + 5), F.lit(35))).when(c("complexity") < 3, F.greatest(F.lit(base_crf - 4), F.lit(18))).otherwise(base_crf)
    return segments.withColumns({
        "segment_kbps": F.greatest(S.whole(base * mult), F.lit(200).cast("bigint")), "segment_crf": crf,
        "segment_preset": S.lookup(c("motion_level"), {"high": "faster", "low": "slower"}, "medium"),
        "segment_fps": F.least(c("fps"), F.when(c("motion_level") == "low", 24.0).otherwise(30.0)),
    })


# ---------------------------------------------------------------- GIF parameters and alternatives

# Fixed reduction bands: below ratio, width exponent, fps exponent, colour exponent, added loss.
GIF_BANDS = ((0.3, 1 / 3, 0.4, 0.3, 120), (0.5, 0.4, 0.5, 0.4, 80), (0.7, 0.5, 0.6, 0.5, 50), (None, 0.6, 0.7, 0.6, 25))


def gif_params(gifs: DataFrame) -> DataFrame:
    """Settings that bring a GIF from ``current_mb`` to ``target_mb``; untouched when already small enough.

    Needs width, height, fps, colors, lossy, motion_level, complexity_level.
    """
    c = F.col
    r = c("target_mb") / c("current_mb")
    band = lambda i: F.when(r < 0.3, F.lit(float(GIF_BANDS[0][i]))).when(r < 0.5, float(GIF_BANDS[1][i])).when(r < 0.7, float(GIF_BANDS[2][i])).otherwise(float(GIF_BANDS[3][i]))
    keep = {"low": 0.85, "high": 1.15}
    near = lambda x: F.bround(x, 0).cast("bigint")
    half = lambda x: F.floor(x / 2) * 2
    size = F.pow(r, band(1))
    new = {
        "gif_w": F.greatest(F.lit(360).cast("bigint"), half(c("width") * size)), "gif_h": F.greatest(F.lit(360).cast("bigint"), half(c("height") * size)),
        "gif_fps": F.greatest(F.lit(15).cast("bigint"), near(c("fps") * (F.pow(r, band(2)) * S.lookup(c("motion_level"), keep, 1.0)))),
        "gif_colors": S.clamp(near(c("colors") * (F.pow(r, band(3)) * S.lookup(c("complexity_level"), keep, 1.0))), 128, 256).cast("bigint"),
        "gif_lossy": F.least(F.lit(120), c("lossy") + band(4)).cast("bigint"),
    }
    old = {"gif_w": "width", "gif_h": "height", "gif_fps": "fps", "gif_colors": "colors", "gif_lossy": "lossy"}
    small = c("current_mb") <= c("target_mb")
    return gifs.withColumns({k: F.when(small, c(old[k]).cast("bigint")).otherwise(v) for k, v in new.items()})


def alternatives(assets: DataFrame) -> DataFrame:
    """Feasible alternatives to lowering the frame rate, in order. Needs width, height, fps, target_fps, duration_s, target_mb, size_bytes."""
    c = F.col
    nw, nh = S.whole(c("width") * 0.8), S.whole(c("height") * 0.8)
    rate = F.greatest(S.whole((c("target_mb") * 8 * S.MIB - c("duration_s") * 64000) / c("duration_s") / 1000), F.lit(32).cast("bigint"))
    parts = F.greatest(F.lit(2).cast("bigint"), S.whole(c("duration_s") / 120))
    none = F.lit(None).cast("bigint")

    def alt(kind, ok, w=none, h=none, kbps=none, crf=none, n=none):
        return F.struct(F.lit(kind).alias("alternative"), w.alias("alt_w"), h.alias("alt_h"), kbps.alias("alt_kbps"), crf.alias("alt_crf"),
                        n.alias("alt_segments"), ok.alias("ok"))

    listed = F.array_compact(F.array(
        F.when(c("target_fps") < c("fps"), alt("resolution_reduction", (nw >= K.MIN_WIDTH) & (nh >= K.MIN_HEIGHT), nw, nh)),
        alt("quality_adjustment", F.lit(True), crf=F.lit(28).cast("bigint")),
        alt("bitrate_optimization", rate >= 32, kbps=rate),
        F.when(c("target_mb") < c("size_bytes") / S.MIB / 3, alt("segmentation", c("duration_s") > 60, n=parts)),
    ))
    out = assets.select("asset_id", F.posexplode(F.filter(listed, lambda a: a["ok"])).alias("rank", "_a"))
    return out.select("asset_id", "rank", "_a.*").drop("ok")
