"""Frame kernels over a table of decoded pixels (video_id, frame_idx, ts_s, w, h, pixels).

Hashes and histograms are plain column expressions.  Filters, gradients and spectra are numpy
kernels in Arrow-batched pandas UDFs: frames of one shape in a batch are stacked and handled
together.  Borders reflect without repeating the edge pixel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# ---------------------------------------------------------------- column expressions


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)


def average_hash(frames: DataFrame) -> DataFrame:
    """64-bit hash of an 8x8 grey frame: a bit is set where the pixel is above the mean; first pixel on top."""
    staged = frames.select("video_id", "frame_idx", "pixels", (array_sum(F.col("pixels")) / F.size("pixels")).alias("_m"))
    # The mean is referenced with the pixel count, so it stays one column and is not recomputed per pixel.
    scaled = F.transform("pixels", lambda x: x * F.size("pixels") > F.col("_m") * F.size("pixels"))
    bit = lambda acc, on: F.shiftleft(acc, 1).bitwiseOR(on.cast("bigint"))
    return staged.select("video_id", "frame_idx", F.aggregate(scaled, F.lit(0).cast("bigint"), bit).alias("hash"))


def sample_indices(total: Column, count: int) -> Column:
    """Step between ``count`` evenly spaced frames of ``total``."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(total / count))


def frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n"))


def sample_frames(frames: DataFrame, keyframes: int, extra: int, seed: int = 7) -> DataFrame:
    """Evenly spaced frames plus a fixed pseudo-random choice of ``extra`` others per video.

    The choice takes the lowest hashes of (video, frame, seed): repeatable, and cut before the shuffle.
    """
    from pyspark.sql.window import Window

    n = frame_counts(frames.select("video_id", "frame_idx"))
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n") / (keyframes + 1)))
    at = F.col("frame_idx")
    even = (at % step == 0) & (at >= step) & (at <= step * keyframes)
    slim = frames.select("video_id", "frame_idx").join(n, "video_id").withColumn("_even", even)
    key = F.md5(F.concat_ws(":", F.col("video_id").cast("string"), F.col("frame_idx").cast("string"), F.lit(str(seed))))
    w = Window.partitionBy("video_id").orderBy("_k", "frame_idx")
    lucky = slim.where(~F.col("_even")).withColumn("_k", key).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= extra)
    return slim.where("_even").select("video_id", "frame_idx", F.lit("even").alias("pick")).unionByName(
        lucky.select("video_id", "frame_idx", F.lit("random").alias("pick")))


def asset_phash(frames: DataFrame, count: int = 10) -> DataFrame:
    """Up to ``count`` evenly sampled frame hashes per video, in order."""
    n = frame_counts(frames.select("video_id", "frame_idx"))
    step = sample_indices(F.col("n"), count)
    picked = frames.join(n, "video_id").where((F.col("frame_idx") % step == 0) & (F.col("frame_idx") < step * count))
    hashed = average_hash(picked)
    return hashed.groupBy("video_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", "hash"))), lambda x: x["hash"]).alias("hashes")
    )


def histograms(frames: DataFrame, bins: int = 16) -> DataFrame:
    """Pixel counts in ``bins`` equal ranges of 0-255, as an array in bin order."""
    width = 256 // bins
    mapped = F.transform("pixels", lambda x: F.least(F.lit(bins - 1), F.floor(x / width)).cast("int"))
    zero = F.array_repeat(F.lit(0).cast("bigint"), bins)
    count = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter("_b", lambda x: x == b)).cast("bigint"))
    staged = frames.withColumn("_b", mapped)
    return staged.select("video_id", "frame_idx", F.when(F.size("_b") > 0, count).otherwise(zero).alias("hist"))


def intersection(a: Column, b: Column) -> Column:
    """Shared mass of two histograms after normalising each to 1."""
    sa, sb = array_sum(a).cast("double"), array_sum(b).cast("double")
    low = F.zip_with(a, b, lambda x, y: F.least(x / sa, y / sb))
    return F.aggregate(low, F.lit(0.0), lambda s, x: s + x)


def frame_validity(frames: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """50 x share readable + 50 x share valid (sane size, not black or white); 50 when nothing was sampled."""
    mean = array_sum(F.col("pixels")) / F.size("pixels")
    ok = (F.col("w") > 10) & (F.col("h") > 10) & (F.col("w") < 5000) & (F.col("h") < 5000) & (mean > 5) & (mean < 250)
    read = F.col("pixels").isNotNull()
    n = F.count(F.lit(1))
    agg = frames.groupBy("video_id").agg(
        n.alias("sampled"),
        (F.count_if(read) / n * 50 + F.count_if(read & ok) / n * 50).alias("validity"),
    )
    if expected is None:
        return agg
    return expected.join(agg, "video_id", "left").fillna({"sampled": 0, "validity": 50.0})


def scene_level(features: DataFrame) -> DataFrame:
    """Per video: complexity level, palette statistics mode and dither from colour and gradient features."""
    agg = features.groupBy("video_id").agg(
        F.avg("color_complexity").alias("avg_color"), F.max("color_complexity").alias("max_color"),
        F.coalesce(F.avg("gradient_score"), F.lit(0.5)).alias("avg_gradient"),
    )
    c, top, g = F.col("avg_color"), F.col("max_color"), F.col("avg_gradient")
    level = F.when((c > 7) | (top > 8.5) | (g > 0.3), "high").when((c > 4) | (g > 0.15), "medium").otherwise("low")
    return agg.withColumn("complexity_level", level).withColumns(
        {
            "stats_mode": F.when(F.col("complexity_level") == "high", "full").otherwise("diff"),
            "dither": F.when(F.col("complexity_level") == "low", "bayer").otherwise("floyd_steinberg"),
        }
    )


# ---------------------------------------------------------------- numpy kernels on stacks (n, h, w)


def padded(a: np.ndarray, r: int) -> np.ndarray:
    mode = "reflect" if min(a.shape[1:]) > r else "edge"
    return np.pad(a, ((0, 0), (r, r), (r, r)), mode=mode)


def filter2d(a: np.ndarray, kernel) -> np.ndarray:
    k = np.asarray(kernel, dtype=float)
    r = k.shape[0] // 2
    p, (_, h, w) = padded(a, r), a.shape
    out = np.zeros(a.shape)
    for i in range(k.shape[0]):
        for j in range(k.shape[1]):
            if k[i, j]:
                out += k[i, j] * p[:, i:i + h, j:j + w]
    return out


# Fixed 3x3 kernels.
SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
SOBEL_Y = ((-1, -2, -1), (0, 0, 0), (1, 2, 1))
LAPLACE = ((0, 1, 0), (1, -4, 1), (0, 1, 0))
GRAIN = ((-1, -1, -1), (-1, 8, -1), (-1, -1, -1))


def flat_mean(a: np.ndarray) -> np.ndarray:
    return a.reshape(len(a), -1).mean(axis=1)


def flat_var(a: np.ndarray) -> np.ndarray:
    return a.reshape(len(a), -1).var(axis=1)


def gradients(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return filter2d(a, SOBEL_X), filter2d(a, SOBEL_Y)


def magnitude(a: np.ndarray) -> np.ndarray:
    gx, gy = gradients(a)
    return np.sqrt(gx * gx + gy * gy)


def grey(a: np.ndarray) -> np.ndarray:
    """(n, h, w, 3) red-green-blue to rounded grey."""
    return np.rint(a[..., 0] * 0.299 + a[..., 1] * 0.587 + a[..., 2] * 0.114)


def blockiness_of(a: np.ndarray) -> np.ndarray:
    gx, gy = (np.abs(g) for g in gradients(a))
    rows, cols = gy.sum(axis=2), gx.sum(axis=1)
    edge = rows[:, 8::8].sum(axis=1) + cols[:, 8::8].sum(axis=1)
    edge = edge + 1.5 * (rows[:, 16::16].sum(axis=1) + cols[:, 16::16].sum(axis=1))
    total = gx.sum(axis=(1, 2)) + gy.sum(axis=(1, 2))
    return np.where(total > 0, np.minimum(1.0, edge / np.where(total > 0, total, 1) * 3.0), 0.0)


def banding_of(a: np.ndarray) -> np.ndarray:
    g = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    g /= g.sum()
    mag = magnitude(np.rint(filter2d(a, np.outer(g, g))))
    low = np.stack([np.histogram(m, bins=50, range=(0, 255))[0][:15] for m in mag])
    return np.where(low.sum(axis=1) > 0, np.minimum(1.0, low.var(axis=1) / 100.0), 0.0)


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, h, w = a.shape
    mag = np.abs(np.fft.fftshift(np.fft.fft2(a), axes=(1, 2)))
    y, x = np.ogrid[:h, :w]
    return mag, np.sqrt((x - w // 2) ** 2 + (y - h // 2) ** 2)


def fft_detail(a: np.ndarray) -> np.ndarray:
    mag, dist = spectrum(a)
    far = dist > min(a.shape[1] // 2, a.shape[2] // 2) * 0.7
    total = mag.sum(axis=(1, 2))
    return np.where(total > 0, np.minimum(1.0, mag[:, far].sum(axis=1) / np.where(total > 0, total, 1) * 10), 0.5)


def sharpness_of(a: np.ndarray) -> dict:
    return {"laplacian_var": flat_var(filter2d(a, LAPLACE)), "sobel_var": flat_var(magnitude(a)), "fft_score": fft_detail(a)}


def noise_of(a: np.ndarray) -> dict:
    noise = flat_var(filter2d(a, LAPLACE)) / 36.0
    ratio = flat_var(a) / np.where(noise > 0, noise, 1)
    snr = np.where(ratio > 0, 10 * np.log10(np.where(ratio > 0, ratio, 1)), 0.0)
    grain = np.minimum(1.0, flat_mean(np.abs(filter2d(a, GRAIN))) / 50.0)
    return {"noise_var": noise, "snr_db": np.where(noise > 0, np.maximum(0.0, snr), 20.0), "grain": grain}


def local_variance(a: np.ndarray, size: int) -> np.ndarray:
    box = np.full((size, size), 1.0 / (size * size))
    return filter2d((a - filter2d(a, box)) ** 2, box)


def texture_of(rgb: np.ndarray) -> dict:
    g = grey(rgb)
    floor_grey = np.floor(rgb.mean(axis=3))
    wrap = lambda d: np.abs(d) if d.size else np.zeros((len(rgb), 1, 1))
    gradient = (flat_mean(wrap(np.diff(floor_grey, axis=2))) + flat_mean(wrap(np.diff(floor_grey, axis=1)))) / 255.0
    unique = np.array([len(np.unique(f.reshape(-1, 3), axis=0)) for f in rgb])
    return {
        "texture": np.minimum(1.0, flat_mean(local_variance(g, 3)) / 1000.0),
        "color_variance": rgb.reshape(len(rgb), -1, 3).var(axis=1).mean(axis=1),
        "gradient_magnitude": flat_mean(magnitude(g)),
        "color_complexity": np.minimum(10.0, unique / 1000.0),
        "gradient_score": gradient,
    }


def spatial_of(a: np.ndarray) -> np.ndarray:
    texture = np.minimum(10.0, flat_mean(np.sqrt(np.maximum(0, local_variance(a, 5)))) / 20)
    mag, dist = spectrum(a)
    outside = ~(dist ** 2 < (min(a.shape[1:]) // 4) ** 2)
    freq = np.minimum(10.0, np.log(mag + 1)[:, outside].mean(axis=1) / 5)
    lap = np.minimum(10.0, flat_var(filter2d(a, LAPLACE)) / 100)
    grad = np.minimum(10.0, flat_mean(magnitude(a)) / 50)
    return np.minimum(10.0, lap * 0.3 + grad * 0.3 + texture * 0.2 + freq * 0.2)


def content_of(rgb: np.ndarray) -> dict:
    top, low = rgb.max(axis=3), rgb.min(axis=3)
    span = top - low
    safe = np.where(span > 0, span, 1)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    hue = np.where(top == r, (g - b) / safe, np.where(top == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    hue = np.where(span > 0, np.mod(hue, 360), 0)
    hue = np.mod(np.rint(hue / 2), 180)
    sat = np.where(top > 0, np.rint(span / np.where(top > 0, top, 1) * 255), 0)

    def spread(values, size):
        hist = np.stack([np.bincount(v.ravel().astype(int), minlength=size)[:size] for v in values])
        return (hist > hist.max(axis=1, keepdims=True) * 0.01).sum(axis=1)

    var = rgb.reshape(len(rgb), -1, 3).var(axis=1).mean(axis=1)
    color = (
        np.minimum(10, spread(hue, 180) / 20) * 0.4 + np.minimum(10, spread(sat, 256) / 30) * 0.3 + np.minimum(10, var / 1000) * 0.3
    )
    return {
        "color_complexity": color,
        "motion_estimate": np.minimum(10.0, flat_mean(magnitude(grey(rgb))) / 20),
        "color_variance": np.minimum(10.0, var / 500),
    }


def correlation_blocks(a: np.ndarray, b: np.ndarray, size: int = 16) -> np.ndarray:
    """Mean normalised correlation of corresponding blocks (0.5 for frames without a full block)."""
    _, h, w = a.shape
    scores = []
    for y in range(0, h - size, size):
        for x in range(0, w - size, size):
            p, q = (z[:, y:y + size, x:x + size].reshape(len(z), -1) for z in (a, b))
            p, q = p - p.mean(axis=1, keepdims=True), q - q.mean(axis=1, keepdims=True)
            den = np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
            scores.append(np.where(den > 0, (p * q).sum(axis=1) / np.where(den > 0, den, 1), 0.0))
    return np.mean(scores, axis=0) if scores else np.full(len(a), 0.5)


def resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area-mean resize for dividing sizes, else pixel centres with linear weights."""
    n, H, W = a.shape
    if H % h == 0 and W % w == 0:
        return np.rint(a.reshape(n, h, H // h, w, W // w).mean(axis=(2, 4)))

    def axis(length, new):
        pos = np.clip((np.arange(new) + 0.5) * length / new - 0.5, 0, length - 1)
        low = np.floor(pos).astype(int)
        return low, np.minimum(low + 1, length - 1), pos - low

    y0, y1, fy = axis(H, h)
    x0, x1, fx = axis(W, w)
    rows = a[:, y0] * (1 - fy)[None, :, None] + a[:, y1] * fy[None, :, None]
    return np.rint(rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx)


def difference_bits(a: np.ndarray, size: int = 8) -> np.ndarray:
    small = resize(a, 2 * size, 2 * size)[:, :size, :size + 1]  # the hash reads the top-left quarter
    return (small[:, :, :-1] > small[:, :, 1:]).reshape(len(a), -1)


def perceptual_of(a: np.ndarray, b: np.ndarray) -> dict:
    """Difference-hash similarity and PSNR blended 0.7 / 0.3, on a 0-100 scale."""
    bits_a, bits_b = difference_bits(a), difference_bits(b)
    same = 1 - (bits_a != bits_b).sum(axis=1) / bits_a.shape[1]
    mse = flat_mean((a - b) ** 2)
    psnr = np.where(mse > 0, 20 * np.log10(255.0 / np.sqrt(np.where(mse > 0, mse, 1))), 100.0)
    return {"hash_similarity": same, "psnr": psnr, "perceptual": 100 * (same * 0.7 + np.clip((psnr - 20) / 30, 0, 1) * 0.3)}


def stacked(fn: Callable, pixels: list[pd.Series], h: pd.Series, w: pd.Series, channels: int) -> pd.DataFrame:
    """Apply a stack kernel to a batch, one call per distinct frame shape; rows keep their order."""
    shapes = pd.DataFrame({"h": h.to_numpy(), "w": w.to_numpy()})
    parts = []
    for (hh, ww), rows in shapes.groupby(["h", "w"]).indices.items():
        dims = (len(rows), int(hh), int(ww)) + ((channels,) if channels > 1 else ())
        stacks = [np.stack([np.asarray(x, dtype=float) for x in p.iloc[rows]]).reshape(dims) for p in pixels]
        out = fn(*stacks)
        parts.append(pd.DataFrame(out if isinstance(out, dict) else {"value": out}, index=rows))
    return pd.concat(parts).sort_index() if parts else pd.DataFrame()


def kernel(fn: Callable, names: tuple[str, ...], channels: int = 1, inputs: int = 1):
    """A pandas UDF returning a double (one name) or a struct of doubles."""
    schema = "double" if len(names) == 1 else ", ".join(f"{n} double" for n in names)

    if inputs == 1:
        def run(p: pd.Series, h: pd.Series, w: pd.Series):
            out = stacked(fn, [p], h, w, channels)
            return out["value"] if len(names) == 1 else out[list(names)]
    else:
        def run(p: pd.Series, q: pd.Series, h: pd.Series, w: pd.Series):
            out = stacked(fn, [p, q], h, w, channels)
            return out["value"] if len(names) == 1 else out[list(names)]

    result = pd.Series if len(names) == 1 else pd.DataFrame
    run.__annotations__ = {k: (result if k == "return" else pd.Series) for k in (*run.__code__.co_varnames[:inputs + 2], "return")}
    return F.pandas_udf(run, schema)


def _apply(frames: DataFrame, fn: Callable, names: tuple[str, ...], channels: int = 1) -> DataFrame:
    value = kernel(fn, names, channels)("pixels", "h", "w")
    out = frames.select("video_id", "frame_idx", value.alias("_v"))
    cols = [F.col("_v").alias(names[0])] if len(names) == 1 else [F.col(f"_v.{n}").alias(n) for n in names]
    return out.select("video_id", "frame_idx", *cols)


def blockiness(frames: DataFrame) -> DataFrame:
    return _apply(frames, blockiness_of, ("blockiness",))


def banding(frames: DataFrame) -> DataFrame:
    return _apply(frames, banding_of, ("banding",))


def sharpness(frames: DataFrame) -> DataFrame:
    return _apply(frames, sharpness_of, ("laplacian_var", "sobel_var", "fft_score"))


def noise(frames: DataFrame) -> DataFrame:
    return _apply(frames, noise_of, ("noise_var", "snr_db", "grain"))


def texture_colour(frames: DataFrame) -> DataFrame:
    names = ("texture", "color_variance", "gradient_magnitude", "color_complexity", "gradient_score")
    return _apply(frames, texture_of, names, 3)


def spatial_complexity(frames: DataFrame) -> DataFrame:
    return _apply(frames, spatial_of, ("spatial",))


def content_frames(frames: DataFrame) -> DataFrame:
    return _apply(frames, content_of, ("color_complexity", "motion_estimate", "color_variance"), 3)


def content_scores_10(frames: DataFrame, motion: DataFrame) -> DataFrame:
    """Per video 0-10 scores. ``motion``: video_id, motion (0-10 per frame)."""
    per = content_frames(frames).groupBy("video_id").agg(
        F.avg("color_complexity").alias("color_complexity"), F.avg("motion_estimate").alias("motion_estimate"),
        F.avg("color_variance").alias("color_variance"),
    )
    moved = motion.groupBy("video_id").agg(F.avg("motion").alias("_m"), F.var_pop("motion").alias("_v"))
    stability = 10 - (F.coalesce("_m", F.lit(5.0)) * 0.7 + F.coalesce("_v", F.lit(2.0)) * 0.3)
    j = per.join(moved, "video_id", "left")
    return j.withColumn("temporal_stability", F.greatest(F.lit(0.0), F.least(stability, F.lit(10.0)))).drop("_m", "_v")


def with_previous_pixels(frames: DataFrame) -> DataFrame:
    from reelscope.operators import blocks as B

    base = frames.select("video_id", "frame_idx", "ts_s", "w", "h", "pixels")
    return B.carried(base, ["video_id"], ["frame_idx"], previous={"prev_pixels": "pixels"})


def block_motion(frames: DataFrame) -> DataFrame:
    udf = kernel(correlation_blocks, ("consistency",), inputs=2)
    pairs = with_previous_pixels(frames).where("prev_pixels IS NOT NULL")
    return pairs.select("video_id", "frame_idx", udf("prev_pixels", "pixels", "h", "w").alias("consistency"))


def perceptual_pair(pairs: DataFrame) -> DataFrame:
    """Pairs of equally large frames: orig_pixels, comp_pixels, h, w plus key columns."""
    names = ("hash_similarity", "psnr", "perceptual")
    udf = kernel(perceptual_of, names, inputs=2)
    keys = [c for c in pairs.columns if c not in ("orig_pixels", "comp_pixels", "h", "w")]
    out = pairs.select(*keys, udf("orig_pixels", "comp_pixels", "h", "w").alias("_v"))
    return out.select(*keys, *[F.col(f"_v.{n}").alias(n) for n in names])


# ---------------------------------------------------------------- video-level features

BLUR_SCALE = 100.0
NOISE_SCALE = 0.1


def artifact_gate(metrics: DataFrame, block_limit: float = 0.12, band_limit: float = 0.10) -> DataFrame:
    agg = metrics.groupBy("video_id").agg(F.avg("blockiness").alias("blockiness"), F.avg("banding").alias("banding"))
    b, d = F.col("blockiness") <= block_limit, F.col("banding") <= band_limit
    return agg.withColumns({"blockiness_ok": b, "banding_ok": d, "passes": b & d})


def spread_confidence(*parts: Column) -> Column:
    """1 - population standard deviation of the parts, within 0-1."""
    m = sum(parts[1:], parts[0]) / len(parts)
    ss = [(p - m) * (p - m) for p in parts]
    dev = F.sqrt(sum(ss[1:], ss[0]) / len(parts))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dev))


def video_features(metrics: DataFrame) -> DataFrame:
    """Frame metrics to video composites and an overall quality score.

    Needs laplacian_var, sobel_var, fft_score, noise_var, snr_db, grain, edge_density, texture,
    color_variance, gradient_magnitude, and for later frames flow, frame_diff, consistency (nullable).
    """
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    names = ("laplacian_var", "sobel_var", "fft_score", "noise_var", "snr_db", "grain", "edge_density", "texture",
             "color_variance", "gradient_magnitude", "flow", "frame_diff")
    agg = metrics.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("frames"), *[zero(c) for c in names],
        F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.coalesce(F.avg("consistency"), F.lit(1.0))).alias("consistency"),
    )
    one = lambda c: F.least(F.lit(1.0), c)
    lap, sob, fft = one(F.col("laplacian_var") / BLUR_SCALE), one(F.col("sobel_var") / (BLUR_SCALE * 2)), F.col("fft_score")
    noi, snr, gra = one(F.col("noise_var") / NOISE_SCALE), one(F.greatest(F.lit(0.0), F.col("snr_db") / 40.0)), F.col("grain")
    complexity = (
        one(F.col("edge_density") * 10) * 0.3 + F.col("texture") * 0.3 + one(F.col("color_variance") / 1000) * 0.2
        + one(F.col("gradient_magnitude") / 100) * 0.2
    )
    motion = one(F.col("flow") / 50) * 0.5 + one(F.col("frame_diff") / 100) * 0.5
    out = agg.withColumns(
        {
            "blur_score": lap * 0.5 + sob * 0.3 + fft * 0.2, "blur_confidence": spread_confidence(lap, sob, fft),
            "noise_score": noi * 0.4 + (1 - snr) * 0.4 + gra * 0.2, "noise_confidence": spread_confidence(noi, 1 - snr, gra),
            "complexity_score": complexity, "motion_score": motion,
            "temporal_stability": 1.0 - motion,
        }
    )
    overall = (
        F.col("blur_score") * 0.35 + (1 - F.col("noise_score")) * 0.25 + F.col("complexity_score") * 0.20
        + F.col("temporal_stability") * 0.20
    )
    return out.withColumn("overall_quality", F.greatest(F.lit(0.0), F.least(F.lit(1.0), overall)))
