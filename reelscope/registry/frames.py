"""Queries for frame kernels and video-level features."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.operators import frames as FR, joins as J, windows as W
from reelscope.registry.base import query
from reelscope.registry.joins import HASHES, bit_text
from reelscope.sources import views as V


def colour(spark, sf):
    """Every value of a frame as one red-green-blue point: the value, its negative, and its double (in a byte)."""
    rgb = F.flatten(F.transform("pixels", lambda x: F.array(x, 255 - x, x * 2 % 256)))
    return V.v_frames(spark, sf).select("video_id", "frame_idx", "ts_s", "w", "h", rgb.alias("pixels"))


@query("average_hash", "SELECT asset_id // 1000000 AS video_id, asset_id % 1000000 AS frame_idx, bits FROM hashes", "v_frames", hashes=HASHES)
def _(spark, sf):
    return FR.average_hash(V.v_frames(spark, sf)).select("video_id", "frame_idx", bit_text(F.col("hash")).alias("bits"))


@query(
    "asset_phash",
    """SELECT video_id, list(bits ORDER BY frame_idx) AS bits FROM (SELECT h.*, max(frame_idx) OVER (PARTITION BY video_id) + 1 AS n FROM (SELECT asset_id // 1000000 AS video_id, asset_id % 1000000 AS frame_idx, bits FROM hashes) h)
    WHERE frame_idx % greatest(1, n // 10) = 0 AND frame_idx < greatest(1, n // 10) * 10 GROUP BY video_id""",
    "v_frames", hashes=HASHES,
)
def _(spark, sf):
    return FR.asset_phash(V.v_frames(spark, sf)).select("video_id", F.transform("hashes", lambda h: bit_text(h)).alias("bits"))


def frame_pairs(spark, sf):
    f = V.v_frames(spark, sf)
    orig = f.select("video_id", "frame_idx", "pixels", "h", "w")
    comp = f.select("video_id", "frame_idx", F.transform("pixels", lambda x: (x + 3) % 256).alias("pixels"))
    return J.pair(orig, comp, ["video_id", "frame_idx"]).withColumnsRenamed({"orig_h": "h", "orig_w": "w"})


# The 9 x 8 corner of both frames, enlarged to 16 x 16 with linear weights: the hash compares its neighbours.
ENLARGED = """SELECT video_id, frame_idx, y, x, round_even((p[8 * y0 + x0 + 1] * (1 - fy) + p[8 * y1 + x0 + 1] * fy) * (1 - fx) + (p[8 * y0 + x1 + 1] * (1 - fy) + p[8 * y1 + x1 + 1] * fy) * fx, 0) AS a,
    round_even((q[8 * y0 + x0 + 1] * (1 - fy) + q[8 * y1 + x0 + 1] * fy) * (1 - fx) + (q[8 * y0 + x1 + 1] * (1 - fy) + q[8 * y1 + x1 + 1] * fy) * fx, 0) AS b
  FROM (SELECT video_id, frame_idx, pixels AS p, list_transform(pixels, lambda v: (v + 3) % 256) AS q, y, x, CAST(floor(py) AS INT) AS y0, CAST(floor(py) AS INT) + 1 AS y1, py - floor(py) AS fy,
      CAST(floor(px) AS INT) AS x0, CAST(floor(px) AS INT) + 1 AS x1, px - floor(px) AS fx
    FROM v_frames CROSS JOIN (SELECT i // 9 AS y, i % 9 AS x, greatest(0.0e0, (i // 9) / 2.0e0 - 0.25e0) AS py, greatest(0.0e0, (i % 9) / 2.0e0 - 0.25e0) AS px FROM range(0, 72) t(i)))"""


@query(
    "dhash_pair",
    """SELECT video_id, frame_idx, hash_similarity, psnr, 100 * (hash_similarity * 0.7e0 + least(1.0e0, greatest(0.0e0, (psnr - 20) / 30)) * 0.3e0) AS perceptual FROM (
    SELECT video_id, frame_idx, 1 - count(*) FILTER ((a > a_next) <> (b > b_next)) / 64.0e0 AS hash_similarity FROM (
      SELECT *, lead(a) OVER w AS a_next, lead(b) OVER w AS b_next FROM enlarged WINDOW w AS (PARTITION BY video_id, frame_idx, y ORDER BY x)) WHERE x < 8 GROUP BY video_id, frame_idx)
    JOIN (SELECT video_id, frame_idx, CASE WHEN mse > 0 THEN 20 * log10(255 / sqrt(mse)) ELSE 100.0e0 END AS psnr FROM (
      SELECT video_id, frame_idx, list_avg(list_transform(pixels, lambda v: pow(v - (v + 3) % 256, 2))) AS mse FROM v_frames)) USING (video_id, frame_idx)""",
    "v_frames", "hash_similarity psnr perceptual", enlarged=ENLARGED,
)
def _(spark, sf):
    return FR.perceptual_pair(frame_pairs(spark, sf))


# SQL twins of the kernels, over one row per pixel of the 8 x 8 frames.
PX = "SELECT video_id, frame_idx, i // 8 AS y, i % 8 AS x, pixels AS p, CAST(pixels[i + 1] AS DOUBLE) AS v FROM v_frames CROSS JOIN range(0, 64) t(i)"


def convolved(kernel, of: str = "p") -> str:
    """SQL of a filter at (y, x) over a frame held as a list, with reflected borders."""
    r = len(kernel) // 2
    place = lambda axis, d: f"(7 - abs(7 - abs({axis} + {d})))"
    return " + ".join(
        f"({float(k)!r}e0 * {of}[8 * {place('y', i - r)} + {place('x', j - r)} + 1])".replace("e0e0", "e0")
        for i, row in enumerate(kernel) for j, k in enumerate(row) if k
    )


def box(size: int):
    return [[1.0 / size ** 2] * size] * size


def variance_ctes(size: int, source: str) -> dict[str, str]:
    """CTEs ending in ``lv``: the local variance of every pixel of ``source``, boxes of ``size``."""
    return {
        "away": f"SELECT video_id, frame_idx, list(pow(p[8 * y + x + 1] - ({convolved(box(size))}), 2) ORDER BY y, x) AS p FROM {source} GROUP BY video_id, frame_idx",
        "lv": f"SELECT video_id, frame_idx, {convolved(box(size))} AS lv FROM away CROSS JOIN (SELECT i // 8 AS y, i % 8 AS x FROM range(0, 64) t(i))",
    }


GRADIENTS = f"SELECT *, sqrt(gx * gx + gy * gy) AS mag FROM (SELECT *, {convolved(FR.SOBEL_X)} AS gx, {convolved(FR.SOBEL_Y)} AS gy, {convolved(FR.LAPLACE)} AS lap, {convolved(FR.GRAIN)} AS grain FROM px)"
SPECTRUM = """SELECT video_id, frame_idx, fy * fy + fx * fx AS far, sqrt(pow(sum(v * cos(2 * pi() * (fy * y + fx * x) / 8)), 2) + pow(sum(v * sin(2 * pi() * (fy * y + fx * x) / 8)), 2)) AS power
  FROM px CROSS JOIN range(-4, 4) a(fy) CROSS JOIN range(-4, 4) b(fx) GROUP BY video_id, frame_idx, fy, fx"""
BLOCKY = """SELECT video_id, frame_idx, CASE WHEN sum(abs(gx) + abs(gy)) > 0 THEN least(1.0e0, sum(CASE WHEN y >= 8 AND y % 8 = 0 THEN abs(gy) * CASE WHEN y % 16 = 0 THEN 2.5e0 ELSE 1 END ELSE 0 END
    + CASE WHEN x >= 8 AND x % 8 = 0 THEN abs(gx) * CASE WHEN x % 16 = 0 THEN 2.5e0 ELSE 1 END ELSE 0 END) / sum(abs(gx) + abs(gy)) * 3) ELSE 0.0e0 END AS blockiness FROM grad GROUP BY video_id, frame_idx"""
BELL = [2.718281828459045 ** (-(i * i) / 2.0) for i in range(-2, 3)]
GAUSS = [[a * b / sum(BELL) ** 2 for b in BELL] for a in BELL]
SMOOTH = f"SELECT video_id, frame_idx, list(round_even({convolved(GAUSS)}, 0) ORDER BY y, x) AS p FROM px GROUP BY video_id, frame_idx"
SMOOTH_PX = "SELECT video_id, frame_idx, p, y, x FROM smooth CROSS JOIN (SELECT i // 8 AS y, i % 8 AS x FROM range(0, 64) t(i))"
STEEP = f"SELECT video_id, frame_idx, floor(sqrt(pow({convolved(FR.SOBEL_X)}, 2) + pow({convolved(FR.SOBEL_Y)}, 2)) * 50 / 255) AS bin FROM smooth_px"
BANDED = """SELECT video_id, frame_idx, CASE WHEN sum(n) > 0 THEN least(1.0e0, var_pop(n) / 100) ELSE 0.0e0 END AS banding FROM (
    SELECT video_id, frame_idx, b, count(*) FILTER (bin = b) AS n FROM steep CROSS JOIN range(0, 15) t(b) GROUP BY video_id, frame_idx, b) GROUP BY video_id, frame_idx"""
BAND_CTES = {"px": PX, "smooth": SMOOTH, "smooth_px": SMOOTH_PX, "steep": STEEP}


@query("blockiness", BLOCKY, "v_frames", "blockiness", px=PX, grad=GRADIENTS)
def _(spark, sf):
    return FR.blockiness(V.v_frames(spark, sf))


@query("banding", BANDED, "v_frames", "banding", **BAND_CTES)
def _(spark, sf):
    return FR.banding(V.v_frames(spark, sf))


@query(
    "sharpness",
    """SELECT video_id, frame_idx, laplacian_var, sobel_var, fft_score FROM (SELECT video_id, frame_idx, avg(lap * lap) - pow(avg(lap), 2) AS laplacian_var, var_pop(mag) AS sobel_var FROM grad GROUP BY video_id, frame_idx)
    JOIN (SELECT video_id, frame_idx, CASE WHEN sum(power) > 0 THEN least(1.0e0, sum(power) FILTER (far > 7.84e0) / sum(power) * 10) ELSE 0.5e0 END AS fft_score FROM spectrum GROUP BY video_id, frame_idx) USING (video_id, frame_idx)""",
    "v_frames", "laplacian_var sobel_var fft_score", px=PX, grad=GRADIENTS, spectrum=SPECTRUM,
)
def _(spark, sf):
    return FR.sharpness(V.v_frames(spark, sf))


@query(
    "noise",
    """SELECT video_id, frame_idx, noise_var, CASE WHEN noise_var > 0 THEN CASE WHEN flat > 0 THEN greatest(0.0e0, 10 * log10(flat / noise_var)) ELSE 0.0e0 END ELSE 20.0e0 END AS snr_db, grain
    FROM (SELECT video_id, frame_idx, (avg(lap * lap) - pow(avg(lap), 2)) / 36 AS noise_var, avg(v * v) - pow(avg(v), 2) AS flat, least(1.0e0, avg(abs(grain)) / 50) AS grain FROM grad GROUP BY video_id, frame_idx)""",
    "v_frames", "noise_var snr_db grain", px=PX, grad=GRADIENTS,
)
def _(spark, sf):
    return FR.noise(V.v_frames(spark, sf))


@query(
    "spatial_10",
    """SELECT video_id, frame_idx, least(10.0e0, lap * 0.3e0 + slope * 0.3e0 + texture * 0.2e0 + freq * 0.2e0) AS spatial
    FROM (SELECT video_id, frame_idx, least(10.0e0, var_pop(lap) / 100) AS lap, least(10.0e0, avg(mag) / 50) AS slope FROM grad GROUP BY video_id, frame_idx)
    JOIN (SELECT video_id, frame_idx, least(10.0e0, avg(sqrt(greatest(0.0e0, lv))) / 20) AS texture FROM lv GROUP BY video_id, frame_idx) USING (video_id, frame_idx)
    JOIN (SELECT video_id, frame_idx, least(10.0e0, avg(ln(power + 1)) / 5) AS freq FROM spectrum WHERE far >= 4 GROUP BY video_id, frame_idx) USING (video_id, frame_idx)""",
    "v_frames", "spatial", px=PX, grad=GRADIENTS, spectrum=SPECTRUM, **variance_ctes(5, "px"),
)
def _(spark, sf):
    return FR.spatial_complexity(V.v_frames(spark, sf))


COLOUR = "SELECT *, 255 - v AS g, v * 2 % 256 AS b FROM px"
GREY = "SELECT video_id, frame_idx, list(round_even(v * 0.299e0 + g * 0.587e0 + b * 0.114e0, 0) ORDER BY y, x) AS p, list(floor((v + g + b) / 3) ORDER BY y, x) AS q FROM colour GROUP BY video_id, frame_idx"
GREY_PX = "SELECT video_id, frame_idx, p, q, y, x FROM grey CROSS JOIN (SELECT i // 8 AS y, i % 8 AS x FROM range(0, 64) t(i))"


@query(
    "texture_colour",
    f"""SELECT video_id, frame_idx, texture, color_variance, gradient_magnitude, color_complexity, gradient_score
    FROM (SELECT video_id, frame_idx, (avg(v * v) - pow(avg(v), 2) + avg(g * g) - pow(avg(g), 2) + avg(b * b) - pow(avg(b), 2)) / 3 AS color_variance, least(10.0e0, count(DISTINCT (v, g, b)) / 1000) AS color_complexity FROM colour GROUP BY video_id, frame_idx)
    JOIN (SELECT video_id, frame_idx, avg(sqrt(pow({convolved(FR.SOBEL_X)}, 2) + pow({convolved(FR.SOBEL_Y)}, 2))) AS gradient_magnitude,
      (avg(abs(q[8 * y + x + 2] - q[8 * y + x + 1])) FILTER (x < 7) + avg(abs(q[8 * y + x + 9] - q[8 * y + x + 1])) FILTER (y < 7)) / 255 AS gradient_score FROM grey_px GROUP BY video_id, frame_idx) USING (video_id, frame_idx)
    JOIN (SELECT video_id, frame_idx, least(1.0e0, avg(lv) / 1000) AS texture FROM lv GROUP BY video_id, frame_idx) USING (video_id, frame_idx)""",
    "v_frames", "texture color_variance gradient_magnitude color_complexity gradient_score", px=PX, colour=COLOUR, grey=GREY, grey_px=GREY_PX, **variance_ctes(3, "grey_px"),
)
def _(spark, sf):
    return FR.texture_colour(colour(spark, sf))


# A frame of 8 x 8 holds no whole block of 16, where the score is its neutral value; larger frames are in the kernel tests.
@query("block_motion", "SELECT video_id, frame_idx, 0.5e0 AS consistency FROM v_frames WHERE frame_idx > 0", "v_frames")
def _(spark, sf):
    return FR.block_motion(V.v_frames(spark, sf))


@query(
    "histogram",
    """SELECT video_id, frame_idx, list_transform(range(0, 16), lambda b: CAST(len(list_filter(pixels, lambda x: x // 16 = b)) AS BIGINT)) AS hist FROM v_frames""",
    "v_frames",
)
def _(spark, sf):
    return FR.histograms(V.v_frames(spark, sf))


@query(
    "scene_complexity_level",
    """SELECT *, CASE WHEN complexity_level = 'high' THEN 'full' ELSE 'diff' END AS stats_mode, CASE WHEN complexity_level = 'low' THEN 'bayer' ELSE 'floyd_steinberg' END AS dither FROM (
    SELECT *, CASE WHEN avg_color > 7 OR max_color > 8.5e0 OR avg_gradient > 0.3e0 THEN 'high' WHEN avg_color > 4 OR avg_gradient > 0.15e0 THEN 'medium' ELSE 'low' END AS complexity_level
    FROM (SELECT video_id, avg(len(list_distinct(pixels)) / 10.0e0) AS avg_color, max(len(list_distinct(pixels)) / 10.0e0) AS max_color, avg(list_avg(list_transform(range(1, 64), lambda i: abs(pixels[i + 1] - pixels[i]))) / 255.0e0) AS avg_gradient FROM v_frames GROUP BY video_id))""",
    "v_frames", "avg_color max_color avg_gradient",
)
def _(spark, sf):
    f = V.v_frames(spark, sf)
    steps = F.zip_with(F.slice("pixels", 1, 63), F.slice("pixels", 2, 63), lambda a, b: F.abs(b - a))
    feats = f.select(
        "video_id", (F.size(F.array_distinct("pixels")) / 10.0).alias("color_complexity"),
        (FR.array_sum(steps) / 63.0 / 255.0).alias("gradient_score"),
    )
    return FR.scene_level(feats)


@query(
    "frame_validity",
    """SELECT video_id, count(*) AS sampled, 50.0e0 * count(*) FILTER (readable) / count(*) + 50.0e0 * count(*) FILTER (readable AND sz > 10 AND sz < 5000 AND mean > 5 AND mean < 120) / count(*) AS validity
    FROM (SELECT video_id, list_avg(pixels) + 3 AS mean, frame_idx % 7 <> 0 AS readable, CASE WHEN frame_idx % 11 = 0 THEN 8 ELSE 16 END AS sz FROM v_frames WHERE true) GROUP BY video_id""".replace("mean < 120", "mean < 250"),
    "v_frames", "validity",
)
def _(spark, sf):
    f = V.v_frames(spark, sf)
    size = F.when(F.col("frame_idx") % 11 == 0, 8).otherwise(16)
    px = F.when(F.col("frame_idx") % 7 != 0, F.transform("pixels", lambda x: x + 3))
    return FR.frame_validity(f.select("video_id", size.alias("w"), size.alias("h"), px.alias("pixels")))


HUES = """SELECT video_id, frame_idx, v, g, b, CASE WHEN top > 0 THEN round_even(span / top * 255, 0) ELSE 0.0e0 END AS sat,
    CASE WHEN span > 0 THEN round_even(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2, 0) % 180 ELSE 0.0e0 END AS hue
  FROM (SELECT *, CASE WHEN top = v THEN (g - b) / span WHEN top = g THEN 2 + (b - v) / span ELSE 4 + (v - g) / span END * 60 AS hue
    FROM (SELECT *, greatest(v, g, b) AS top, greatest(v, g, b) - least(v, g, b) AS span FROM colour))"""


def spread_sql(column: str, name: str) -> str:
    """Values of a frame held by more than a hundredth of the pixels of its commonest value."""
    return f"""SELECT video_id, frame_idx, count(*) FILTER (n > top * 0.01e0) AS {name} FROM (
    SELECT *, max(n) OVER (PARTITION BY video_id, frame_idx) AS top FROM (SELECT video_id, frame_idx, {column}, count(*) AS n FROM hues GROUP BY ALL)) GROUP BY video_id, frame_idx"""


@query(
    "content_10",
    f"""SELECT video_id, color_complexity, motion_estimate, color_variance, greatest(0.0e0, least(10.0e0, 10 - (coalesce(m, 5.0e0) * 0.7e0 + coalesce(s, 2.0e0) * 0.3e0))) AS temporal_stability
    FROM (SELECT video_id, avg(least(10.0e0, hue_n / 20) * 0.4e0 + least(10.0e0, sat_n / 30) * 0.3e0 + least(10.0e0, var / 1000) * 0.3e0) AS color_complexity, avg(least(10.0e0, slope / 20)) AS motion_estimate, avg(least(10.0e0, var / 500)) AS color_variance
      FROM (SELECT video_id, frame_idx, (var_pop(v) + var_pop(g) + var_pop(b)) / 3 AS var FROM colour GROUP BY video_id, frame_idx)
      JOIN (SELECT video_id, frame_idx, avg(sqrt(pow({convolved(FR.SOBEL_X)}, 2) + pow({convolved(FR.SOBEL_Y)}, 2))) AS slope FROM grey_px GROUP BY video_id, frame_idx) USING (video_id, frame_idx)
      JOIN ({spread_sql('hue', 'hue_n')}) USING (video_id, frame_idx) JOIN ({spread_sql('sat', 'sat_n')}) USING (video_id, frame_idx) GROUP BY video_id)
    LEFT JOIN (SELECT video_id, avg(motion) AS m, var_pop(motion) AS s FROM (
      SELECT video_id, list_sum(list_transform(list_zip(pixels, prev), lambda z: abs(z[1] - z[2]))) / 64 / 255.0e0 * 10 AS motion
      FROM (SELECT *, lag(pixels) OVER (PARTITION BY video_id ORDER BY frame_idx) AS prev FROM v_frames) WHERE prev IS NOT NULL) GROUP BY video_id) USING (video_id)""",
    "v_frames", "color_complexity motion_estimate color_variance temporal_stability", px=PX, colour=COLOUR, grey=GREY, grey_px=GREY_PX, hues=HUES,
)
def _(spark, sf):
    motion = W.frame_motion(V.v_frames(spark, sf)).select("video_id", (F.col("motion") * 10).alias("motion"))
    return FR.content_scores_10(colour(spark, sf), motion)


@query(
    "frame_sampling",
    """SELECT video_id, frame_idx, CASE WHEN even THEN 'even' ELSE 'random' END AS pick FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id, even ORDER BY md5(video_id || ':' || frame_idx || ':7'), frame_idx) AS r FROM (
      SELECT video_id, frame_idx, frame_idx % s = 0 AND frame_idx BETWEEN s AND s * 5 AS even FROM (SELECT video_id, frame_idx, greatest(1, (max(frame_idx) OVER (PARTITION BY video_id) + 1) // 6) AS s FROM v_frames))) WHERE even OR r <= 3""",
    "v_frames",
)
def _(spark, sf):
    return FR.sample_frames(V.v_frames(spark, sf), 5, 3)


@query(
    "artifact_gate",
    f"""SELECT video_id, blockiness, banding, blockiness <= 0.12e0 AS blockiness_ok, banding <= 0.1e0 AS banding_ok, blockiness <= 0.12e0 AND banding <= 0.1e0 AS passes
    FROM (SELECT video_id, avg(blockiness) AS blockiness FROM ({BLOCKY}) GROUP BY video_id) JOIN (SELECT video_id, avg(banding) AS banding FROM ({BANDED}) GROUP BY video_id) USING (video_id)""",
    "v_frames", "blockiness banding", **BAND_CTES, grad=GRADIENTS,
)
def _(spark, sf):
    f = V.v_frames(spark, sf)
    parts = [m.select("video_id", *[m[c] if c == name else F.lit(None).cast("double").alias(c) for c in ("blockiness", "banding")])
             for name, m in (("blockiness", FR.blockiness(f)), ("banding", FR.banding(f)))]
    return FR.artifact_gate(parts[0].unionByName(parts[1]))


FEATURES = """SELECT encoder AS video_id, vmaf AS laplacian_var, size_mb * 12 AS sobel_var, tax AS fft_score, tax / 2 AS noise_var, vmaf / 3 AS snr_db, tax * 2 AS grain, tax / 3 AS edge_density, tax * 5 AS texture,
  bitrate_kbps / 10 AS color_variance, size_mb * 3 AS gradient_magnitude, size_mb AS flow, vmaf / 4 AS frame_diff, ssim AS consistency FROM v_encodes"""


@query(
    "video_features",
    """SELECT *, greatest(0.0e0, least(1.0e0, blur_score * 0.35e0 + (1 - noise_score) * 0.25e0 + complexity_score * 0.2e0 + temporal_stability * 0.2e0)) AS overall_quality FROM (
    SELECT video_id, frames, lap * 0.5e0 + sob * 0.3e0 + fft * 0.2e0 AS blur_score, 1 - sqrt((pow(lap - (lap + sob + fft) / 3, 2) + pow(sob - (lap + sob + fft) / 3, 2) + pow(fft - (lap + sob + fft) / 3, 2)) / 3) AS blur_confidence,
      noi * 0.4e0 + (1 - snr) * 0.4e0 + gra * 0.2e0 AS noise_score, least(1.0e0, edge * 10) * 0.3e0 + tex * 0.3e0 + least(1.0e0, cv / 1000) * 0.2e0 + least(1.0e0, gm / 100) * 0.2e0 AS complexity_score,
      1 - (least(1.0e0, flow / 50) * 0.5e0 + least(1.0e0, fd / 100) * 0.5e0) AS temporal_stability
    FROM (SELECT video_id, count(*) AS frames, least(1.0e0, avg(laplacian_var) / 100) AS lap, least(1.0e0, avg(sobel_var) / 200) AS sob, avg(fft_score) AS fft, least(1.0e0, avg(noise_var) / 0.1e0) AS noi, least(1.0e0, avg(snr_db) / 40) AS snr, avg(grain) AS gra,
      avg(edge_density) AS edge, avg(texture) AS tex, avg(color_variance) AS cv, avg(gradient_magnitude) AS gm, avg(flow) AS flow, avg(frame_diff) AS fd FROM feats GROUP BY video_id))""",
    "v_encodes", "blur_score blur_confidence noise_score complexity_score temporal_stability overall_quality", feats=FEATURES,
)
def _(spark, sf):
    c = F.col
    e = V.v_encodes(spark, sf).select(
        c("encoder").alias("video_id"), c("vmaf").alias("laplacian_var"), (c("size_mb") * 12).alias("sobel_var"), c("tax").alias("fft_score"),
        (c("tax") / 2).alias("noise_var"), (c("vmaf") / 3).alias("snr_db"), (c("tax") * 2).alias("grain"), (c("tax") / 3).alias("edge_density"),
        (c("tax") * 5).alias("texture"), (c("bitrate_kbps") / 10).alias("color_variance"), (c("size_mb") * 3).alias("gradient_magnitude"),
        c("size_mb").alias("flow"), (c("vmaf") / 4).alias("frame_diff"), c("ssim").alias("consistency"),
    )
    out = FR.video_features(e)
    return out.select("video_id", "frames", "blur_score", "blur_confidence", "noise_score", "complexity_score", "temporal_stability", "overall_quality")
