"""Frame kernels against direct per-pixel computation on small random frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelscope.operators import frames as FR


def reflect(i, n):
    return -i if i < 0 else (2 * (n - 1) - i if i >= n else i)


def slow_filter(a, k):
    h, w = a.shape
    r = len(k) // 2
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            out[y, x] = sum(k[i][j] * a[reflect(y + i - r, h), reflect(x + j - r, w)] for i in range(len(k)) for j in range(len(k)))
    return out


@pytest.fixture(scope="module")
def grey_frames(spark):
    rnd = np.random.default_rng(0)
    shapes = [(8, 8), (12, 20), (8, 8), (34, 34)]
    stacks = [rnd.integers(0, 256, s) for s in shapes] + [np.full((8, 8), 7)]
    data = [(1, i, i * 0.2, s.shape[1], s.shape[0], [int(x) for x in s.ravel()]) for i, s in enumerate(stacks)]
    return stacks, spark.createDataFrame(data, "video_id long, frame_idx long, ts_s double, w int, h int, pixels array<int>")


def by_frame(df, *cols):
    return {r.frame_idx: [r[c] for c in cols] for r in df.collect()}


def test_gradient_kernels(grey_frames):
    stacks, df = grey_frames
    sharp = by_frame(FR.sharpness(df), "laplacian_var", "sobel_var")
    noise = by_frame(FR.noise(df), "noise_var", "snr_db", "grain")
    block = by_frame(FR.blockiness(df), "blockiness")
    for i, a in enumerate(stacks):
        gx, gy, lap = slow_filter(a, FR.SOBEL_X), slow_filter(a, FR.SOBEL_Y), slow_filter(a, FR.LAPLACE)
        assert sharp[i] == pytest.approx([lap.var(), np.sqrt(gx**2 + gy**2).var()])
        n = lap.var() / 36
        snr = max(0.0, 10 * np.log10(a.var() / n)) if n > 0 else 20.0
        assert noise[i] == pytest.approx([n, snr, min(1.0, np.abs(slow_filter(a, FR.GRAIN)).mean() / 50)])
        edge = sum(np.abs(gy[y]).sum() * (2.5 if y % 16 == 0 else 1) for y in range(8, a.shape[0], 8))
        edge += sum(np.abs(gx[:, x]).sum() * (2.5 if x % 16 == 0 else 1) for x in range(8, a.shape[1], 8))
        total = np.abs(gx).sum() + np.abs(gy).sum()
        assert block[i][0] == pytest.approx(min(1.0, edge / total * 3) if total else 0.0)


def test_banding_and_spatial_are_bounded(grey_frames):
    _, df = grey_frames
    assert all(0 <= v[0] <= 1 for v in by_frame(FR.banding(df), "banding").values())
    assert all(0 <= v[0] <= 10 for v in by_frame(FR.spatial_complexity(df), "spatial").values())


def test_average_hash(grey_frames):
    stacks, df = grey_frames
    got = by_frame(FR.average_hash(df.where("w = 8 AND h = 8")), "hash")
    for i in (0, 2, 4):
        bits = "".join("1" if p > stacks[i].mean() else "0" for p in stacks[i].ravel())
        assert got[i][0] & (2**64 - 1) == int(bits, 2)


def test_histogram_and_intersection(grey_frames, spark):
    stacks, df = grey_frames
    hist = FR.histograms(df, 16)
    for r in hist.collect():
        assert r.hist == list(np.bincount(stacks[r.frame_idx].ravel() // 16, minlength=16))
    pair = hist.alias("a").join(hist.alias("b"), F.col("a.video_id") == F.col("b.video_id")).where("a.frame_idx = 0 AND b.frame_idx = 1")
    got = pair.select(FR.intersection(F.col("a.hist"), F.col("b.hist"))).first()[0]
    p, q = (np.bincount(s.ravel() // 16, minlength=16) / s.size for s in stacks[:2])
    assert got == pytest.approx(np.minimum(p, q).sum())


def test_block_motion(spark):
    rnd = np.random.default_rng(3)
    a = rnd.integers(0, 256, (40, 40))
    data = [(1, i, 0.0, 40, 40, [int(x) for x in f.ravel()]) for i, f in enumerate((a, a, 255 - a))]
    df = spark.createDataFrame(data, "video_id long, frame_idx long, ts_s double, w int, h int, pixels array<int>")
    got = by_frame(FR.block_motion(df), "consistency")
    assert got[1][0] == pytest.approx(1.0) and got[2][0] == pytest.approx(-1.0)


def test_colour_kernels(spark):
    rnd = np.random.default_rng(4)
    img = rnd.integers(0, 256, (6, 5, 3))
    df = spark.createDataFrame([(1, 0, 0.0, 5, 6, [int(x) for x in img.ravel()])], "video_id long, frame_idx long, ts_s double, w int, h int, pixels array<int>")
    r = FR.texture_colour(df).first()
    assert r.color_variance == pytest.approx(img.reshape(-1, 3).var(axis=0).mean())
    assert r.color_complexity == pytest.approx(len({tuple(p) for p in img.reshape(-1, 3)}) / 1000)
    assert 0 <= FR.content_frames(df).first().color_complexity <= 10


def test_perceptual_pair(spark):
    rnd = np.random.default_rng(5)
    a = [int(x) for x in rnd.integers(0, 256, 256)]
    b = [int(x) for x in rnd.integers(0, 256, 256)]
    df = spark.createDataFrame([(1, a, a, 16, 16), (2, a, b, 16, 16)], "k int, orig_pixels array<int>, comp_pixels array<int>, h int, w int")
    got = {r.k: r for r in FR.perceptual_pair(df).collect()}
    assert got[1].perceptual == pytest.approx(100.0)
    grid = [np.array(x).reshape(16, 16) for x in (a, b)]
    bits = [(g[:8, :8] > g[:8, 1:9]) for g in grid]
    assert got[2].hash_similarity == pytest.approx(1 - (bits[0] != bits[1]).sum() / 64)
