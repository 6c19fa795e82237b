"""Literal cases with expected values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reelscope.functions import logs as L, scalars as S
from reelscope.operators import aggregates as A, generate as G, joins as J, rank as R, windows as W
from reelscope.plans import gates as Q, planning as P, predict as PR, reports as RP
from reelscope.sources import files, stores


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_predict_chars(spark):
    df = spark.createDataFrame([("a", 60.0, 1920, 1080, 30.0, 5000000, "h264", 0.5, 0.4)],
                               "asset_id string, duration_s double, width int, height int, fps double, bitrate long, codec string, complexity double, motion double")
    r = PR.predict_chars(df).first()
    assert r.pred_vmaf == pytest.approx(66.571104) and r.pred_ssim == pytest.approx(0.875190888)


def test_floor_severity(spark):
    df = spark.createDataFrame([(5000, "libx264"), (2, "libx264"), (1, "libx264"), (2, "unknown")], "bitrate_kbps int, encoder string")
    got = [r.severity for r in A.with_floor(df, {"libx264": 3, "libx265": 5, "h264_nvenc": 2}).collect()]
    assert got == ["info", "warning", "critical", "critical"]  # unknown encoders need 10 kbps


def test_floor_adjust(spark):
    schema = "id int, width int, height int, fps double, bitrate_kbps int, encoder string, audio_kbps int, duration_s double, target_mb double"
    df = spark.createDataFrame([(1, 1920, 1080, 30.0, 2, "libx264", 64, 60.0, 10.0), (2, 320, 180, 60.0, 2, "libx264", 64, 60.0, 10.0),
                                (3, 1920, 1080, 30.0, 50, "libx264", 64, 60.0, 10.0)], schema)
    res = ((1280, 720), (854, 480), (640, 360), (480, 270), (320, 180))
    got = {r.id: r for r in P.floor_adjust(df, res, (0, 0), 10.0, minima={"libx264": 3}).collect()}
    assert got[1].adjustment == "resolution" and (got[1].new_width, got[1].new_height) == (1280, 720)
    assert got[2].adjustment == "fps" and got[2].new_fps >= 10
    assert got[3].adjustment == "none" and got[3].new_kbps == 50


@pytest.mark.parametrize("target,level,percent,ok", [
    (48.0, "minimal", 20.0, True), (39.0, "moderate", 35.0, True), (30.0, "significant", 50.0, True), (15.0, "severe", 75.0, True),
    (10.0, "severe", 83.333333, False)])
def test_fps_impact(spark, target, level, percent, ok):
    r = S.with_fps_impact(spark.createDataFrame([(60.0, target)], "fps double, target_fps double"), min_fps=15.0).first()
    assert (r.impact_level, r.respects_minimum) == (level, ok) and r.reduction_percent == pytest.approx(percent)


SSIM = {
    "standard": "n:1 Y:0.9876 U:0.9 All:0.9691 (23.12dB)\nn:2 Y:0.9845 All:0.9666\nn:3 Y:0.9823 All:0.9644",
    "alternative": "Frame 1: Y: 0.9876\nFrame 2: Y: 0.9845\nFrame 3: Y: 0.9823",
    "all": "All: 0.9691\nAll: 0.9666\nAll: 0.9644",
    "mixed": "n:1 Y:0.9876 U:0.99\nY: 0.9845\nAll: 0.9644",
    "fuzzy": "ssim overall 0.97 at 12.5 percent",
    "empty": "", "no data": "Some numbers: 123 456 789",
    "range": "n:1 Y:1.5\nn:2 Y:0.9823",
}


def test_ssim_logs(spark):
    df = spark.createDataFrame(list(SSIM.items()), "log_id string, text string")
    got = {r.log_id: r for r in L.ssim_scores(df).collect()}
    assert got["standard"].ssim == pytest.approx(0.9848) and got["standard"].ssim_conf > 0.8
    assert got["alternative"].ssim > 0.98 and got["alternative"].ssim_conf > 0.7
    assert got["all"].ssim > 0.96
    assert got["mixed"].ssim == pytest.approx(0.9876) and got["mixed"].ssim_frames == 1
    assert got["fuzzy"].ssim == pytest.approx(0.97)
    assert got["empty"].ssim is None and got["empty"].ssim_conf == 0
    assert got["no data"].ssim is None
    assert got["range"].ssim == pytest.approx(0.9823) and got["range"].ssim_conf < 0.8


def test_ssim_outliers(spark):
    values = [0.95, 0.96, 0.94, 0.97, 0.2, 0.95, 0.96, 1.5, 0.94]
    df = spark.createDataFrame([(values,)], "_raw array<double>")
    assert L.with_scores(df).first().ssim_frames == 7


VMAF = {
    '{"pooled_metrics":{"vmaf":{"mean":85.67,"std":2.34}}}': 85.67, '{"aggregate":{"VMAF_score":82.45}}': 82.45, '{"vmaf":{"mean":78.92}}': 78.92,
    "VMAF score: 84.56": 84.56, '{"frame":1,"metrics":{"x":1}}\n{"pooled_metrics":{"vmaf":{"mean":81.2}}}': 81.2,
    '{"invalid": json: format}\nVMAF score: 75.43': 75.43, "VMAF score: 150.0\nvmaf: -20.5\nmean: 85.67": 85.67, "nothing here": None,
    '<VMAF version="1">\n<pooled_metrics><metric name="vmaf" min="1" mean="91.5"/></pooled_metrics>\n</VMAF>': 91.5,
    '<?xml version="1.0"?>\n<VMAF><frames><frame num="0" vmaf="80.0"/><frame num="1" vmaf="90.0"/></frames></VMAF>': 85.0,
}


def test_vmaf_logs(spark):
    df = spark.createDataFrame([(k,) for k in VMAF], "text string")
    for r in L.vmaf_scores(df).collect():
        assert r.vmaf == (pytest.approx(VMAF[r.text]) if VMAF[r.text] is not None else None), r.text


def test_gate(spark):
    data = [(85.0, 0.96), (75.0, 0.96), (85.0, 0.92), (75.0, 0.92), (80.0, 0.94), (79.9, 0.939)]
    df = spark.createDataFrame(data, "vmaf double, ssim double").withColumn("confidence", F.lit(0.9))
    assert [r.passes for r in Q.quality_gate(df).collect()] == [True, False, False, False, True, False]
    none = spark.createDataFrame([(None, None)], "vmaf double, ssim double").withColumn("confidence", F.lit(0.0))
    assert [Q.quality_gate(none, m).first().passes for m in ("conservative", "permissive", "strict")] == [True, True, False]


def test_gate_confidence(spark):
    data = [(85.0, 0.96, "vmaf+ssim"), (85.0, None, "vmaf+ssim"), (None, 0.96, "vmaf+ssim"), (None, None, "vmaf+ssim"), (None, 0.96, "ssim_only")]
    df = spark.createDataFrame([(*r, 1.0, 1.0) for r in data], "vmaf double, ssim double, method string, vmaf_conf double, ssim_conf double")
    assert [r.confidence for r in A.with_gate_confidence(df).collect()] == pytest.approx([1.0, 0.8, 0.6, 0.0, 0.9])


def test_resolution_pairs(spark):
    data = [(1920, 1080, 1920, 1080), (1920, 1080, 1280, 720), (1920, 1080, 1920, 800), (640, 480, 1920, 1080)]
    got = [(r.size_mismatch, r.aspect_mismatch, r.target_w, r.target_h, r.smaller) for r in
           S.resolution_mismatch(spark.createDataFrame(data, "orig_w int, orig_h int, comp_w int, comp_h int")).collect()]
    assert got == [(False, False, 1920, 1080, "original"), (True, False, 1280, 720, "compressed"), (True, True, 1920, 800, "compressed"), (True, True, 640, 480, "original")]


def test_errors(spark):
    df = spark.createDataFrame([(1, "Bitrate floor constraint"), (2, "Permission denied"), (3, "Permission denied again")], "seq long, message string")
    c = S.classify_errors(df)
    total = {(r.level, r.key): r for r in A.error_summary(c).collect()}[("total", "all")]
    assert (total.retryable, total.non_retryable, total.most_common) == (1, 2, "permission")
    assert rows(R.top_failures(c)) == [("permission", 2, "Permission denied again"), ("bitrate_validation", 1, "Bitrate floor constraint")]


def test_names(spark):
    df = spark.createDataFrame([("Alpha⧸Beta:Gamma",), ("***",), (None,), ("  .a b. ",), ("x" * 300,)], "n string")
    got = [r[0] for r in df.select(S.sanitize(F.col("n"))).collect()]
    assert got == ["Alpha_Beta_Gamma", "segments_summary", "segments_summary", "a b", "x" * 180]
    folder = spark.createDataFrame([("out/Party ⧸ Time_segments",)], "f string").select(S.summary_name(F.col("f"))).first()[0]
    assert folder == "~Party _ Time_comprehensive_summary.txt"
    paths = ["a/clip_part_01.mp4", "a/Party.mp4", "b_segments/x.mp4", "a/movie_segment_12.gif"]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(S.is_segment(F.col("p"))).collect()] == [True, False, True, True]


def test_cache_key_is_pure(spark):
    import hashlib
    import json

    df = spark.createDataFrame([("h264", 1000, 1920, 1080, 30.0, "medium", 23, "ab" * 32), ("h264", None, None, None, None, None, None, "ab" * 32)],
                               "codec string, bitrate long, width int, height int, fps double, preset string, crf int, content_hash string")
    got = [r.cache_key for r in S.with_cache_key(df).collect()]
    want = []
    for p in ({"codec": "h264", "bitrate": 1000, "resolution": [1920, 1080], "fps": 30.0, "preset": "medium", "crf": 23, "additional": None},
              {"codec": "h264", "bitrate": None, "resolution": None, "fps": None, "preset": None, "crf": None, "additional": None}):
        want.append("ab" * 8 + "_" + hashlib.sha256(json.dumps(p, sort_keys=True).encode()).hexdigest()[:16])
    assert got == want


def test_ttl(spark):
    df = spark.createDataFrame([(0.9, "full"), (0.95, "full"), (0.3, "predicted")], "confidence double, method string")
    assert [r[0] for r in df.select(S.ttl_hours(F.col("confidence"), F.col("method"))).collect()] == [54, 72, 8]


def test_tracker(spark):
    data = [(1, "cache_hits", "loop", 1), (2, "validation_failures", "mp4", 2), (3, "cache_hits", "loop", 0)]
    got = dict(rows(A.tracker(spark.createDataFrame(data, "seq long, metric string, context string, amount int"))))
    assert got == {"cache_hits": 1, "cache_hits_loop": 1, "validation_failures": 2, "validation_failures_mp4": 2}


def test_summary_dedup(spark):
    t = dt.datetime(2024, 1, 1)
    data = [("out/a_segments", f"~x{i}_comprehensive_summary.txt", t + dt.timedelta(seconds=s)) for i, s in enumerate((0, 1, 3))]
    r = R.dedup_summaries(spark.createDataFrame(data, "folder string, name string, mtime timestamp")).first()
    assert (r.kept_name, r.canonical_name, r.found) == ("~x2_comprehensive_summary.txt", "~a_comprehensive_summary.txt", 3)


def test_gif_colours_and_params(spark):
    df = spark.createDataFrame([(999,), (512,), (400,), (1,)], "c int")
    assert [r[0] for r in df.select(S.clamp_colors(F.col("c"))).collect()] == [256, 256, 256, 2]
    g = spark.createDataFrame([(40.0, 10.0, 360, 360, 22.0, 400, 0, "medium", "medium")],
                              "current_mb double, target_mb double, width int, height int, fps double, colors int, lossy int, motion_level string, complexity_level string")
    r = P.gif_params(g).first()
    assert r.gif_colors <= 256 and r.gif_w >= 360 and r.gif_fps >= 15 and r.gif_lossy == 120


def test_bottleneck_golden(spark):
    data = [(i, "encode", dt.datetime(2024, 1, 1, 0, i), d, True) for i, d in enumerate((70.0, 80.0, 90.0))]
    data += [(10 + i, "probe", dt.datetime(2024, 1, 1, 1, i), 1.0, i == 0) for i in range(4)]
    ops = spark.createDataFrame(data, "op_id long, op_name string, ts timestamp, duration double, success boolean").withColumn("memory_delta", F.lit(None).cast("double"))
    lookups = spark.createDataFrame([(True, 0.1)], "hit boolean, response_s double")
    found = {(r.kind, r.op_name): r.severity for r in RP.bottlenecks(A.op_stats(ops), A.lookup_stats(lookups)).collect()}
    assert found == {("slow_operation", "encode"): "high", ("high_failure_rate", "probe"): "critical"}
    trend = {r.op_name: r for r in A.op_trends(ops).collect()}["encode"]
    assert trend.duration_slope == pytest.approx(10) and trend.duration_trend == "increasing"


def test_failure_runs(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 7, t, "FAILURE", 30.0), (2, 7, t + dt.timedelta(seconds=20), "FAILURE", 25.0)],
                               "attempt_id long, session_id long, ts timestamp, result string, duration double")
    last = {r.attempt_id: r for r in W.failure_runs(df).collect()}[2]
    assert (last.consecutive_failures, last.total_time, last.recent_failures) == (2, 55.0, 2)


def test_upsert_and_lookup(spark):
    t = dt.datetime(2024, 1, 1)
    base = spark.createDataFrame([("a", 1, t), ("b", 2, t)], "cache_key string, value int, at timestamp")
    new = spark.createDataFrame([("a", 9, t), ("c", 3, t)], "cache_key string, value int, at timestamp")
    assert sorted(rows(stores.upsert(base, new, ["cache_key"], ["at"]))) == [("a", 9, t), ("b", 2, t), ("c", 3, t)]
    cache = base.withColumn("expires_at", F.lit(dt.datetime(2024, 1, 2)))
    now = lambda day: F.lit(dt.datetime(2024, 1, day)).cast("timestamp")
    req = spark.createDataFrame([("a",), ("z",)], "cache_key string")
    hits = lambda day: {r.cache_key: r.hit for r in J.cache_lookup(req, cache, now(day)).collect()}
    assert hits(1) == {"a": True, "z": False} and hits(3) == {"a": False, "z": False}


def test_estimate_time_without_history(spark):
    req = spark.createDataFrame([(200.0, 10.0)], "size_mb double, target_mb double")
    none = spark.createDataFrame([], "size_mb double, target_mb double, duration double, success boolean")
    r = J.estimate_time(req, none).first()
    assert (r.estimated_s, r.confidence, r.min_s, r.max_s, r.similar_sessions) == (100.0, "low", 50.0, 200.0, 0)


def test_similar_hashes_brute_force(spark):
    import random

    rnd = random.Random(4)
    base = [rnd.getrandbits(63) for _ in range(12)]
    values = list({b ^ sum(1 << i for i in rnd.sample(range(63), rnd.randrange(0, 16))) for b in base for _ in range(8)})
    values += [-v for v in values[:20]]
    ids = [(i, v) for i, v in enumerate(values)] + [(1000 + i, values[0]) for i in range(5)]
    df = spark.createDataFrame(ids, "asset_id long, hash long")
    dist = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    distinct = sorted(set(values))
    want = {(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1:] if dist(a, b) <= 12} | {(values[0], values[0])}
    for agree in (1, 2):
        got = [(r.hash_a, r.hash_b) for r in J.similar_assets(df, 0.8, agree).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_fps_strings(spark):
    df = spark.createDataFrame([("30000/1001",), ("25",), ("",), (None,), ("0/0",), ("abc",), ("1.5/2",)], "r string")
    got = [r[0] for r in df.select(S.parse_fps(F.col("r"))).collect()]
    assert got == pytest.approx([30000 / 1001, 25.0, 30.0, 30.0, 30.0, 30.0, 30.0])


def test_probe_failure_is_flagged(spark):
    df = spark.createDataFrame([("x", "not json"), ("y", '{"streams":[{"codec_type":"video","width":640,"height":"360","r_frame_rate":"25/1","nb_frames":"0"}],"format":{"duration":"4.0"}}')],
                               "path string, probe_json string")
    got = {r.path: r for r in files.parse_probe(df).collect()}
    assert not got["x"].probe_ok
    assert (got["y"].width, got["y"].height, got["y"].frame_count) == (640, 360, 100)


def test_strategy_registry(spark):
    G.register_strategy("tiny", lambda df: df.withColumn("out_width", F.lit(1)))
    assert spark.range(1).transform(G.get_strategy("TINY")).first().out_width == 1
    assert G.get_strategy("unknown") is G.balanced


def test_estimate_time_brute_force(spark):
    import random

    rnd = random.Random(8)
    sess = [(rnd.choice([1.0, 2.0, 4.0, rnd.uniform(0.3, 900), 2 ** rnd.uniform(-3, 9)]), rnd.choice([8.0, 10.0, 16.0, 50.0]), rnd.uniform(1, 90), rnd.random() < 0.9)
            for _ in range(400)]
    reqs = [(s, t) for s in (0.5, 1.0, 2.0, 3.7, 8.0, 100.0, 1e6) for t in (8.0, 20.0, 25.0, 400.0)]
    df = spark.createDataFrame(sess, "size_mb double, target_mb double, duration double, success boolean")
    got = {(r.size_mb, r.target_mb): r for r in J.estimate_time(spark.createDataFrame(reqs, "size_mb double, target_mb double"), df).collect()}
    near = lambda a, b: min(a, b) / max(a, b) > 0.5
    for s, t in reqs:
        d = [x[2] for x in sess if x[3] and near(x[0], s) and near(x[1], t)]
        r = got[s, t]
        assert r.similar_sessions == len(d)
        if d:
            assert (r.estimated_s, r.min_s, r.max_s) == pytest.approx((sum(d) / len(d), min(d), max(d)))
            assert r.confidence == ("high" if len(d) >= 5 else "medium")


@pytest.mark.parametrize("limit", [0.0, 300.0, 500.0, 10**6])
def test_lru_evict_brute_force(spark, limit):
    import random

    rnd = random.Random(6)
    t = dt.datetime(2024, 1, 1)
    data = [(f"{rnd.getrandbits(64):016x}", t + dt.timedelta(hours=rnd.choice([0, 1, 1, 1, 5, 30])), float(rnd.randrange(1, 9))) for _ in range(200)]
    df = spark.createDataFrame(data, "cache_key string, last_accessed timestamp, data_size double")
    total = sum(d[2] for d in data)
    want, removed = set(), 0.0
    if total > limit:
        for key, _, size in sorted(data, key=lambda d: (d[1], d[0])):
            if removed >= total - int(limit * 0.8):
                break
            want.add(key)
            removed += size
    assert {r.cache_key for r in W.lru_evict(df, limit).collect()} == want


def test_similar_hashes_at_a_low_threshold_make_no_row_per_candidate(spark):
    """At 0.75 the pieces have under four bits, so more candidates than pairs would meet in a join."""
    df = spark.range(3000).select(F.col("id").alias("asset_id"), F.xxhash64("id").alias("hash")).cache()
    found = J.similar_assets(df, 0.75)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    plain = df.select(F.col("hash").alias("a")).crossJoin(df.select(F.col("hash").alias("b"))).where("a < b AND bit_count(a ^ b) <= 16")
    want = sorted((r.a, r.b) for r in plain.collect())
    assert want and sorted((r.hash_a, r.hash_b) for r in found.collect()) == want
    assert found.where("round((1 - similarity) * 64) != bit_count(hash_a ^ hash_b)").isEmpty()
