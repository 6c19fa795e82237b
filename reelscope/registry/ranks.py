"""Queries for rankings, choices, set operations and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.functions import scalars as S
from reelscope.operators import aggregates as A, generate as G, rank as R, windows as W
from reelscope.registry.aggregates import NESTED_OPS, TRACKED, nested_sessions, tracked
from reelscope.registry.base import query
from reelscope.registry.scalars import CLASSIFIED
from reelscope.registry.sqlviews import _pick, _q
from reelscope.registry.windows import CUTS, cuts, ends
from reelscope.sources import views as V
from reelscope.sources.views import pick

SCORED = """SELECT job_id, step, q, size_mb, violations, violations = 0 AS feasible,
   q - CASE WHEN size_mb > 10 THEN (size_mb - 10) * 10 ELSE 0 END + CASE WHEN size_mb / 10 BETWEEN 0.8e0 AND 1.0e0 THEN 5 ELSE 0 END AS objective
  FROM (SELECT job_id, step, vmaf AS q, size_mb, CASE WHEN size_mb > 10 THEN 1 ELSE 0 END + CASE WHEN coalesce(vmaf, 0) < 70 THEN 1 ELSE 0 END AS violations FROM v_encodes)"""


def scored(spark, sf):
    return V.v_encodes(spark, sf).select("job_id", "step", F.col("vmaf").alias("quality"), "size_mb", "bitrate_kbps")


@query(
    "best_attempt",
    """SELECT job_id, step, feasible, objective FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY feasible DESC, CASE WHEN feasible THEN objective END DESC NULLS LAST, violations, step) AS r FROM scored) WHERE r = 1""",
    "v_encodes", "objective", scored=SCORED,
)
def _(spark, sf):
    return R.best_attempt(scored(spark, sf), ["job_id"]).select("job_id", "step", "feasible", "objective")


@query(
    "fallback_attempt",
    """SELECT job_id, step, size_mb <= 10 AND q IS NOT NULL AS within_limit FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY size_mb <= 10 AND q IS NOT NULL DESC,
      CASE WHEN size_mb <= 10 AND q IS NOT NULL THEN q END DESC NULLS LAST, abs(size_mb - 10), step) AS r FROM (SELECT * REPLACE (CASE WHEN size_mb <= 10 AND q IS NOT NULL THEN 10 + 0 * size_mb ELSE size_mb END AS size_mb) FROM scored)) WHERE r = 1""",
    "v_encodes", scored=SCORED,
)
def _(spark, sf):
    return R.fallback_attempt(scored(spark, sf), ["job_id"]).select("job_id", "step", "within_limit")


KEYED = "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ts_s, point_id) - 1 AS rn, count(*) OVER (PARTITION BY video_id) AS n FROM v_points WHERE is_keyframe"


@query(
    "keyframe_stride",
    "SELECT video_id, point_id, ts_s FROM keyed WHERE rn % greatest(1, n // 6) = 0 AND rn < greatest(1, n // 6) * 6",
    "v_points", keyed=KEYED,
)
def _(spark, sf):
    return R.keyframes(V.v_points(spark, sf), 6).select("video_id", "point_id", "ts_s")


@query(
    "critical_frames",
    """SELECT video_id, point_id, ts_s, complexity FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ts_s, point_id) AS r FROM (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, floor(ts_s * 10) ORDER BY complexity DESC, ts_s, point_id) AS b FROM (
        SELECT video_id, point_id, ts_s, 0.5e0 AS complexity FROM keyed WHERE rn % greatest(1, n // 4) = 0 AND rn < greatest(1, n // 4) * 4
        UNION ALL SELECT video_id, point_id, ts_s, complexity FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY complexity DESC, ts_s, point_id) AS r FROM v_points) WHERE r <= 4
        UNION ALL SELECT video_id, point_id, ts_s, 0.4e0 FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY motion DESC, ts_s, point_id) AS r FROM v_points) WHERE r <= 4)) WHERE b = 1)) WHERE r <= 12""",
    "v_points", "complexity", keyed=KEYED,
)
def _(spark, sf):
    return R.critical_frames(V.v_points(spark, sf), 12)


@query(
    "top_failures",
    "SELECT category, count(*) AS n, arg_max(message, seq) AS sample_message FROM classified GROUP BY category ORDER BY n DESC, category LIMIT 3",
    "v_errors", classified=CLASSIFIED,
)
def _(spark, sf):
    return R.top_failures(S.classify_errors(V.v_errors(spark, sf)))


@query(
    "top_metrics",
    "SELECT metric AS counter, CAST(sum(amount) AS BIGINT) AS total FROM tracked WHERE amount > 0 GROUP BY metric ORDER BY total DESC, counter LIMIT 5",
    "v_events", tracked=TRACKED,
)
def _(spark, sf):
    return R.top_metrics(A.tracker(tracked(spark, sf)))


CANDS = """SELECT bitrate_kbps // 100 * 100 AS bitrate, crf, preset, encoder, """ + _pick("l", "0.8e0", "0.9e0", "1.0e0", "1.1e0") + " AS resolution_factor, " + _pick("l", "0.9e0", "1.0e0") + """ AS fps_factor, step
  FROM (SELECT *, CAST(bitrate_kbps AS BIGINT) AS l FROM v_encodes)"""


def candidates(spark, sf):
    rate = F.col("bitrate_kbps")
    return V.v_encodes(spark, sf).select(
        (F.floor(rate / 100) * 100).alias("bitrate"), "crf", "preset", "encoder", pick(rate, 0.8, 0.9, 1.0, 1.1).alias("resolution_factor"),
        pick(rate, 0.9, 1.0).alias("fps_factor"), "step",
    )


@query(
    "new_candidates",
    """SELECT DISTINCT bitrate, crf, preset, encoder, resolution_factor, fps_factor FROM cands WHERE step > 2 AND bitrate BETWEEN 1000 AND 5000 AND crf BETWEEN 18 AND 28 AND preset IN ('fast', 'medium', 'slow') AND encoder IN ('libx264', 'libx265')
      AND resolution_factor IN (0.8e0, 0.9e0, 1.0e0) AND fps_factor IN (0.9e0, 1.0e0) EXCEPT SELECT bitrate, crf, preset, encoder, resolution_factor, fps_factor FROM cands WHERE step <= 2""",
    "v_encodes", cands=CANDS,
)
def _(spark, sf):
    c = candidates(spark, sf)
    space = {"bitrate": (1000, 5000), "crf": (18, 28), "presets": ("fast", "medium", "slow"), "encoders": ("libx264", "libx265"),
             "resolution_factors": (0.8, 0.9, 1.0), "fps_factors": (0.9, 1.0)}
    return R.new_candidates(c.where("step > 2").drop("step"), c.where("step <= 2").drop("step"), space)


@query(
    "summary_dedup",
    """SELECT folder, arg_max(name, (canon, mtime, name)) AS kept_name, arg_max(mtime, (canon, mtime, name)) AS kept_mtime, count(*) AS found, canonical_name FROM (
    SELECT folder, name, mtime, name = canonical_name AS canon, canonical_name FROM (SELECT 'out/show' || doc_id // 5 || '_segments' AS folder, '~show' || doc_id // 5 || '_comprehensive_summary.txt' AS canonical_name,
      CASE WHEN doc_id % 7 = 0 THEN '~show' || doc_id // 5 || '_comprehensive_summary.txt' ELSE '~old' || doc_id || '_comprehensive_summary.txt' END AS name, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 37 % 1000) AS mtime FROM documents)) GROUP BY folder, canonical_name""",
)
def _(spark, sf):
    d = F.col("doc_id")
    show = F.concat(F.lit("show"), F.floor(d / 5).cast("string"))
    tail = F.lit("_comprehensive_summary.txt")
    name = F.when(d % 7 == 0, F.concat(F.lit("~"), show, tail)).otherwise(F.concat(F.lit("~old"), d.cast("string"), tail))
    mtime = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=(d * 37 % 1000).cast("decimal(18,6)"))
    files = V.table(spark, sf, "documents").select(F.concat(F.lit("out/"), show, F.lit("_segments")).alias("folder"), name.alias("name"), mtime.alias("mtime"))
    return R.dedup_summaries(files)


@query("explode_ops", "SELECT session_id, step - 1 AS pos, op_name, duration, success FROM nested", "v_sessions v_encodes", "duration",
       nested=NESTED_OPS + " WHERE job_id IN (SELECT session_id FROM v_sessions)")
def _(spark, sf):
    out = G.explode_nested(nested_sessions(spark, sf), "operations")
    return out.select("session_id", F.col("pos").cast("bigint").alias("pos"), "op_name", "duration", "success")


TEMPORAL = """SELECT asset_id, sample_no, sample_no * (span / n) AS start_s, least(sample_no * (span / n) + 2, span) AS end_s FROM (
  SELECT asset_id, span, n, unnest(range(0, n)) AS sample_no FROM (SELECT asset_id, duration_s AS span, greatest(1, CAST(floor(duration_s / 7) AS BIGINT)) AS n FROM v_assets))"""


@query("temporal_samples", TEMPORAL, "v_assets", "start_s end_s")
def _(spark, sf):
    return G.temporal_samples(V.v_assets(spark, sf), every_s=7.0)


@query(
    "interval_samples",
    """SELECT asset_id, sample_no, sample_no * 5.0e0 AS start_s, least(sample_no * 5.0e0 + 1, duration_s) AS end_s FROM (SELECT asset_id, duration_s, unnest(range(0, CAST(ceil(duration_s / 5) AS BIGINT))) AS sample_no FROM v_assets) WHERE least(sample_no * 5.0e0 + 1, duration_s) > sample_no * 5.0e0""",
    "v_assets", "start_s end_s",
)
def _(spark, sf):
    return G.interval_samples(V.v_assets(spark, sf))


SCENES = "SELECT video_id, point_id, cut_s AS start_s, lead(cut_s, 1, 1706745600.0e0) OVER (PARTITION BY video_id ORDER BY cut_s, point_id) AS end_s FROM cuts"
SCENE_SAMPLES = """SELECT video_id, point_id, sample_no, start_s + (sample_no + 0.5e0) / 2 * 0.8e0 * (end_s - start_s) AS s, least(start_s + (sample_no + 0.5e0) / 2 * 0.8e0 * (end_s - start_s) + 1.5e0, end_s) AS e
  FROM (SELECT *, unnest([0, 1]) AS sample_no FROM scenes WHERE end_s - start_s >= 1)"""


@query(
    "scene_samples",
    "SELECT video_id, point_id, sample_no, s AS sample_start_s, e AS sample_end_s FROM ss WHERE e > s",
    "v_points", "sample_start_s sample_end_s", 3, cuts=CUTS, scenes=SCENES, ss=SCENE_SAMPLES,
)
def _(spark, sf):
    scenes = W.scene_intervals(cuts(spark, sf), ends(spark, sf), min_s=0.0)
    return G.scene_samples(scenes).select("video_id", "point_id", "sample_no", "sample_start_s", "sample_end_s")


@query(
    "video_segments",
    """SELECT asset_id, segments, i + 1 AS segment_no, i * len AS start_s, CASE WHEN i < segments - 1 THEN (i + 1) * len ELSE duration_s END AS end_s, path || '_segment_' || lpad(CAST(i + 1 AS VARCHAR), 3, '0') || '.mp4' AS name
    FROM (SELECT *, unnest(range(0, segments)) AS i FROM (SELECT *, least(len0, duration_s / segments) AS len FROM (SELECT asset_id, path, duration_s, 20 + complexity AS len0, CAST(ceil(duration_s / (20 + complexity)) AS BIGINT) AS segments FROM v_assets)))""",
    "v_assets", "start_s end_s",
)
def _(spark, sf):
    return G.plan_segments(V.v_assets(spark, sf), F.col("complexity") + 20)


@query(
    "gif_segments",
    """SELECT asset_id, segments, i + 1 AS segment_no, s AS start_s, e AS end_s, CASE WHEN e - s > 24 THEN CAST(floor(fps * 0.9e0) AS BIGINT) ELSE CAST(fps AS BIGINT) END AS fps, CASE WHEN e - s > 24 THEN greatest(2, least(256, CAST(floor(colors * 0.9e0) AS BIGINT))) ELSE colors END AS colors
    FROM (SELECT *, i * len AS s, CASE WHEN i = segments - 1 THEN duration_s ELSE least(duration_s, i * len + len) END AS e FROM (SELECT *, unnest(range(0, segments)) AS i FROM (SELECT *, least(30.0e0, greatest(12.0e0, duration_s / segments)) AS len FROM (
      SELECT asset_id, duration_s, fps, asset_id % 300 AS colors, greatest(1, CAST(ceil(duration_s / least(30.0e0, greatest(12.0e0, CASE WHEN duration_s <= 40 THEN 18.0e0 WHEN duration_s <= 80 THEN 22.0e0 WHEN duration_s <= 120 THEN 25.0e0 ELSE 28.0e0 END))) AS BIGINT)) AS segments
      FROM (SELECT asset_id, fps, CASE asset_id % 4 WHEN 0 THEN duration_s / 8 WHEN 1 THEN duration_s / 2 ELSE duration_s END AS duration_s FROM v_assets))))) WHERE e > s""",
    "v_assets", "start_s end_s",
)
def _(spark, sf):
    key = F.col("asset_id")
    dur = F.when(key % 4 == 0, F.col("duration_s") / 8).when(key % 4 == 1, F.col("duration_s") / 2).otherwise(F.col("duration_s"))
    a = V.v_assets(spark, sf).select("asset_id", dur.alias("duration_s"), F.col("fps").alias("gif_fps"), (key % 300).alias("colors"))
    return G.plan_gif_segments(a)


STAGES = "SELECT * FROM (VALUES (0, 256, 1.0e0, 1.0e0, 0, 'floyd_steinberg'), (1, 224, 0.98e0, 0.98e0, 20, 'floyd_steinberg'), (2, 192, 0.95e0, 0.95e0, 40, 'floyd_steinberg'), (3, 160, 0.94e0, 0.92e0, 60, 'bayer'), (4, 128, 0.9e0, 0.88e0, 80, 'bayer'), (5, 96, 0.88e0, 0.8e0, 120, 'bayer')) t(no, colors, fm, rm, lossy, dither)"
WALK = "SELECT * FROM (VALUES ('quality', 0, 0), ('quality', 1, 1), ('quality', 2, 2), ('size', 0, 5), ('size', 1, 4), ('size', 2, 3), ('balanced', 0, 2), ('balanced', 1, 3), ('balanced', 2, 4)) t(strategy, stage, no)"


@query(
    "stage_params",
    """SELECT strategy, asset_id, stage, CAST(floor(width * rm) AS BIGINT) AS stage_width, CAST(floor(fps * fm) AS BIGINT) AS stage_fps, CAST(colors AS BIGINT) AS stage_colors, dither, lossy FROM v_assets CROSS JOIN walk JOIN stages USING (no)
    UNION ALL SELECT 'adaptive', asset_id, i, greatest(360, CAST(floor(width * m) AS BIGINT)), greatest(15, CAST(floor(fps * CASE lv WHEN 'low' THEN 0.85e0 WHEN 'high' THEN 0.95e0 ELSE 0.9e0 END) AS BIGINT)), CAST(greatest(128, CAST(floor(200 * CASE cx WHEN 'low' THEN 0.8e0 WHEN 'high' THEN 0.95e0 ELSE 0.9e0 END) AS BIGINT)) AS BIGINT),
      CASE cx WHEN 'high' THEN 'floyd_steinberg' ELSE 'bayer' END, l FROM (SELECT *, CASE WHEN fps >= 50 THEN 'high' WHEN fps >= 30 THEN 'medium' ELSE 'low' END AS lv, """ + _pick("asset_id", *_q("low", "medium", "high")) + """ AS cx FROM v_assets) CROSS JOIN (VALUES (0, 0.95e0, 3), (1, 0.9e0, 5), (2, 0.85e0, 9), (3, 0.8e0, 11)) t(i, m, l)""",
    "v_assets", stages=STAGES, walk=WALK,
)
def _(spark, sf):
    a = V.v_assets(spark, sf).withColumns(
        {"colors": F.lit(200), "motion_level": S.motion_level(F.col("fps")), "complexity_level": pick(F.col("asset_id"), "low", "medium", "high")}
    )
    parts = [G.stage_params(a, s).withColumn("strategy", F.lit(s)) for s in ("quality", "size", "balanced", "adaptive")]
    return R.all_samples(*parts)


@query(
    "sample_union",
    """SELECT kind, count(*) AS n, sum(e - s) AS total_s FROM (SELECT 'temporal' AS kind, start_s AS s, end_s AS e FROM temporal UNION ALL SELECT 'scene', s, e FROM ss WHERE e > s UNION ALL SELECT 'complexity', ts_s, ts_s + 3 FROM v_points WHERE complexity >= 0.6e0) GROUP BY kind""",
    "v_assets v_points", "total_s", 3, temporal=TEMPORAL, cuts=CUTS, scenes=SCENES, ss=SCENE_SAMPLES,
)
def _(spark, sf):
    tag = lambda df, kind, s, e: df.select(F.lit(kind).alias("kind"), F.col(s).alias("s"), F.col(e).alias("e"))
    scenes = W.scene_intervals(cuts(spark, sf), ends(spark, sf), min_s=0.0)
    hot = V.v_points(spark, sf).where("complexity >= 0.6").withColumn("e", F.col("ts_s") + 3)
    every = R.all_samples(
        tag(G.temporal_samples(V.v_assets(spark, sf), every_s=7.0), "temporal", "start_s", "end_s"),
        tag(G.scene_samples(scenes), "scene", "sample_start_s", "sample_end_s"), tag(hot, "complexity", "ts_s", "e"),
    )
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("total_s"))


@query(
    "scene_stats",
    """SELECT video_id, count(*) AS scenes, avg(end_s - start_s) AS avg_scene_s, count(*) FILTER (point_id % 3 = 0) AS critical, avg(point_id % 10) AS avg_spatial, CAST(max(point_id % 10) AS DOUBLE) AS max_spatial, var_pop(point_id % 10) AS var_spatial FROM scenes GROUP BY video_id""",
    "v_points", "avg_scene_s avg_spatial var_spatial", cuts=CUTS, scenes=SCENES,
)
def _(spark, sf):
    scenes = W.scene_intervals(cuts(spark, sf), ends(spark, sf), min_s=0.0)
    s = scenes.select("video_id", "start_s", "end_s", (F.col("point_id") % 3 == 0).alias("is_critical"), (F.col("point_id") % 10).cast("double").alias("spatial"))
    return A.scene_stats(s)
