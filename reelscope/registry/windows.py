"""Queries for ordered analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.operators import frames as FR, windows as W
from reelscope.registry.base import query
from reelscope.sources import views as V
from reelscope.sources.views import pick

MOTION = """SELECT video_id, frame_idx, ts_s, list_sum(list_transform(list_zip(pixels, prev), lambda z: abs(z[1] - z[2]))) / len(pixels) / 255.0e0 AS motion
  FROM (SELECT *, lag(pixels) OVER (PARTITION BY video_id ORDER BY frame_idx) AS prev FROM v_frames)"""


@query("frame_motion", "SELECT * REPLACE (CASE WHEN frame_idx > 0 THEN motion END AS motion) FROM motion", "v_frames", "motion ts_s", motion=MOTION)
def _(spark, sf):
    return W.frame_motion(V.v_frames(spark, sf))


@query(
    "motion_level",
    """SELECT *, CASE lvl WHEN 'high' THEN 18.0e0 WHEN 'medium' THEN 16.2e0 ELSE 12.6e0 END AS optimal_fps FROM (
    SELECT video_id, avg(motion) AS avg_motion, max(motion) AS max_motion, var_pop(motion) AS var_motion, CASE WHEN avg(motion) > 0.08e0 OR max(motion) > 0.085e0 THEN 'high' WHEN avg(motion) > 0.0655e0 OR var_pop(motion) > 0.01e0 THEN 'medium' ELSE 'low' END AS lvl
    FROM motion WHERE frame_idx > 0 GROUP BY video_id)""",
    "v_frames", "avg_motion max_motion var_motion", motion=MOTION,
)
def _(spark, sf):
    out = W.video_motion_level(W.frame_motion(V.v_frames(spark, sf)), F.lit(18.0), high=0.08, peak=0.085, medium=0.0655)
    return out.drop("fps_range").withColumnRenamed("motion_level", "lvl")


HIST = """SELECT video_id, frame_idx, list_transform(range(0, 16), lambda b: CAST(len(list_filter(pixels, lambda x: x // 16 = b)) AS DOUBLE)) AS hist FROM v_frames"""
SIM = """SELECT video_id, frame_idx, (64 * dot - 64.0e0 * 64) / sqrt((64 * aa - 64.0e0 * 64) * (64 * bb - 64.0e0 * 64)) AS corr_raw,
   (dot - 64.0e0 * 64 / 16) / sqrt((aa - 64.0e0 * 64 / 16) * (bb - 64.0e0 * 64 / 16)) AS similarity
  FROM (SELECT *, list_dot_product(hist, prev) AS dot, list_dot_product(hist, hist) AS aa, list_dot_product(prev, prev) AS bb
    FROM (SELECT *, lag(hist) OVER (PARTITION BY video_id ORDER BY frame_idx) AS prev FROM hist))"""


@query("frame_similarity", "SELECT video_id, frame_idx, similarity FROM sim", "v_frames", "similarity", hist=HIST, sim=SIM)
def _(spark, sf):
    return W.frame_similarity(FR.histograms(V.v_frames(spark, sf)))


@query(
    "similarity_level",
    """SELECT video_id, avg_similarity, min_similarity, var_similarity, duplicate_share, CASE WHEN avg_similarity > 0.9e0 OR min_similarity > 0.85e0 THEN 'high' WHEN avg_similarity > 0.7e0 OR var_similarity < 0.01e0 THEN 'medium' ELSE 'low' END AS similarity_level,
      CASE WHEN avg_similarity > 0.9e0 OR min_similarity > 0.85e0 THEN 0.1e0 WHEN avg_similarity > 0.7e0 OR var_similarity < 0.01e0 THEN 0.2e0 ELSE 0.3e0 END AS optimal_frac
    FROM (SELECT video_id, avg(similarity) AS avg_similarity, min(similarity) AS min_similarity, var_pop(similarity) AS var_similarity, count(*) FILTER (similarity >= 0.95e0) / count(*) AS duplicate_share FROM sim WHERE similarity IS NOT NULL GROUP BY video_id)""",
    "v_frames", "avg_similarity min_similarity var_similarity duplicate_share", hist=HIST, sim=SIM,
)
def _(spark, sf):
    return W.similarity_level(W.frame_similarity(FR.histograms(V.v_frames(spark, sf))))


@query(
    "motion_segments",
    """SELECT video_id, start_s, end_s, avg_motion, motion_level, greatest(6.0e0, least(20.0e0, 18 * CASE motion_level WHEN 'high' THEN 1.0e0 WHEN 'medium' THEN 0.85e0 ELSE 0.6e0 END)) AS recommended_fps
    FROM (SELECT *, CASE WHEN avg_motion > 0.075e0 THEN 'high' WHEN avg_motion > 0.065e0 THEN 'medium' ELSE 'low' END AS motion_level FROM (
      SELECT video_id, min(start_s) AS start_s, max(end_s) AS end_s, sum(avg_motion * pow(0.5e0, hi - rn + CASE WHEN rn = lo THEN 0 ELSE 1 END)) AS avg_motion
      FROM (SELECT *, max(rn) OVER (PARTITION BY video_id, part) AS hi, min(rn) OVER (PARTITION BY video_id, part) AS lo
        FROM (SELECT *, sum(CASE WHEN end_s - start_s >= 0.5e0 OR start_s = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY run) AS part, row_number() OVER (PARTITION BY video_id ORDER BY run) AS rn
          FROM (SELECT video_id, run, avg_motion, (upto - n) * 0.2e0 AS start_s, CASE WHEN last_run THEN duration_s ELSE upto * 0.2e0 END AS end_s
            FROM (SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY run) AS upto, lead(run) OVER (PARTITION BY video_id ORDER BY run) IS NULL AS last_run
              FROM (SELECT video_id, run, count(*) AS n, avg(motion) AS avg_motion FROM (
                WITH RECURSIVE walk AS (
                  SELECT video_id, frame_idx, motion, frame_idx AS run, 1 AS n, motion AS total FROM motion WHERE frame_idx = 1
                  UNION ALL SELECT video_id, frame_idx, x, CASE WHEN cut THEN frame_idx ELSE run END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN x ELSE total + x END
                  FROM (SELECT m.video_id, m.frame_idx, m.motion AS x, w.run, w.n, w.total, w.n >= 2 AND abs(m.motion - w.total / w.n) > 0.006e0 AS cut
                    FROM walk w JOIN motion m ON m.video_id = w.video_id AND m.frame_idx = w.frame_idx + 1))
                SELECT * FROM walk) GROUP BY video_id, run))
            JOIN (SELECT video_id, max(ts_s) + 0.2e0 AS duration_s FROM v_frames GROUP BY video_id) USING (video_id))))
      GROUP BY video_id, part))""",
    "v_frames", "start_s end_s avg_motion recommended_fps", motion=MOTION,
)
def _(spark, sf):
    frames = V.v_frames(spark, sf)
    length = frames.groupBy("video_id").agg((F.max("ts_s") + 0.2).alias("duration_s"))
    return W.motion_segments(W.frame_motion(frames), F.lit(18.0), length, limit=0.006, high=0.075, medium=0.065)


@query(
    "dedup_frames",
    """SELECT video_id, kept AS frame_idx, CAST(count(*) * 100 AS BIGINT) AS show_ms, count(*) AS frames FROM (
    WITH RECURSIVE walk AS (
      SELECT video_id, frame_idx, frame_idx AS kept, hist FROM hist WHERE frame_idx = 0
      UNION ALL SELECT video_id, frame_idx, CASE WHEN same THEN kept ELSE frame_idx END, CASE WHEN same THEN held ELSE hist END
      FROM (SELECT h.video_id, h.frame_idx, w.kept, w.hist AS held, h.hist, list_sum(list_transform(list_zip(h.hist, w.hist), lambda z: least(z[1], z[2]) / 64)) >= 0.8e0 AS same
        FROM walk w JOIN hist h ON h.video_id = w.video_id AND h.frame_idx = w.frame_idx + 1))
    SELECT * FROM walk) GROUP BY video_id, kept""",
    "v_frames", hist=HIST,
)
def _(spark, sf):
    frames = V.v_frames(spark, sf)
    hist = FR.histograms(frames).withColumn("show_ms", F.lit(100))
    return W.dedup_frames(hist, threshold=0.8)


@query(
    "complexity_regions",
    """SELECT *, start_s + least(14400.0e0, end_s - start_s) AS sample_end_s FROM (
    SELECT video_id, min(ts_s) AS start_s, max(ts_s) AS end_s, avg(complexity) AS avg_complexity FROM (
      SELECT *, sum(CASE WHEN prev IS NULL OR ts_s - prev > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY ts_s, point_id) AS island FROM (
        SELECT *, lag(ts_s) OVER (PARTITION BY video_id ORDER BY ts_s, point_id) AS prev FROM v_points WHERE complexity >= 0.6e0)) GROUP BY video_id, island) WHERE end_s - start_s >= 0.5e0""",
    "v_points", "start_s end_s avg_complexity sample_end_s",
)
def _(spark, sf):
    return W.regions(V.v_points(spark, sf), threshold=0.6, gap=43200.0, max_s=14400.0)


CUTS = "SELECT video_id, point_id, ts_s AS cut_s FROM v_points WHERE is_keyframe"
END = 1706745600.0


def cuts(spark, sf):
    return V.v_points(spark, sf).where("is_keyframe").select("video_id", "point_id", F.col("ts_s").alias("cut_s"))


def ends(spark, sf):
    return V.v_points(spark, sf).select("video_id").distinct().withColumn("duration_s", F.lit(END))


@query(
    "scene_intervals",
    """SELECT * FROM (SELECT video_id, point_id, cut_s AS start_s, lead(cut_s, 1, 1706745600.0e0) OVER (PARTITION BY video_id ORDER BY cut_s, point_id) AS end_s FROM cuts) WHERE end_s - start_s >= 3600""",
    "v_points", "start_s end_s", cuts=CUTS,
)
def _(spark, sf):
    return W.scene_intervals(cuts(spark, sf), ends(spark, sf), min_s=3600.0)


@query(
    "lru_evict",
    """SELECT cache_key, data_size, last_accessed FROM (SELECT *, sum(data_size) OVER (ORDER BY last_accessed, cache_key) - data_size AS before, sum(data_size) OVER () AS total FROM v_cache)
    WHERE total > 2000000000 AND before < total - 1600000000""",
    "v_cache",
)
def _(spark, sf):
    return W.lru_evict(V.v_cache(spark, sf).select("cache_key", "data_size", "last_accessed"), 2e9)


SAMPLES = """SELECT point_id AS sample_id, video_id, ts_s AS start_s, 600 + complexity * 6000 AS duration_s, ts_s + 600 + complexity * 6000 AS end_s, CASE point_id % 3 WHEN 0 THEN 'temporal' WHEN 1 THEN 'scene' ELSE 'complexity' END AS sample_type FROM v_points"""


def samples(spark, sf):
    length = F.col("complexity") * 6000 + 600
    return V.v_points(spark, sf).select(
        F.col("point_id").alias("sample_id"), "video_id", F.col("ts_s").alias("start_s"), length.alias("duration_s"),
        (F.col("ts_s") + 600 + F.col("complexity") * 6000).alias("end_s"), pick(F.col("point_id"), "temporal", "scene", "complexity").alias("sample_type"),
    )


@query(
    "sample_budget",
    """SELECT sample_id, video_id, start_s, CASE WHEN run <= 50000 THEN duration_s ELSE 50000 - before END AS duration_s, start_s + CASE WHEN run <= 50000 THEN duration_s ELSE 50000 - before END AS end_s, sample_type
    FROM (SELECT *, run - duration_s AS before FROM (SELECT *, sum(duration_s) OVER (PARTITION BY video_id ORDER BY start_s, sample_id) AS run FROM samples)) WHERE run <= 50000 OR (before <= 50000 AND 50000 - before > 0.5e0)""",
    "v_points", "start_s duration_s end_s", 3, samples=SAMPLES,
)
def _(spark, sf):
    return W.sample_budget(samples(spark, sf), 50000.0)


@query(
    "sample_overlap",
    """SELECT sample_id, video_id, start_s, duration_s, end_s, sample_type FROM (SELECT *, row_number() OVER (PARTITION BY video_id, slot ORDER BY start_s DESC, sample_id DESC) AS r FROM (
    WITH RECURSIVE turn AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_s, sample_id) AS rn, CASE sample_type WHEN 'complexity' THEN 3 WHEN 'scene' THEN 2 ELSE 1 END AS rank FROM samples),
    walk AS (
      SELECT *, sample_id AS slot, end_s AS until, rank AS held, true AS taken FROM turn WHERE rn = 1
      UNION ALL SELECT t.*, CASE WHEN t.start_s >= w.until THEN t.sample_id ELSE w.slot END, CASE WHEN t.start_s >= w.until OR t.rank > w.held THEN t.end_s ELSE w.until END,
        CASE WHEN t.start_s >= w.until OR t.rank > w.held THEN t.rank ELSE w.held END, t.start_s >= w.until OR t.rank > w.held
      FROM walk w JOIN turn t ON t.video_id = w.video_id AND t.rn = w.rn + 1)
    SELECT * FROM walk) WHERE taken) WHERE r = 1""",
    "v_points", "start_s duration_s end_s", samples=SAMPLES,
)
def _(spark, sf):
    return W.sample_overlap(samples(spark, sf), block_s=86400.0)


@query(
    "convergence",
    """SELECT job_id, step, CASE WHEN step >= 6 THEN 'max_iterations' WHEN step < 4 OR q0 IS NULL OR q1 IS NULL OR q2 IS NULL THEN 'improving'
      WHEN greatest(0, q0 - q1, q1 - q2) < 4 THEN CASE WHEN ((q0 - m) * (q0 - m) + (q1 - m) * (q1 - m) + (q2 - m) * (q2 - m)) / 3 < 0.1e0 THEN 'converged' ELSE 'stagnant' END WHEN q0 - q2 < -2 THEN 'diverging' ELSE 'improving' END AS status
    FROM (SELECT *, (q0 + q1 + q2) / 3 AS m FROM (SELECT job_id, step, vmaf AS q0, lag(vmaf) OVER w AS q1, lag(vmaf, 2) OVER w AS q2 FROM v_encodes WINDOW w AS (PARTITION BY job_id ORDER BY step)))""",
    "v_encodes",
)
def _(spark, sf):
    e = V.v_encodes(spark, sf).select("job_id", "step", F.col("vmaf").alias("quality"))
    return W.convergence(e, ["job_id"], max_iterations=6, threshold=4.0).select("job_id", "step", "status")


RUNS = """SELECT attempt_id, session_id, ts, eval_type, result, duration, confidence, attempt_no, sum(duration) OVER (PARTITION BY session_id ORDER BY ts, attempt_id) AS total_time,
    attempt_no - coalesce(max(CASE WHEN result <> 'FAILURE' THEN attempt_no END) OVER (PARTITION BY session_id ORDER BY ts, attempt_id), 0) AS consecutive_failures,
    count(*) FILTER (result = 'FAILURE') OVER (PARTITION BY session_id ORDER BY epoch_us(ts) RANGE BETWEEN {us} PRECEDING AND CURRENT ROW) AS recent_failures
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, attempt_id) AS attempt_no FROM v_attempts)"""


@query("failure_runs", "SELECT attempt_id, attempt_no, total_time, consecutive_failures, recent_failures FROM runs", "v_attempts", "total_time",
       runs=RUNS.format(us=36000 * 1000000))
def _(spark, sf):
    out = W.failure_runs(V.v_attempts(spark, sf), window_s=36000)
    return out.select("attempt_id", F.col("attempt_no").cast("bigint").alias("attempt_no"), "total_time",
                      F.col("consecutive_failures").cast("bigint").alias("consecutive_failures"), "recent_failures")


@query(
    "degradation",
    """SELECT owner, n, slope, slope > 0.2e0 AS degrading FROM (SELECT owner, count(*) AS tail, count(*) FILTER (ok) AS n, regr_slope(duration, o) FILTER (ok) AS slope FROM (
      SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY owner, ok ORDER BY start_ts, session_id) END AS o FROM (SELECT *, success AND coalesce(duration, 0) <> 0 AS ok, row_number() OVER (PARTITION BY owner ORDER BY start_ts DESC, session_id DESC) AS r FROM v_sessions) WHERE r <= 5)
      GROUP BY owner) WHERE tail >= 5 AND n >= 3""",
    "v_sessions", "slope", 9,
)
def _(spark, sf):
    return W.degradation(V.v_sessions(spark, sf), ["owner"])


@query(
    "improvement",
    """SELECT job_id, step, CASE WHEN coalesce(vmaf, 0) <> 0 AND coalesce(pq, 0) <> 0 THEN vmaf - pq + CASE WHEN size_mb <> 0 AND pm <> 0 THEN (vmaf / size_mb - pq / pm) * 10 ELSE 0 END ELSE 0.0e0 END AS step_gain
    FROM (SELECT job_id, step, vmaf, size_mb, lag(vmaf) OVER w AS pq, lag(size_mb) OVER w AS pm FROM v_encodes WINDOW w AS (PARTITION BY job_id ORDER BY step))""",
    "v_encodes", "step_gain",
)
def _(spark, sf):
    e = V.v_encodes(spark, sf).select("job_id", "step", F.col("vmaf").alias("quality"), "size_mb")
    return W.improvement(e, ["job_id"]).select("job_id", "step", "step_gain")


@query(
    "total_improvement",
    """SELECT job_id, CASE WHEN coalesce(a, 0) <> 0 AND coalesce(b, 0) <> 0 THEN b - a ELSE 0.0e0 END AS total_gain FROM (SELECT job_id, first(vmaf ORDER BY step) AS a, last(vmaf ORDER BY step) AS b FROM v_encodes GROUP BY job_id)""",
    "v_encodes", "total_gain",
)
def _(spark, sf):
    e = V.v_encodes(spark, sf).select("job_id", "step", F.col("vmaf").alias("quality"))
    return W.total_improvement(e, ["job_id"])
