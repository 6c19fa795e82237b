"""Queries for grouped and global statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.functions import logs as L, scalars as S
from reelscope.operators import aggregates as A
from reelscope.registry.base import query
from reelscope.registry.scalars import CLASSIFIED
from reelscope.sources import views as V
from reelscope.sources.views import pick

OP_STATS = """SELECT op_name, count(*) AS n, 100.0e0 * count(*) FILTER (success) / count(*) AS success_rate,
  avg(duration) AS avg_duration, min(duration) AS min_duration, max(duration) AS max_duration, sum(duration) AS total_duration,
  avg(memory_delta) AS avg_memory, min(memory_delta) AS min_memory, max(memory_delta) AS max_memory
FROM v_ops GROUP BY op_name"""


@query("op_stats", OP_STATS, "v_ops",
       "success_rate avg_duration min_duration max_duration total_duration avg_memory min_memory max_memory")
def _(spark, sf):
    return A.op_stats(V.v_ops(spark, sf))


SESSION_SUMMARY = """SELECT count(*) AS total_sessions, count(*) FILTER (success) AS successful_sessions, 100.0e0 * count(*) FILTER (success) / count(*) AS success_rate,
      avg(duration) FILTER (success AND duration <> 0) AS avg_duration, coalesce(stddev_samp(duration) FILTER (success AND duration <> 0), 0) AS std_duration,
      min(duration) FILTER (success AND duration <> 0) AS min_duration, max(duration) FILTER (success AND duration <> 0) AS max_duration,
      avg(final_mb / target_mb * 100) FILTER (success AND final_mb <> 0) AS avg_utilisation, min(final_mb / target_mb * 100) FILTER (success AND final_mb <> 0) AS min_utilisation,
      max(final_mb / target_mb * 100) FILTER (success AND final_mb <> 0) AS max_utilisation, median(duration) FILTER (success AND duration <> 0) AS median_duration
    FROM v_sessions"""


@query(
    "session_summary",
    SESSION_SUMMARY,
    "v_sessions",
    "success_rate avg_duration std_duration min_duration max_duration avg_utilisation min_utilisation max_utilisation median_duration",
)
def _(spark, sf):
    return A.session_summary(V.v_sessions(spark, sf))


@query(
    "daily_stats",
    """SELECT CAST(start_ts AS DATE) AS day, count(*) AS sessions, coalesce(avg(nullif(duration, 0)), 0) AS avg_duration, coalesce(sum(duration), 0) AS total_time,
      100.0e0 * count(*) FILTER (success) / count(*) AS success_rate FROM v_sessions GROUP BY 1""",
    "v_sessions", "avg_duration total_time success_rate", 9,
)
def _(spark, sf):
    return A.daily_stats(V.v_sessions(spark, sf))


@query(
    "platform_stats",
    """SELECT coalesce(platform, 'unknown') AS platform, count(*) AS sessions, coalesce(avg(nullif(duration, 0)), 0) AS avg_duration,
      coalesce(avg(CASE WHEN final_mb <> 0 AND target_mb > 0 THEN final_mb / target_mb * 100 END), 0) AS avg_utilisation,
      100.0e0 * count(*) FILTER (success) / count(*) AS success_rate FROM v_sessions GROUP BY 1""",
    "v_sessions", "avg_duration avg_utilisation success_rate", 9,
)
def _(spark, sf):
    return A.platform_stats(V.v_sessions(spark, sf))


DIR = "CASE WHEN abs({0}) < 0.01e0 THEN 'stable' WHEN {0} > 0 THEN 'increasing' ELSE 'decreasing' END"


@query(
    "op_trends",
    f"""SELECT op_name, n, avg_duration, duration_slope, {DIR.format('duration_slope')} AS duration_trend, success_rate, success_slope, {DIR.format('success_slope')} AS success_trend
    FROM (SELECT op_name, count(*) AS n, avg(duration) AS avg_duration, regr_slope(duration, rn) AS duration_slope,
      100.0e0 * avg(CASE WHEN success THEN 1 ELSE 0 END) AS success_rate, regr_slope(CASE WHEN success THEN 1 ELSE 0 END, rn) AS success_slope
      FROM (SELECT *, row_number() OVER (PARTITION BY op_name ORDER BY ts, op_id) AS rn FROM v_ops) GROUP BY op_name HAVING count(*) >= 3)""",
    "v_ops", "avg_duration duration_slope success_rate success_slope",
)
def _(spark, sf):
    return A.op_trends(V.v_ops(spark, sf))


@query(
    "trend_significance",
    f"""SELECT owner, n, slope, {DIR.format('slope')} AS direction, CASE WHEN n < 5 THEN 'insufficient_data' WHEN hi = lo THEN 'no_variation'
      WHEN abs(slope) / (hi - lo) * n > 0.5e0 THEN 'significant' WHEN abs(slope) / (hi - lo) * n > 0.2e0 THEN 'moderate' ELSE 'minimal' END AS significance
    FROM (SELECT owner, count(*) AS n, CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(duration, rn) END AS slope, min(duration) AS lo, max(duration) AS hi FROM
      (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY start_ts, session_id) AS rn FROM v_sessions WHERE success AND coalesce(duration, 0) <> 0) GROUP BY owner)""",
    "v_sessions", "slope", 9,
)
def _(spark, sf):
    return A.trend_significance(V.v_sessions(spark, sf), ["owner"])


LOOKUPS = "SELECT success AS hit, duration AS response_s FROM v_ops WHERE op_name = 'view'"


def lookups(spark, sf):
    ops = V.v_ops(spark, sf).where(F.col("op_name") == "view")
    return ops.select(F.col("success").alias("hit"), F.col("duration").alias("response_s"))


LOOKUP_STATS = """SELECT count(*) AS total_lookups, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses,
  100.0e0 * count(*) FILTER (hit) / count(*) AS hit_rate, 100.0e0 * count(*) FILTER (NOT hit) / count(*) AS miss_rate, avg(response_s) AS avg_response_s FROM lookups"""


@query(
    "cache_stats",
    f"""SELECT * FROM (SELECT count(*) AS entries, sum(data_size) / 1048576.0e0 AS total_mb, avg(access_count) AS avg_access FROM v_cache) CROSS JOIN ({LOOKUP_STATS})""",
    "v_cache v_ops", "total_mb avg_access hit_rate miss_rate avg_response_s", lookups=LOOKUPS,
)
def _(spark, sf):
    return A.cache_stats(V.v_cache(spark, sf), lookups(spark, sf))


@query(
    "cache_age",
    """SELECT count(*) AS entries, count(*) FILTER (age < 1) AS fresh_entries, count(*) FILTER (age >= 1) AS old_entries, max(age) AS oldest_age_h, min(age) AS newest_age_h
    FROM (SELECT (epoch(TIMESTAMP '1998-08-02 00:30:00') - epoch(created_at)) / 3600.0e0 AS age FROM v_cache)""",
    "v_cache", "oldest_age_h newest_age_h",
)
def _(spark, sf):
    return A.cache_age(V.v_cache(spark, sf), F.to_timestamp(F.lit("1998-08-02 00:30:00")))


@query(
    "error_summary",
    """SELECT *, CASE WHEN level = 'total' THEN (SELECT category FROM classified GROUP BY category ORDER BY count(*) DESC, category LIMIT 1) END AS most_common FROM (
    SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(severity) = 0 THEN 'severity' ELSE 'total' END AS level, coalesce(category, severity, 'all') AS key,
      count(*) AS n, count(*) FILTER (retryable) AS retryable, count(*) FILTER (NOT retryable) AS non_retryable
    FROM classified GROUP BY GROUPING SETS ((category), (severity), ()))""",
    "v_errors", classified=CLASSIFIED,
)
def _(spark, sf):
    return A.error_summary(S.classify_errors(V.v_errors(spark, sf)))


METRICS = ("cache_hits", "cache_misses", "retries", "segmentation_events", "guardrail_events", "timeout_events",
           "validation_failures", "summary_cleanups", "mp4_moves")
TRACKED = """SELECT event_id AS seq, CASE k % 9 """ + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(METRICS)) + """ END AS metric,
  event_type AS context, k % 4 AS amount FROM v_events"""


def tracked(spark, sf):
    return V._events(spark, sf).select(
        F.col("event_id").alias("seq"), "ts", pick(F.col("k"), *METRICS).alias("metric"),
        F.col("event_type").alias("context"), (F.col("k") % 4).alias("amount"),
    )


@query(
    "tracker_rollup",
    """SELECT CASE WHEN context IS NULL THEN metric ELSE metric || '_' || context END AS counter, CAST(sum(amount) AS BIGINT) AS total
    FROM tracked WHERE amount > 0 GROUP BY ROLLUP (metric, context) HAVING metric IS NOT NULL""",
    "v_events", tracked=TRACKED,
)
def _(spark, sf):
    return A.tracker(tracked(spark, sf))


MIN_KBPS = "CASE encoder WHEN 'libx264' THEN 10 WHEN 'libx265' THEN 15 WHEN 'h264_nvenc' THEN 8 WHEN 'h264_amf' THEN 8 WHEN 'h264_qsv' THEN 8 WHEN 'h264_videotoolbox' THEN 8 ELSE 10 END"


@query(
    "validation_summary",
    f"""SELECT encoder, count(*) AS n, count(*) FILTER (sev = 'info') AS valid, count(*) FILTER (sev = 'warning') AS warnings, count(*) FILTER (sev = 'critical') AS criticals,
      100.0e0 * count(*) FILTER (sev = 'info') / count(*) AS success_rate, bool_and(sev = 'info') AS all_valid
    FROM (SELECT encoder, CASE WHEN rate >= mn THEN 'info' WHEN mn / greatest(rate, 1) > 2 THEN 'critical' ELSE 'warning' END AS sev
      FROM (SELECT encoder, bitrate_kbps // 200 AS rate, {MIN_KBPS} AS mn FROM v_encodes)) GROUP BY encoder""",
    "v_encodes", "success_rate",
)
def _(spark, sf):
    e = V.v_encodes(spark, sf).select("encoder", S.whole(F.col("bitrate_kbps") / 200).alias("bitrate_kbps"))
    return A.floor_audit(e)


SSIM_SQL = """SELECT log_id, CASE WHEN len(kept) > 0 THEN list_avg(kept) END AS ssim,
  CASE WHEN len(kept) > 0 THEN len(valid) / len(raw) * 0.4e0 + CASE WHEN len(kept) > 1 THEN greatest(0.0e0, 1 - list_stddev_samp(kept) * 10) ELSE 0.5e0 END * 0.4e0 + least(1.0e0, len(kept) / 10) * 0.2e0 ELSE 0.0e0 END AS ssim_conf,
  len(kept) AS ssim_frames
FROM (SELECT *, CASE WHEN len(valid) >= 4 THEN list_filter(valid, lambda x: x >= q1 - 1.5e0 * (q3 - q1) AND x <= q3 + 1.5e0 * (q3 - q1)) ELSE valid END AS kept
  FROM (SELECT *, list_sort(valid)[len(valid) // 4 + 1] AS q1, list_sort(valid)[3 * len(valid) // 4 + 1] AS q3
    FROM (SELECT *, list_filter(raw, lambda x: x >= 0 AND x <= 1) AS valid
      FROM (SELECT log_id, list_transform(regexp_extract_all(ssim_text, 'n:\\d+\\s+Y:([\\d.]+)', 1), lambda x: CAST(x AS DOUBLE)) AS raw FROM v_eval_logs))))"""


@query("ssim_robust", SSIM_SQL, "v_eval_logs", "ssim ssim_conf")
def _(spark, sf):
    return L.ssim_scores(V.v_eval_logs(spark, sf), "ssim_text").select("log_id", "ssim", "ssim_conf", "ssim_frames")


@query(
    "vmaf_scores",
    r"""SELECT log_id, vmaf_format, TRY_CAST(score AS DOUBLE) AS vmaf FROM (
    SELECT log_id, CASE WHEN num = '' THEN 'unknown' ELSE CASE log_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'xml' WHEN 2 THEN 'text' ELSE 'unknown' END END AS vmaf_format, num AS score
    FROM (SELECT log_id, regexp_extract(vmaf_text, ':([\d.]+)', 1) AS num FROM v_eval_logs))""",
    "v_eval_logs", "vmaf",
)
def _(spark, sf):
    logs = V.v_eval_logs(spark, sf)
    num = F.regexp_extract("vmaf_text", r":([\d.]+)", 1)
    xml = F.concat(F.lit('<?xml version="1.0"?>\n<VMAF><pooled_metrics><metric name="vmaf" min="1" mean="'), num, F.lit('"/></pooled_metrics></VMAF>'))
    text = (
        F.when(num == "", "frame= 12").when(F.col("log_id") % 4 == 0, F.concat(F.lit("libvmaf ok\n"), F.col("vmaf_text")))
        .when(F.col("log_id") % 4 == 1, xml).when(F.col("log_id") % 4 == 2, F.concat(F.lit("VMAF score: 3.5\nVMAF score: "), num))
        .otherwise(F.concat(F.lit("vmaf pooled = "), num, F.lit(" of 1 run")))
    )
    return L.vmaf_scores(logs.select("log_id", text.alias("text"))).select("log_id", "vmaf_format", "vmaf")


@query(
    "gate_confidence",
    """SELECT job_id, step, CASE method WHEN 'vmaf+ssim' THEN CASE WHEN vmaf IS NOT NULL AND ssim IS NOT NULL THEN (vc + sc) / 2 WHEN vmaf IS NOT NULL THEN vc * 0.8e0 WHEN ssim IS NOT NULL THEN sc * 0.6e0 ELSE 0.0e0 END
      WHEN 'ssim_only' THEN CASE WHEN ssim IS NOT NULL THEN sc * 0.9e0 ELSE 0.0e0 END ELSE 0.0e0 END AS confidence
    FROM (SELECT job_id, step, vmaf, CASE WHEN ssim < 0.98e0 THEN ssim END AS ssim, crf / 30 AS vc, tax * 10 AS sc, CASE preset WHEN 'fast' THEN 'ssim_only' WHEN 'slow' THEN 'vmaf+ssim' ELSE 'error' END AS method FROM v_encodes)""",
    "v_encodes", "confidence",
)
def _(spark, sf):
    method = F.when(F.col("preset") == "fast", "ssim_only").when(F.col("preset") == "slow", "vmaf+ssim").otherwise("error")
    e = V.v_encodes(spark, sf).select(
        "job_id", "step", "vmaf", F.when(F.col("ssim") < 0.98, F.col("ssim")).alias("ssim"), (F.col("crf") / 30).alias("vmaf_conf"),
        (F.col("tax") * 10).alias("ssim_conf"), method.alias("method"),
    )
    return A.with_gate_confidence(e).select("job_id", "step", "confidence")


@query(
    "prediction_mae",
    """SELECT encoder, count(*) AS evaluations, avg(abs(110 - crf * 1.5e0 - vmaf)) AS vmaf_mae, count(vmaf) AS vmaf_n, avg(abs(0.93e0 - ssim)) AS ssim_mae, count(ssim) AS ssim_n,
      avg(abs(30 - size_mb * 2)) AS time_s_mae, count(size_mb) AS time_s_n FROM v_encodes WHERE tax > 0.01e0 GROUP BY encoder""",
    "v_encodes", "vmaf_mae ssim_mae time_s_mae",
)
def _(spark, sf):
    e = V.v_encodes(spark, sf).select(
        "encoder", "vmaf", "ssim", (F.col("size_mb") * 2).alias("time_s"), (110 - F.col("crf") * 1.5).alias("pred_vmaf"),
        F.lit(0.93).alias("pred_ssim"), F.lit(30.0).alias("pred_time_s"), (F.col("tax") > 0.01).alias("evaluated"),
    )
    return A.prediction_mae(e, ["encoder"])


@query(
    "attempt_stats",
    """SELECT session_id, count(*) AS attempts, count(*) FILTER (result = 'SUCCESS') AS successes, count(*) FILTER (result = 'FAILURE') AS failures, count(*) FILTER (result = 'TIMEOUT') AS timeouts,
      sum(duration) AS total_time, coalesce(avg(duration) FILTER (result = 'SUCCESS'), 0) AS avg_success_duration, coalesce(avg(confidence) FILTER (result = 'SUCCESS'), 0) AS avg_confidence,
      greatest(0, 3 - count(*)) AS remaining_attempts, greatest(0.0e0, 300 - sum(duration)) AS remaining_time FROM v_attempts GROUP BY session_id""",
    "v_attempts", "total_time avg_success_duration avg_confidence remaining_time",
)
def _(spark, sf):
    return A.attempt_stats(V.v_attempts(spark, sf))


@query(
    "param_gradient",
    """SELECT job_id, count(*) AS n, coalesce(CASE WHEN count(vmaf) >= 2 AND stddev_pop(bitrate_kbps) FILTER (vmaf IS NOT NULL) > 0 AND stddev_pop(vmaf) > 0 THEN corr(vmaf, bitrate_kbps) END, 0) AS quality_gradient,
      coalesce(CASE WHEN count(size_mb) >= 2 AND stddev_pop(bitrate_kbps) > 0 AND stddev_pop(size_mb) > 0 THEN corr(size_mb, bitrate_kbps) END, 1) AS size_gradient FROM v_encodes GROUP BY job_id""",
    "v_encodes", "quality_gradient size_gradient",
)
def _(spark, sf):
    return A.gradients(V.v_encodes(spark, sf).withColumnRenamed("vmaf", "quality"))


@query(
    "batch_outcome",
    """SELECT count(*) AS processed, count(*) FILTER (status = 'ok') AS successful, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed,
      100.0e0 * count(*) FILTER (status = 'ok') / count(*) AS success_rate, 100.0e0 * count(*) FILTER (status = 'failed') / count(*) AS failure_rate
    FROM (SELECT CASE WHEN duration < 20 THEN 'skipped' WHEN success THEN 'ok' ELSE 'failed' END AS status FROM v_sessions)""",
    "v_sessions", "success_rate failure_rate",
)
def _(spark, sf):
    status = F.when(F.col("duration") < 20, "skipped").when(F.col("success"), "ok").otherwise("failed")
    return A.batch_outcome(V.v_sessions(spark, sf).select(status.alias("status")))


def nested_sessions(spark, sf):
    """Sessions with up to seven nested operations each (one per encode step of the same key)."""
    enc = V.v_encodes(spark, sf).select(
        F.col("job_id").alias("session_id"), "step",
        pick(F.col("crf"), "cache_lookup", "encode", "probe", "quality_cache").alias("op_name"),
        F.col("size_mb").alias("duration"), (F.col("tax") > 0.03).alias("success"),
    )
    ops = enc.groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct("step", "op_name", "duration", "success"))).alias("operations")
    )
    return V.v_sessions(spark, sf).join(ops, "session_id", "left").withColumn(
        "operations", F.coalesce("operations", F.array().cast("array<struct<step:bigint,op_name:string,duration:double,success:boolean>>"))
    )


NESTED_OPS = """SELECT job_id AS session_id, step, CASE crf % 4 WHEN 0 THEN 'cache_lookup' WHEN 1 THEN 'encode' WHEN 2 THEN 'probe' ELSE 'quality_cache' END AS op_name,
  size_mb AS duration, tax > 0.03e0 AS success FROM v_encodes"""


@query(
    "session_hit_rate",
    """SELECT session_id, hits / nullif(cache_ops, 0) AS cache_hit_rate, CASE WHEN final_mb <> 0 THEN final_mb / target_mb END AS compression_ratio
    FROM v_sessions LEFT JOIN (SELECT session_id, count(*) FILTER (contains(op_name, 'cache')) AS cache_ops, count(*) FILTER (contains(op_name, 'cache') AND success) AS hits FROM nested GROUP BY session_id) USING (session_id)""",
    "v_sessions v_encodes", "cache_hit_rate compression_ratio", 9, nested=NESTED_OPS,
)
def _(spark, sf):
    return A.session_enrich(nested_sessions(spark, sf)).select("session_id", "cache_hit_rate", "compression_ratio")


@query(
    "history_trend",
    """SELECT avg(hit_rate) AS avg_hit_rate, min(hit_rate) AS min_hit_rate, max(hit_rate) AS max_hit_rate, avg(response_s) AS avg_response_s, min(response_s) AS min_response_s, max(response_s) AS max_response_s,
      avg(cache_mb) AS avg_cache_mb, min(cache_mb) AS min_cache_mb, max(cache_mb) AS max_cache_mb,
      CASE WHEN arg_max(hit_rate, h) > arg_min(hit_rate, h) THEN 'improving' ELSE 'declining' END AS trend
    FROM (SELECT date_trunc('hour', ts) AS h, count(*) FILTER (success) / count(*) AS hit_rate, avg(duration) AS response_s, sum(duration) / 100 AS cache_mb FROM v_ops GROUP BY 1)""",
    "v_ops", "avg_hit_rate min_hit_rate max_hit_rate avg_response_s min_response_s max_response_s avg_cache_mb min_cache_mb max_cache_mb",
)
def _(spark, sf):
    snaps = V.v_ops(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("h")).agg(
        (F.count_if("success") / F.count(F.lit(1))).alias("hit_rate"), F.avg("duration").alias("response_s"),
        (F.sum("duration") / 100).alias("cache_mb"),
    )
    return A.history_trend(snaps, ["h"])


SEG_IDX = "SELECT job_id AS folder, CASE WHEN crf % 5 = 0 THEN step + 1 ELSE step END AS idx, ssim < 0.98e0 AS valid FROM v_encodes"
FOLDERS = "SELECT folder, count(*) AS n, count(*) FILTER (valid) AS ok, max(idx) AS mx, count(DISTINCT idx) AS present FROM segs GROUP BY folder"


def segment_files(spark, sf):
    e = V.v_encodes(spark, sf)
    idx = F.when(F.col("crf") % 5 == 0, F.col("step") + 1).otherwise(F.col("step"))
    return e.select(
        F.col("job_id").alias("folder"), F.concat(F.lit("clip_segment_"), F.lpad(idx.cast("string"), 2, "0"), F.lit(".gif")).alias("name"),
        (F.col("ssim") < 0.98).alias("valid"),
    )


@query(
    "folder_validity",
    """SELECT folder, n AS gifs, CASE WHEN n < mx THEN 0 ELSE ok END AS valid_gifs, CASE WHEN n < mx THEN n ELSE n - ok END AS invalid_gifs, CASE WHEN n < mx THEN mx - present ELSE 0 END AS missing, n >= mx AND ok > 0 AS usable FROM folders""",
    "v_encodes", segs=SEG_IDX, folders=FOLDERS,
)
def _(spark, sf):
    return A.folder_validity(segment_files(spark, sf))


@query(
    "missing_segments",
    """SELECT folder, i AS segment_no FROM (SELECT folder, unnest(range(1, mx + 1)) AS i FROM folders WHERE n < mx) f WHERE NOT EXISTS (SELECT 1 FROM segs s WHERE s.folder = f.folder AND s.idx = f.i)""",
    "v_encodes", segs=SEG_IDX, folders=FOLDERS,
)
def _(spark, sf):
    return A.missing_segments(segment_files(spark, sf))
