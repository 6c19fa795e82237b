"""Queries for streaming operators and jobs.

Streams read the event table file as a source, run to the end of what is available, write an
epoch sink in the shared folder, and the query returns that sink's table.
"""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from reelscope import jobs
from reelscope.functions import logs as L, scalars as S
from reelscope.operators import generate as G, rank as R
from reelscope.registry.aggregates import METRICS, TRACKED
from reelscope.registry.base import query
from reelscope.registry.joins import OUTPUTS, PROCESSED, listed, outputs, processed
from reelscope.registry.scalars import LEVEL, MIB
from reelscope.registry.sources import scratch
from reelscope.registry.windows import RUNS
from reelscope.sources import views as V
from reelscope.sources.views import pick
from reelscope.streaming import sinks, streams as ST


def event_stream(spark, sf):
    schema = V.table(spark, sf, "events").schema
    raw = ST.table_stream(spark, sf, "events.parquet", schema)
    return raw.withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumn("ts", F.col("ts").cast("timestamp"))


def run(spark, stream, name, mode="append"):
    """Run the stream into an epoch sink and read it back."""
    path = scratch(spark, name)
    sinks.run_available(stream, f"{path}/_checkpoint", sinks.epoch_writer(f"{path}/out"), mode)
    rows = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")
    return rows.drop(sinks.EPOCH)


def run_keyed(spark, stream, name, keys, mode="update"):
    path = scratch(spark, name)
    sinks.run_available(stream, f"{path}/_checkpoint", sinks.epoch_writer(f"{path}/out"), mode)
    schema = T.StructType([*stream.schema.fields, T.StructField(sinks.EPOCH, T.IntegerType())])
    return sinks.latest(spark, f"{path}/out", keys, schema)


@query("watch_folder")
def _(spark, sf):
    stream = ST.watch(spark, sf, max_files=5, extensions=(".parquet",))
    return run(spark, stream, "watch").select("path", "length")


LOOKS = "SELECT event_id, 'f' || user_id AS path, CAST(floor(value) AS BIGINT) % 3 AS size, CAST(floor(epoch(date_trunc('day', ts))) AS DOUBLE) AS mtime_s, CAST(floor(epoch(ts)) AS DOUBLE) AS look_s FROM events"


@query(
    "stable_files",
    """SELECT path, arg_min(size, (look_s, size)) AS size, arg_min(mtime_s, (look_s, size)) AS mtime_s, min(look_s) AS accepted_at_s FROM (SELECT *, lag(size) OVER w AS ps, lag(mtime_s) OVER w AS pm FROM looks WINDOW w AS (PARTITION BY path ORDER BY look_s, size))
    WHERE look_s - mtime_s > 80000 OR (ps = size AND pm = mtime_s) GROUP BY path""",
    looks=LOOKS,
)
def _(spark, sf):
    looks = event_stream(spark, sf).select(
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), (F.floor("value") % 3).alias("size"),
        F.unix_timestamp(F.date_trunc("day", "ts")).cast("double").alias("mtime_s"), F.unix_timestamp("ts").cast("double").alias("look_s"),
    )
    return run(spark, ST.stable(looks, 80000.0), "stable")


@query(
    "skip_done",
    """SELECT (SELECT count(*) FROM v_files) AS files, count(*) AS misses, (SELECT count(*) FROM v_files) - count(*) AS hits FROM v_files f WHERE NOT EXISTS (SELECT 1 FROM processed p WHERE p.path = f.path AND p.size = f.size
      AND ((p.out_type IN ('single_gif', 'gif_input') AND EXISTS (SELECT 1 FROM outputs o WHERE o.path = p.output)) OR (p.out_type = 'segments' AND EXISTS (SELECT 1 FROM outputs o WHERE starts_with(o.path, p.output || '/') AND ends_with(o.path, '.gif')))))""",
    "v_files", processed=PROCESSED, outputs=OUTPUTS,
)
def _(spark, sf):
    done, outs = processed(spark, sf), outputs(spark, sf)
    path = scratch(spark, "skip")
    schema = V.table(spark, sf, "documents").schema
    d = F.col("doc_id")
    mtime = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=d.cast("decimal(18,6)"))
    stream = ST.table_stream(spark, sf, "documents.parquet", schema).select(
        "doc_id", F.concat_ws("/", "source", d.cast("string")).alias("path"), F.col("n_chars").alias("size"), mtime.alias("mtime"))

    def handle(batch, epoch):
        todo, counts = ST.skip_done(batch, done, outs)
        counts.write.mode("overwrite").parquet(f"{path}/counts/epoch={epoch}")
        todo.write.mode("overwrite").parquet(f"{path}/todo/epoch={epoch}")

    sinks.run_available(stream, f"{path}/_checkpoint", handle)
    out = spark.read.parquet(f"{path}/counts")
    return out.agg(F.sum("files").alias("files"), F.sum("misses").alias("misses"), F.sum("hits").alias("hits"))


@query(
    "eval_limiter",
    """SELECT attempt_id, session_id, reason IS NOT NULL AS skip, reason, greatest(30.0e0, 300 - total_time) AS time_cap_s FROM (SELECT *, CASE WHEN bool_or(consecutive_failures >= 2) OVER (PARTITION BY session_id ORDER BY ts, attempt_id) THEN 'expensive_evaluations_disabled'
      WHEN attempt_no >= 3 THEN 'max_attempts_reached' WHEN consecutive_failures >= 2 THEN 'consecutive_failures' WHEN total_time >= 300 THEN 'time_budget_exceeded' WHEN recent_failures >= 2 THEN 'recent_failures' END AS reason FROM runs)""",
    "v_attempts", "time_cap_s", runs=RUNS.format(us=60 * 1000000),
)
def _(spark, sf):
    k = F.col("k")
    attempts = event_stream(spark, sf).select(
        F.col("event_id").alias("attempt_id"), F.col("user_id").alias("session_id"), (F.unix_micros("ts") / 1e6).alias("ts_s"),
        pick(k, "SUCCESS", "FAILURE", "TIMEOUT", "SUCCESS").alias("result"), F.col("value").alias("duration"),
    )
    return run(spark, ST.limiter(attempts), "limiter")


def op_stream(spark, sf):
    e = event_stream(spark, sf)
    return e.select(
        F.col("event_id").alias("op_id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("op_name"), "ts",
        F.col("value").alias("duration"), (F.col("k") % 5 != 0).alias("success"),
    )


@query(
    "session_fold",
    """SELECT session_id, count(*) AS operations, count(*) FILTER (success) AS succeeded, sum(duration) AS busy_s, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (contains(op_name, 'cache')) AS cache_lookups, CAST(min(ts) AS DATE) AS session_date, bool_or(op_name = 'purchase') AS ended
    FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 6 HOUR OR prev_op = 'purchase' OR op_name = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, op_id) AS g
      FROM (SELECT *, lag(ts) OVER w AS prev, lag(op_name) OVER w AS prev_op FROM v_ops WINDOW w AS (PARTITION BY session_id ORDER BY ts, op_id))) GROUP BY session_id, g""",
    "v_ops", "busy_s",
)
def _(spark, sf):
    path = scratch(spark, "sessions")
    handle = ST.session_folder(path, F.col("op_name") == "signup", F.col("op_name") == "purchase", gap_s=6 * 3600)
    sinks.run_available(op_stream(spark, sf), f"{path}/_checkpoint", handle)
    return ST.folded_sessions(spark, path)


@query(
    "live_op_stats",
    """SELECT *, avg_duration > 30 AS slow, success_rate < 80 AS failing FROM (SELECT date_trunc('hour', ts) AS window_start, op_name, count(*) AS n, 100.0e0 * count(*) FILTER (success) / count(*) AS success_rate, avg(duration) AS avg_duration, max(duration) AS max_duration, sum(duration) AS total_duration FROM v_ops GROUP BY 1, 2)""",
    "v_ops", "success_rate avg_duration max_duration total_duration", 9,
)
def _(spark, sf):
    return run_keyed(spark, ST.live_op_stats(op_stream(spark, sf)), "live", ["window_start", "op_name"])


@query(
    "recent_failures",
    """SELECT session_id, window_start, count(*) AS failures FROM (SELECT session_id, unnest([time_bucket(INTERVAL 10 SECOND, ts) - to_seconds(10 * i) FOR i IN range(0, 6)]) AS window_start FROM v_attempts WHERE result = 'FAILURE') GROUP BY 1, 2""",
    "v_attempts",
)
def _(spark, sf):
    k = F.col("k")
    attempts = event_stream(spark, sf).select(F.col("user_id").alias("session_id"), "ts", pick(k, "SUCCESS", "FAILURE", "TIMEOUT", "SUCCESS").alias("result"))
    return run_keyed(spark, ST.recent_failures(attempts), "failures", ["session_id", "window_start"])


@query(
    "recent_events",
    """SELECT metric, CAST(sum(amount) AS BIGINT) AS total, list(context || ':' || seq ORDER BY seq)[-20:] AS recent FROM tracked GROUP BY metric""",
    "v_events", tracked=TRACKED,
)
def _(spark, sf):
    e = event_stream(spark, sf)
    events = e.select(
        pick(F.col("k"), *METRICS).alias("metric"), F.col("event_id").alias("seq"), (F.col("k") % 4).alias("amount"),
        F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("label"),
    )
    path = scratch(spark, "recent")
    sinks.run_available(events, f"{path}-checkpoint", ST.recent_folder(path))
    return ST.recent_events(spark, path).select("metric", "total", F.reverse(F.transform("recent", lambda r: r["label"])).alias("recent"))


@query(
    "quarantine",
    """SELECT name, count(*) AS files, min(n) AS first_no, max(n) AS last_no FROM (SELECT 'clip' || k || '.mp4' AS name, row_number() OVER (PARTITION BY k ORDER BY event_id) - 1 + k % 3 AS n FROM v_events WHERE k % 5 = 0) GROUP BY name""",
    "v_events",
)
def _(spark, sf):
    path = scratch(spark, "quarantine")
    e = event_stream(spark, sf).select(
        F.concat(F.lit("in/"), F.col("event_id").cast("string"), F.lit(".mp4")).alias("path"), F.lit("failures").alias("folder"),
        F.concat(F.lit("clip"), F.col("k").cast("string"), F.lit(".mp4")).alias("name"), (F.col("k") % 5 != 0).alias("ok"),
    )
    taken = V._events(spark, sf).where("k % 5 = 0").select(
        F.lit("failures").alias("folder"), F.concat(F.lit("clip"), F.col("k").cast("string"), F.lit(".mp4")).alias("name"), (F.col("k") % 3).alias("taken")).distinct()

    def handle(batch, epoch):
        good, bad = ST.status_split(batch, F.col("ok"))
        good.write.mode("overwrite").parquet(f"{path}/done/epoch={epoch}")
        there = spark.read.parquet(f"{path}/taken/epoch={epoch - 1}") if epoch else taken
        ST.quarantine(bad.drop("ok"), there).write.mode("overwrite").parquet(f"{path}/failures/epoch={epoch}")
        ST.names_taken(bad, there).write.mode("overwrite").parquet(f"{path}/taken/epoch={epoch}")

    sinks.run_available(e, f"{path}/_checkpoint", handle)
    out = spark.read.parquet(f"{path}/failures")
    n = F.coalesce(F.nullif(F.regexp_extract("quarantined_name", r"\((\d+)\)", 1), F.lit("")).cast("bigint"), F.lit(0))
    name = F.regexp_replace("quarantined_name", r" \(\d+\)", "")
    return out.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("files"), F.min(n).alias("first_no"), F.max(n).alias("last_no"))


# ------------------------------------------------------------------ jobs


def checked_ratio(row):
    """A job that fails on some rows."""
    if row["asset_id"] % 17 == 0:
        raise ValueError("unreadable input")
    return row["size_bytes"] / 1048576.0 / row["target_mb"]


@query(
    "apply_job",
    f"""SELECT asset_id, asset_id % 17 <> 0 AS ok, CASE WHEN asset_id % 17 = 0 THEN 'ValueError: unreadable input' END AS error, CASE WHEN asset_id % 17 <> 0 THEN size_bytes / {MIB} / target_mb END AS result FROM v_assets""",
    "v_assets", "result",
)
def _(spark, sf):
    a = V.v_assets(spark, sf).select("asset_id", "size_bytes", "target_mb")
    return jobs.apply_job(a, checked_ratio, "double", ["asset_id"])


SR = "size_bytes / 1048576.0e0 / target_mb"


@query(
    "strategy_registry",
    f"""SELECT asset_id, 'quality' AS strategy, greatest(360, CAST(floor(width * CASE WHEN {SR} > 1.5e0 THEN 0.85e0 WHEN {SR} > 1.2e0 THEN 0.92e0 ELSE 0.96e0 END) AS BIGINT)) AS out_width, CASE WHEN {SR} > 1.5e0 THEN greatest(15, CAST(floor(fps * 0.9e0) AS BIGINT)) WHEN {SR} > 1.2e0 THEN greatest(15, CAST(floor(fps * 0.95e0) AS BIGINT)) ELSE CAST(fps AS BIGINT) END AS out_fps, 40 AS out_lossy FROM v_assets
    UNION ALL SELECT asset_id, 'size', CASE WHEN {SR} > 2 THEN 360 ELSE greatest(360, CAST(floor(width * CASE WHEN {SR} > 1.5e0 THEN 0.75e0 ELSE 0.85e0 END) AS BIGINT)) END, CASE WHEN {SR} > 2 THEN 15 ELSE greatest(15, CAST(floor(fps * CASE WHEN {SR} > 1.5e0 THEN 0.8e0 ELSE 0.85e0 END) AS BIGINT)) END, CASE WHEN {SR} > 2 THEN 120 WHEN {SR} > 1.5e0 THEN 100 ELSE 80 END FROM v_assets
    UNION ALL SELECT asset_id, 'balanced', greatest(360, CAST(floor(width * CASE WHEN {SR} > 1.5e0 THEN 0.88e0 WHEN {SR} > 1.2e0 THEN 0.92e0 ELSE 0.96e0 END) AS BIGINT)), CASE WHEN {SR} > 1.5e0 THEN greatest(15, CAST(floor(fps * 0.9e0) AS BIGINT)) WHEN {SR} > 1.2e0 THEN greatest(15, CAST(floor(fps * 0.95e0) AS BIGINT)) ELSE CAST(fps AS BIGINT) END, CASE WHEN {SR} > 1.5e0 THEN 60 WHEN {SR} > 1.2e0 THEN 40 ELSE 20 END FROM v_assets
    UNION ALL SELECT asset_id, 'adaptive', greatest(360, CAST(floor(width * CASE WHEN {SR} > 1.5e0 THEN 0.85e0 WHEN {SR} > 1.2e0 THEN 0.92e0 ELSE 0.96e0 END) AS BIGINT)), greatest(15, CAST(floor(fps * CASE {LEVEL} WHEN 'low' THEN 0.85e0 WHEN 'high' THEN 0.95e0 ELSE 0.9e0 END * CASE WHEN {SR} > 1.5e0 THEN 0.9e0 ELSE 1.0e0 END) AS BIGINT)), CASE WHEN {SR} > 1.5e0 THEN 60 WHEN {SR} > 1.2e0 THEN 40 ELSE 20 END FROM v_assets""",
    "v_assets",
)
def _(spark, sf):
    a = V.v_assets(spark, sf).withColumns({
        "size_mb": F.col("size_bytes") / S.MIB, "colors": F.lit(240), "lossy": F.lit(60), "motion_level": S.motion_level(F.col("fps")), "complexity_level": F.lit("medium"),
    })
    parts = [
        a.transform(G.get_strategy(n)).select("asset_id", F.lit(n).alias("strategy"), "out_width", "out_fps", F.col("out_lossy").cast("int").alias("out_lossy"))
        for n in ("quality", "size", "balanced", "adaptive")
    ]
    return R.all_samples(*parts)


@query(
    "pattern_config",
    r"""SELECT log_id, TRY_CAST(nullif(regexp_extract(vmaf_text, ':([\d.]+)', 1), '') AS DOUBLE) AS vmaf FROM v_eval_logs""",
    "v_eval_logs", "vmaf",
)
def _(spark, sf):
    logs = V.v_eval_logs(spark, sf).select("log_id", F.regexp_replace("vmaf_text", r'^.*:([\d.]+).*$', "final quality = $1 points").alias("text"))
    return L.vmaf_scores(logs, patterns=(r"final quality = ([\d.]+)",)).select("log_id", "vmaf")


@query(
    "best_of",
    """SELECT job_id, step, variant, score FROM (SELECT *, row_number() OVER (PARTITION BY job_id, step ORDER BY score + greatest(0.0e0, 10 - secs / 60) * 0.1e0 DESC, variant) AS r FROM (
      SELECT job_id, step, 0 AS variant, vmaf AS score, size_mb * 60 AS secs FROM v_encodes UNION ALL SELECT job_id, step, 1, 70 + size_mb, 20 FROM v_encodes)) WHERE r = 1""",
    "v_encodes", "score",
)
def _(spark, sf):
    e = V.v_encodes(spark, sf)
    full = e.select("job_id", "step", F.col("vmaf").alias("score"), (F.col("size_mb") * 60).alias("secs"))
    fast = e.select("job_id", "step", (F.col("size_mb") + 70).alias("score"), F.lit(20.0).alias("secs"))
    return R.best_of([full, fast], ["job_id", "step"], "score", "secs").select("job_id", "step", "variant", "score")


@query(
    "memoise",
    """SELECT request_id, cache_key, hit, CASE WHEN hit THEN data_size ELSE length(cache_key) * 1.0e0 END AS value FROM (SELECT r.request_id, r.cache_key, c.cache_key IS NOT NULL AS hit, c.data_size FROM (
      SELECT o_orderkey AS request_id, md5(CAST(o_orderkey AS VARCHAR) || '_' || CAST(o_custkey % 6 + 1 AS VARCHAR)) AS cache_key FROM orders) r
      LEFT JOIN (SELECT * FROM v_cache WHERE expires_at IS NULL OR expires_at > TIMESTAMP '1999-01-01 00:00:00') c USING (cache_key))""",
    "v_cache", "value",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    key = F.md5(F.concat_ws("_", F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 6 + 1).cast("string")))
    requests = o.select(F.col("o_orderkey").alias("request_id"), key.alias("cache_key"))
    cache = V.v_cache(spark, sf).select("cache_key", F.col("data_size").alias("value"), "created_at", "expires_at")
    job = lambda missing: missing.withColumn("value", F.length("cache_key") * 1.0)
    results, _table = jobs.memoised(requests, cache, job, F.to_timestamp(F.lit("1999-01-01 00:00:00")))
    return results.select("request_id", "cache_key", "hit", "value")
