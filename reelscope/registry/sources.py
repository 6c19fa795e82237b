"""Queries for sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelscope.functions import logs as L, scalars as S
from reelscope.registry.aggregates import SSIM_SQL
from reelscope.registry.base import query
from reelscope.session import shared_folder
from reelscope.sources import dims, files, stores, views as V


def scratch(spark, name: str) -> str:
    """A new folder per run in the cluster's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_media")
def _(spark, sf):
    return files.scan_media(spark, sf, extensions=(".parquet",))


PROBE = """'{"streams":[{"codec_type":"audio","codec_name":"aac","channels":2,"sample_rate":"48000","bit_rate":"' || audio_kbps || '000"},' ||
  CASE WHEN asset_id % 13 = 0 THEN '{"codec_type":"data"}' ELSE '{"codec_type":"video","codec_name":"' || codec || '","width":' || width || ',"height":' || height || ',"r_frame_rate":"' || CAST(CAST(fps AS BIGINT) AS VARCHAR) || '000/1001","nb_frames":"' || (asset_id % 3) * 100 || '","pix_fmt":"yuv420p"}' END ||
  '],"format":{"duration":"' || CAST(duration_s AS VARCHAR) || '","bit_rate":"' || bitrate || '","size":"' || size_bytes || '","format_name":"mp4"}}'"""


@query(
    "probe_parse",
    """SELECT asset_id, v, CASE WHEN v THEN width ELSE 0 END AS width, CASE WHEN v THEN height ELSE 0 END AS height, CASE WHEN v THEN rate ELSE 30.0e0 END AS fps,
      duration_s, bitrate // 1000 AS bitrate_kbps, size_bytes / 1048576.0e0 AS size_mb, CASE WHEN v THEN codec ELSE 'unknown' END AS codec,
      CASE WHEN v AND asset_id % 3 > 0 THEN (asset_id % 3) * 100 ELSE CAST(floor(duration_s * CASE WHEN v THEN rate ELSE 30.0e0 END) AS BIGINT) END AS frame_count, 'aac' AS audio_codec, CAST(audio_kbps AS BIGINT) AS audio_kbps
    FROM (SELECT *, asset_id % 13 <> 0 AS v, fps * 1000 / 1001 AS rate FROM (SELECT * REPLACE (CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height) FROM v_assets))""",
    "v_assets", "fps duration_s size_mb",
)
def _(spark, sf):
    c = F.col
    s = lambda x: c(x).cast("string")
    audio = F.concat(F.lit('{"streams":[{"codec_type":"audio","codec_name":"aac","channels":2,"sample_rate":"48000","bit_rate":"'), s("audio_kbps"), F.lit('000"},'))
    video = F.concat(
        F.lit('{"codec_type":"video","codec_name":"'), c("codec"), F.lit('","width":'), s("width"), F.lit(',"height":'), s("height"),
        F.lit(',"r_frame_rate":"'), c("fps").cast("bigint").cast("string"), F.lit('000/1001","nb_frames":"'),
        (c("asset_id") % 3 * 100).cast("string"), F.lit('","pix_fmt":"yuv420p"}'),
    )
    fmt = F.concat(F.lit('],"format":{"duration":"'), s("duration_s"), F.lit('","bit_rate":"'), s("bitrate"), F.lit('","size":"'), s("size_bytes"), F.lit('","format_name":"mp4"}}'))
    text = F.concat(audio, F.when(c("asset_id") % 13 == 0, F.lit('{"codec_type":"data"}')).otherwise(video), fmt)
    parsed = files.parse_probe(V.v_assets(spark, sf).select("asset_id", text.alias("probe_json")))
    return parsed.select("asset_id", c("probe_ok").alias("v"), "width", "height", "fps", "duration_s", "bitrate_kbps", "size_mb", "codec",
                         "frame_count", "audio_codec", "audio_kbps")


@query(
    "session_log",
    """SELECT session_id, start_ts, duration, success FROM v_sessions WHERE CAST(start_ts AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'""",
    "v_sessions", "duration",
)
def _(spark, sf):
    path = scratch(spark, "sessions")
    sessions = V.v_sessions(spark, sf).select("session_id", "start_ts", "duration", "success")
    stores.write_sessions(sessions, path)
    schema = "session_id bigint, start_ts timestamp, duration double, success boolean, session_date date"
    return stores.read_sessions(spark, path, schema, "1997-01-01", "1997-06-30").drop("session_date")


@query(
    "cache_upsert",
    """SELECT key, arg_max(value, rank) AS value, arg_max(ts, rank) AS ts FROM (
      SELECT asset_id AS key, bitrate_kbps AS value, ts, (epoch(ts), side, bitrate_kbps) AS rank
      FROM (SELECT *, CASE WHEN crf < 22 THEN 0 ELSE 1 END AS side FROM v_encodes)) GROUP BY key""",
    "v_encodes",
)
def _(spark, sf):
    e = V.v_encodes(spark, sf).select(F.col("asset_id").alias("key"), F.col("bitrate_kbps").alias("value"), "ts", "crf")
    return stores.upsert(e.where("crf < 22").drop("crf"), e.where("crf >= 22").drop("crf"), ["key"], ["ts"])


SEGMENTS = """SELECT job_id AS folder, CASE WHEN crf % 2 = 0 THEN 'gif' ELSE 'mp4' END AS media_type, size_mb, CASE WHEN crf = 19 THEN 0.0e0 ELSE vmaf END AS duration_s, bitrate_kbps AS frames FROM v_encodes"""


@query(
    "segment_summary",
    """SELECT folder, CASE WHEN grouping(media_type) = 1 THEN 'all' ELSE media_type END AS media_type, count(*) AS files, sum(size_mb) AS size_mb, sum(duration_s) AS duration_s, CAST(sum(frames) AS BIGINT) AS frames,
      sum(size_mb) / count(*) AS avg_size_mb, sum(duration_s) / count(*) AS avg_duration_s, CASE WHEN sum(duration_s) > 0 THEN sum(frames) / sum(duration_s) ELSE 0.0e0 END AS avg_fps
    FROM segs GROUP BY GROUPING SETS ((folder, media_type), (folder))""",
    "v_encodes", "size_mb duration_s avg_size_mb avg_duration_s avg_fps", 9, segs=SEGMENTS,
)
def _(spark, sf):
    segs = V.v_encodes(spark, sf).select(
        F.col("job_id").alias("folder"), F.when(F.col("crf") % 2 == 0, "gif").otherwise("mp4").alias("media_type"), "size_mb",
        F.when(F.col("crf") == 19, 0.0).otherwise(F.col("vmaf")).alias("duration_s"), F.col("bitrate_kbps").alias("frames"),
    )
    return stores.segment_summary(segs)


@query("retention", "SELECT op_id, op_name, ts FROM v_ops WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY", "v_ops")
def _(spark, sf):
    ops = V.v_ops(spark, sf).select("op_id", "op_name", "ts")
    return stores.retain(ops, "ts", 7, F.to_timestamp(F.lit("2024-01-31 00:00:00")))


@query(
    "dims_load",
    """SELECT encoder, CAST(CASE encoder WHEN 'libx264' THEN 3 WHEN 'libx265' THEN 15 ELSE 8 END AS INTEGER) AS min_kbps, count(*) AS encodes,
      count(*) FILTER (bitrate_kbps // 400 < CASE encoder WHEN 'libx264' THEN 3 WHEN 'libx265' THEN 15 ELSE 8 END) AS below FROM v_encodes GROUP BY encoder""",
    "v_encodes",
)
def _(spark, sf):
    enc = dims.load_dims(spark, {"encoder_minimums.libx264": 3})["encoders"]
    joined = dims.with_dim(V.v_encodes(spark, sf), enc, "encoder")
    below = S.whole(F.col("bitrate_kbps") / 400) < F.col("min_kbps")
    return joined.groupBy("encoder", "min_kbps").agg(F.count(F.lit(1)).alias("encodes"), F.count_if(below).alias("below"))


@query(
    "eval_log_scan",
    f"""SELECT s.log_id, ssim, ssim_conf, ssim_frames, vmaf, vmaf_format FROM ({SSIM_SQL}) AS s JOIN (
      SELECT log_id, TRY_CAST(nullif(num, '') AS DOUBLE) AS vmaf, CASE WHEN num = '' THEN 'unknown' ELSE 'json' END AS vmaf_format
      FROM (SELECT log_id, regexp_extract(vmaf_text, ':([\\d.]+)', 1) AS num FROM v_eval_logs)) AS v ON s.log_id = v.log_id""",
    "v_eval_logs", "ssim ssim_conf vmaf",
)
def _(spark, sf):
    path = scratch(spark, "logs")
    V.v_eval_logs(spark, sf).select("log_id", F.concat_ws("\n", "ssim_text", "vmaf_text").alias("text")).write.parquet(path)
    scanned = L.vmaf_scores(L.ssim_scores(files.read_stored_logs(spark, path)))
    return scanned.select("log_id", "ssim", "ssim_conf", "ssim_frames", "vmaf", "vmaf_format")
