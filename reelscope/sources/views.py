"""Give the benchmark tables the shape of media tables.

Each ``v_*`` function is a lazy projection over one or two base tables; nothing is
synthesised, so every query's work grows with the tables it is pointed at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelscope.operators import blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by key over all cores, for work that is heavy for the bytes it reads: a small file is few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def pick(index, *values):
    """``values[index % len(values)]`` as a Column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def v_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    base = table(spark, sf_dir, "part").select(
        key.alias("asset_id"),
        pick(size, 3840, 1920, 1280, 854).alias("width"),
        pick(size, 2160, 1080, 720, 480).alias("height"),
        pick(size, 24.0, 30.0, 60.0).alias("fps"),
        (F.col("p_retailprice") / 10).alias("duration_s"),
        (size.cast("bigint") * 100000).alias("bitrate"),
        pick(size, "h264", "hevc", "vp9").alias("codec"),
        (size % 11).cast("double").alias("complexity"),
        (key % 11).cast("double").alias("motion"),
        pick(key, "live_action", "animation", "gaming", "screen_recording", "mixed").alias("content_type"),
        pick(key, 32, 64, 128, 192, 256).alias("audio_kbps"),
        pick(size, 4.0, 8.0, 10.0, 25.0).alias("target_mb"),
        F.col("p_name").alias("path"),
    )
    return base.withColumn("size_bytes", F.floor(F.col("bitrate") * F.col("duration_s") / 8))


STEP_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def with_step(lines: DataFrame) -> DataFrame:
    """Number the lines of an order."""
    return blocks.carried(lines, ["l_orderkey"], STEP_ORDER, number="step")


def v_encodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    return with_step(table(spark, sf_dir, "lineitem")).select(
        F.col("l_orderkey").alias("job_id"),
        F.col("step").cast("bigint").alias("step"),
        F.col("l_partkey").alias("asset_id"),
        F.floor(F.col("l_extendedprice") / 20).alias("bitrate_kbps"),
        (line + 18).alias("crf"),
        pick(line, "libx264", "libx265", "h264_nvenc", "h264_amf", "h264_qsv", "h264_videotoolbox").alias("encoder"),
        F.when(F.col("l_returnflag") == "A", "fast").when(F.col("l_returnflag") == "N", "medium")
        .otherwise("slow").alias("preset"),
        (F.col("l_extendedprice") / 5000).alias("size_mb"),
        F.when(line != 7, F.col("l_quantity") + 50).alias("vmaf"),
        (F.col("l_discount") * 1.4 + 0.85).alias("ssim"),
        F.col("l_tax").alias("tax"),
        F.col("l_shipdate").alias("ts"),
    )


def v_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("platform"),
        F.col("o_orderdate").alias("start_ts"),
        (F.col("o_totalprice") / 1000).alias("duration"),
        F.lit(10.0).alias("target_mb"),
        (F.col("o_totalprice") / 30000).alias("final_mb"),
        (F.col("o_orderstatus") != "P").alias("success"),
        (F.col("o_orderkey") % 100).cast("double").alias("quality"),
        F.col("o_custkey").alias("owner"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def v_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("op_id"),
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("op_name"),
        "ts",
        F.col("value").alias("duration"),
        (F.col("k") % 5 != 0).alias("success"),
        F.when(F.col("k") >= 10, F.col("value") * 10 - 200).alias("memory_delta"),
    )


def v_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("attempt_id"),
        F.col("user_id").alias("session_id"),
        "ts",
        pick(k, "vmaf", "ssim", "combined").alias("eval_type"),
        pick(k, "SUCCESS", "FAILURE", "TIMEOUT", "SUCCESS").alias("result"),
        F.col("value").alias("duration"),
        (k / 100.0).alias("confidence"),
    )


def v_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixel = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5))).cast("int")
    numbered = blocks.carried(
        table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"], number="n"
    )
    return (
        numbered.select(
            F.col("label").cast("bigint").alias("video_id"),
            (F.col("n") - 1).cast("bigint").alias("frame_idx"),
            F.transform("embedding", pixel).alias("pixels"),
            F.lit(8).alias("w"),
            F.lit(8).alias("h"),
        )
        .withColumn("ts_s", F.col("frame_idx") * 0.2)
    )


def v_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("point_id"),
        F.col("user_id").alias("video_id"),
        F.unix_timestamp("ts").cast("double").alias("ts_s"),
        (F.col("k") / 100.0).alias("complexity"),
        (F.col("k") * 7 % 100 / 100.0).alias("motion"),
        (F.col("k") % 4 == 0).alias("is_keyframe"),
    )


def v_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = with_step(table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "step",
        "l_extendedprice", "l_shipdate", "l_returnflag", "l_linenumber",
    )
    # Orders grow with the lines, but their keys pack so well that Spark takes them for small and would broadcast them all through the driver.
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").hint("merge")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        F.md5(F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("step").cast("string"))).alias("cache_key"),
        F.col("l_extendedprice").alias("data_size"),
        F.col("l_shipdate").alias("last_accessed"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("l_returnflag") != "N", F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
        F.col("l_linenumber").cast("bigint").alias("access_count"),
    )


def v_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        "doc_id", "source", "lang",
        F.col("n_chars").alias("size"),
        F.sha2("text", 256).alias("content_hash"),
    )


ERROR_MESSAGES = (
    "Bitrate floor constraint violated", "Segmentation failed for clip", "FFmpeg encoder crashed",
    "Operation timed out", "Out of memory", "Permission denied on output", "Connection reset",
    "Corrupt header", "Something else happened",
)


def v_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        pick(F.col("k"), *ERROR_MESSAGES).alias("message"),
        F.concat(F.lit("in/"), F.col("event_id").cast("string"), F.lit(".mp4")).alias("path"),
    )


def v_eval_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluator log per job: SSIM lines in step order, then a VMAF JSON line."""
    enc = v_encodes(spark, sf_dir)
    line = F.concat(
        F.lit("n:"), F.col("step").cast("string"), F.lit(" Y:"), F.format_string("%.4f", F.col("ssim")),
        F.lit(" All:"), F.format_string("%.4f", F.col("ssim") - 0.01), F.lit(" (20.00)"),
    )
    return (
        enc.groupBy("job_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("step", line.alias("line")))).alias("ls"),
            F.max("vmaf").alias("top"),
        )
        .select(
            F.col("job_id").alias("log_id"),
            F.concat_ws("\n", F.transform("ls", lambda x: x["line"])).alias("ssim_text"),
            F.when(
                F.col("top").isNotNull(), F.concat(F.lit('{"vmaf":{"mean":'), F.format_string("%.2f", F.col("top")), F.lit("}}"))
            ).otherwise("").alias("vmaf_text"),
        )
    )
