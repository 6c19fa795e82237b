"""Streaming operators: watch folders, stability, skip lists, limiters, session folding, live statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from reelscope.functions import constants as K
from reelscope.operators import blocks as B, joins as J
from reelscope.session import ROCKSDB_PROVIDER, STATE_STORE_KEY
from reelscope.sources import files
from reelscope.streaming import processors as P, sinks

LATE = "10 minutes"
BINARY_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])


def need_rocksdb(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB store; set only where the session did not choose one."""
    if "RocksDB" not in spark.conf.get(STATE_STORE_KEY, ""):
        spark.conf.set(STATE_STORE_KEY, ROCKSDB_PROVIDER)


def watch(spark: SparkSession, root: str, max_files: int = 100, extensions=(*K.VIDEO_EXTENSIONS, ".gif")) -> DataFrame:
    """Each new media file once, newest first, at most ``max_files`` per trigger; contents are not read."""
    return (
        spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", files.glob_for(extensions)).option("latestFirst", "true").option("maxFilesPerTrigger", max_files)
        .load(root).select("path", "length", "modificationTime")
    )


def table_stream(spark: SparkSession, folder: str, name: str, schema, max_files: int = 1000) -> DataFrame:
    """A Parquet table as a stream, whether it is one file of that name or a folder of part files."""
    parts = spark.read.schema(schema).parquet(f"{folder}/{name}").inputFiles()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if [p.rpartition("/")[2] for p in parts] == [name]:
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(f"{folder}/{name}")


def stable(looks: DataFrame, min_age_s: float = 10.0) -> DataFrame:
    """Looks (path, size, mtime_s, look_s) to accepted files."""
    need_rocksdb(looks.sparkSession)
    return looks.groupBy("path").transformWithStateInPandas(
        statefulProcessor=P.StableFiles(min_age_s), outputStructType="path string, size long, mtime_s double, accepted_at_s double",
        outputMode="Append", timeMode="None",
    )


def skip_done(batch: DataFrame, processed: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files still to do, one row of cache hits and misses) for a micro-batch."""
    todo = J.unprocessed(batch, processed, outputs)
    misses = todo.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = batch.agg(F.count(F.lit(1)).alias("files")).withColumn("misses", misses).withColumn("hits", F.col("files") - F.col("misses"))
    return todo, counts


def first_seen(stream: DataFrame, keys: list[str], ts: str, delay: str = LATE) -> DataFrame:
    """Repeats of a key inside the watermark are dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def limiter(attempts: DataFrame, **limits) -> DataFrame:
    """Attempts (attempt_id, session_id, ts_s, result, duration) to a decision after each."""
    need_rocksdb(attempts.sparkSession)
    return attempts.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=P.EvalLimiter(**limits),
        outputStructType="attempt_id long, session_id long, skip boolean, reason string, time_cap_s double", outputMode="Append", timeMode="None",
    )


def ring(events: DataFrame, keep: int = 20) -> DataFrame:
    """Events (metric, seq, label, amount) to a running counter and the last ``keep`` labels per metric, as keyed state.

    A metric goes through one task; ``recent_folder`` deals a busy one over pieces.
    """
    need_rocksdb(events.sparkSession)
    return events.groupBy("metric").transformWithStateInPandas(
        statefulProcessor=P.RecentEvents(keep), outputStructType="metric string, total long, recent array<string>", outputMode="Update", timeMode="None",
    )


RECENT = "metric string, total long, recent array<struct<seq:long,label:string>>"


def recent_folder(path: str, keep: int = 20, salts: int = 32):
    """Batch handler: events (metric, seq, label, amount) to a running total and the last ``keep`` labels per metric, in ``path``.

    Amounts below 0 and null count as 0.  A metric may hold most of the stream: sums are merged before the shuffle, and the last events are taken among (metric, piece)
    first, so what meets in one task is ``salts`` times ``keep`` rows.  An epoch writes the metrics it has seen, from the newest
    rows of the epochs before it, so an epoch that is run again gives the same rows.
    """
    newest = lambda *by: F.row_number().over(Window.partitionBy("metric", *by).orderBy(F.desc_nulls_last("seq"), F.desc_nulls_last("label")))

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        dealt = batch.withColumn("_piece", F.pmod(F.xxhash64("seq", "label"), F.lit(salts)))
        some = dealt.withColumn("_n", newest("_piece")).where(F.col("_n") <= keep)
        last = some.withColumn("_n", newest()).where(F.col("_n") <= keep).groupBy("metric").agg(F.collect_list(F.struct("seq", "label")).alias("recent"))
        seen = batch.groupBy("metric").agg(F.coalesce(F.sum(F.greatest("amount", F.lit(0))), F.lit(0)).cast("long").alias("total")).join(last.withColumnRenamed("metric", "_m"), F.col("metric").eqNullSafe(F.col("_m"))).drop("_m")
        if epoch > 0:
            old = recent_events(spark, path, before=epoch)
            old = old.select(F.col("metric").alias("_m"), F.col("total").alias("_total"), F.col("recent").alias("_recent"))
            seen = seen.join(old, F.col("metric").eqNullSafe(F.col("_m")), "left")
            both = F.slice(F.sort_array(F.concat("recent", F.coalesce("_recent", F.array())), asc=False), 1, keep)
            seen = seen.select("metric", (F.col("total") + F.coalesce("_total", F.lit(0))).alias("total"), both.alias("recent"))
        sinks.epoch_writer(path)(seen.withColumn("recent", F.sort_array("recent", asc=False)), epoch)

    return handle


def recent_events(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(metric, total, recent: newest first) as of the last epoch, or as of the epochs before one."""
    rows = spark.read.schema(f"{RECENT}, {sinks.EPOCH} long").option("basePath", path).parquet(f"{path}/{sinks.EPOCH}=*")
    if before is not None:
        rows = rows.where(F.col(sinks.EPOCH) < before)
    last = rows.groupBy("metric").agg(F.max_by(F.struct("total", "recent"), sinks.EPOCH).alias("_r"))
    return last.select("metric", "_r.total", "_r.recent")


def _with_watermark(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def fold_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = LATE) -> DataFrame:
    """Operation events to one record per burst of activity of a session."""
    e = _with_watermark(events, "ts", delay)
    out = e.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("operations"), F.count_if("success").alias("succeeded"), F.sum("duration").alias("busy_s"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if(F.lower("op_name").contains("cache")).alias("cache_lookups"),
    )
    return out.select(
        "session_id", "operations", "succeeded", "busy_s", "first_ts", "last_ts", "cache_lookups", F.to_date("first_ts").alias("session_date")
    )


SPAN = ("operations", "succeeded", "busy_s", "cache_lookups")


def session_spans(events: DataFrame, gap_s: int, starts: Column, ends: Column) -> DataFrame:
    """Events to one row per (session_id, part, slot): what one slot of a session's time holds.

    ``part`` counts the starts up to a row and the ends before it, so it changes exactly where one session
    gives way to the next.  Two events in one slot of ``gap_s`` seconds are never a gap apart, so the sums
    are merged before the shuffle and a busy session shrinks to its slots.
    """
    turns = events.withColumns({"_end": F.coalesce(ends, F.lit(False)), "_start": F.coalesce(starts, F.lit(False))})
    turns = turns.withColumn("_turn", F.col("_start").cast("bigint") + F.col("_end").cast("bigint"))
    tagged = B.carried(turns, ["session_id"], ["ts", "op_id"], sums={"_turns": F.col("_turn")})
    part = F.col("_turns") - F.col("_end").cast("bigint")
    slot = F.floor(F.unix_micros("ts") / (gap_s * 1_000_000))
    return tagged.groupBy("session_id", part.alias("part"), slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("operations"), F.count_if("success").alias("succeeded"), F.sum("duration").alias("busy_s"),
        F.count_if(F.lower("op_name").contains("cache")).alias("cache_lookups"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.bool_or("_end").alias("ended"),
    ).drop("slot")


def merge_spans(spans: DataFrame, gap_s: int) -> DataFrame:
    """Spans of one session and part that are less than ``gap_s`` seconds apart become one session."""
    reach = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6 + gap_s
    window = F.session_window("first_ts", F.make_interval(secs=reach.cast("decimal(18,6)")))
    out = spans.groupBy("session_id", "part", window.alias("w")).agg(
        *[F.sum(c).alias(c) for c in SPAN], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.bool_or("ended").alias("ended"))
    return out.drop("w")


def session_folder(path: str, starts: Column, ends: Column, gap_s: int = 1800, delay_s: int = 600):
    """Handler of one micro-batch of operation events (op_id, session_id, op_name, ts, duration, success).

    A session closes by an end event, by the next start event, or when ``gap_s`` has passed without an event
    by the watermark.  Each epoch writes its sessions to ``path/spans``; the open ones are read by the next
    epoch, so only they are kept as state, and a replayed epoch overwrites itself.  Rows older than the
    watermark of the epochs before go to ``path/late``; rows without a time or id count as late.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        mark = batch.agg(F.max("ts").alias("newest"))
        before = spark.read.parquet(f"{path}/mark/epoch={epoch - 1}") if epoch else mark.where("false")
        mark.unionByName(before).agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{path}/mark/epoch={epoch}")
        now = spark.read.parquet(f"{path}/mark/epoch={epoch}").select("newest").scalar()
        usable = F.col("ts").isNotNull() & F.col("session_id").isNotNull()
        ok, late = sinks.split_late(batch, "ts", before.agg(F.max("newest")).scalar(), delay_s)
        late.where(usable).unionByName(batch.where(~usable)).write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
        spans = session_spans(ok.where(usable), gap_s, starts, ends)
        if epoch:
            held = spark.read.parquet(f"{path}/spans/epoch={epoch - 1}").where("NOT closed")
            spans = spans.unionByName(held.withColumn("part", F.lit(0).cast("bigint")).select(spans.columns))
        merged = merge_spans(spans, gap_s)
        last = spans.groupBy("session_id").agg(F.max("part").alias("_last"))
        over = F.unix_micros("last_ts") + (gap_s + delay_s) * 1_000_000 <= F.unix_micros(now)
        closed = F.col("ended") | (F.col("part") < F.col("_last")) | over
        merged.join(last, "session_id").withColumn("closed", closed).drop("_last").write.mode("overwrite").parquet(f"{path}/spans/epoch={epoch}")

    return handle


def folded_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The sessions behind ``session_folder``: closed ones of every epoch, and those open after the newest."""
    rows = spark.read.option("basePath", f"{path}/spans").parquet(f"{path}/spans")
    newest = rows.agg(F.max(sinks.EPOCH)).scalar()
    return rows.where(F.col("closed") | (F.col(sinks.EPOCH) == newest)).select(
        "session_id", "operations", "succeeded", "busy_s", "first_ts", "last_ts", "cache_lookups", F.to_date("first_ts").alias("session_date"), "ended"
    )


def live_op_stats(ops: DataFrame, window: str = "1 hour", delay: str = LATE, slow_s: float = 30.0) -> DataFrame:
    """Operation statistics per tumbling window with slow and failing flags."""
    e = _with_watermark(ops, "ts", delay)
    n = F.count(F.lit(1))
    out = e.groupBy(F.window("ts", window).alias("w"), "op_name").agg(
        n.alias("n"), (F.count_if("success") * 100.0 / n).alias("success_rate"), F.avg("duration").alias("avg_duration"),
        F.max("duration").alias("max_duration"), F.sum("duration").alias("total_duration"),
    )
    return out.select(
        F.col("w.start").alias("window_start"), "op_name", "n", "success_rate", "avg_duration", "max_duration", "total_duration",
        (F.col("avg_duration") > slow_s).alias("slow"), (F.col("success_rate") < 80).alias("failing"),
    )


def recent_failures(attempts: DataFrame, length: str = "60 seconds", slide: str = "10 seconds", delay: str = LATE) -> DataFrame:
    """Failures per session in sliding windows."""
    e = _with_watermark(attempts.where("result = 'FAILURE'"), "ts", delay)
    out = e.groupBy("session_id", F.window("ts", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("failures"))
    return out.select("session_id", F.col("w.start").alias("window_start"), "failures")


def quarantine(failed: DataFrame, existing: DataFrame, buckets: int = 64) -> DataFrame:
    """Target names for failed inputs: ``name``, ``name (1)``, ``name (2)`` ... continuing after names already there.

    Failed: path, folder, name.  Existing: folder, name, taken (how many copies of that name are there).
    Numbering is cut by hash bucket, so one name shared by very many files is numbered in parallel.
    """
    spread = F.pmod(F.xxhash64("path"), F.lit(buckets))
    tagged = failed.withColumn("_h", spread)
    numbered = B.carried(tagged, ["folder", "name"], ["_h", "path"], number="_n").drop("_h")
    j = numbered.join(existing.select("folder", "name", "taken"), ["folder", "name"], "left")
    n = F.col("_n") - 1 + F.coalesce("taken", F.lit(0))
    stem, ext = F.regexp_replace("name", r"(.)\.[^.]*$", "$1"), F.regexp_extract("name", r".(\.[^.]*)$", 1)
    target = F.when(n == 0, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext))
    return j.select("path", "folder", target.alias("quarantined_name"))


def names_taken(failed: DataFrame, existing: DataFrame) -> DataFrame:
    """The ``existing`` table of ``quarantine`` once ``failed`` has been moved too; the next epoch numbers on from it."""
    more = failed.groupBy("folder", "name").agg(F.count(F.lit(1)).alias("taken"))
    both = existing.select("folder", "name", F.col("taken").cast("bigint").alias("taken")).unionByName(more)
    return both.groupBy("folder", "name").agg(F.sum("taken").alias("taken"))


def status_split(batch: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    return batch.where(ok), batch.where(~F.coalesce(ok, F.lit(False)))
