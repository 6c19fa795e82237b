"""Keyed tables and dated logs: upsert, append by day, pruned read-back, retention, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reelscope.functions import scalars as S

SESSION_DAY = "session_date"


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per key wins; updates win ties.

    An aggregate (not a window): a key repeated in a third of the rows is reduced map-side.
    """
    tagged = base.withColumn("_side", F.lit(0)).unionByName(updates.withColumn("_side", F.lit(1)))
    rest = [c for c in base.columns if c not in keys]
    newest = tagged.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order, "_side", *[c for c in rest if c not in order])).alias("_r")
    )
    return newest.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in base.columns])


def write_sessions(sessions: DataFrame, path: str, max_records: int = 5_000_000) -> None:
    """Append JSON lines, partitioned by day; the rebalance splits a very busy day into several files."""
    dated = sessions.withColumn(SESSION_DAY, F.to_date("start_ts"))
    (
        dated.hint("rebalance", SESSION_DAY)
        .write.mode("append").partitionBy(SESSION_DAY).option("maxRecordsPerFile", max_records).json(path)
    )


def read_sessions(spark: SparkSession, path: str, schema, start: str, end: str) -> DataFrame:
    """Sessions of the days in [start, end]; other days' folders are never listed or opened."""
    dated = spark.read.schema(schema).json(path)
    return dated.where(F.col(SESSION_DAY).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def retain(df: DataFrame, ts: str, days: int, now: Column) -> DataFrame:
    """Rows not older than ``days``; the bound is a plain comparison, so it is pushed to the scan."""
    return df.where(F.col(ts) >= now - F.make_dt_interval(days=F.lit(days)))


def write_retained(df: DataFrame, path: str, ts: str, days: int, now: Column) -> None:
    """Rewrite only the day partitions that still hold rows."""
    kept = retain(df, ts, days, now).withColumn(SESSION_DAY, F.to_date(ts))
    (
        kept.hint("rebalance", SESSION_DAY).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(SESSION_DAY).parquet(path)
    )


def segment_summary(segments: DataFrame) -> DataFrame:
    """Per folder and media type, plus one ``all`` row per folder.

    Needs: folder, media_type, size_mb, duration_s, frames.
    """
    total = segments.rollup("folder", "media_type").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_mb").alias("size_mb"),
        F.sum("duration_s").alias("duration_s"), F.sum("frames").alias("frames"),
        F.grouping("folder").alias("_gf"), F.grouping("media_type").alias("_gt"),
    )
    per = total.where("_gf = 0")
    rate = F.when(F.col("duration_s") > 0, F.col("frames") / F.col("duration_s")).otherwise(0.0)
    return per.select(
        "folder", F.when(F.col("_gt") == 1, "all").otherwise(F.col("media_type")).alias("media_type"),
        "files", "size_mb", "duration_s", "frames",
        (F.col("size_mb") / F.col("files")).alias("avg_size_mb"),
        (F.col("duration_s") / F.col("files")).alias("avg_duration_s"), rate.alias("avg_fps"),
    )


def touch(cache: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Fold lookups into the cache: access_count grows by hits per key and last_accessed moves to now."""
    counts = hits.where("hit").groupBy("cache_key").agg(F.count(F.lit(1)).alias("_n"))
    joined = cache.join(counts, "cache_key", "left")
    return joined.withColumns(
        {
            "access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)),
            "last_accessed": F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last_accessed")),
        }
    ).select(*cache.columns)


__all__ = ["upsert", "write_sessions", "read_sessions", "retain", "write_retained", "segment_summary", "touch", "S"]
