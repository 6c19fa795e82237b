"""Reading media listings, probe output and evaluator logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from reelscope.functions import constants as K, scalars as S


def glob_for(extensions: tuple[str, ...]) -> str:
    """A case-insensitive file glob for the extensions."""
    one = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip("."))
    return "*.{" + ",".join(one(e) for e in extensions) + "}"


def scan_media(
    spark: SparkSession, root: str, max_bytes: int | None = None,
    extensions: tuple[str, ...] = (*K.VIDEO_EXTENSIONS, ".gif"), newest_first: bool = True,
) -> DataFrame:
    """Recursive listing of media files; file content is never read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob_for(extensions))
        .load(root)
        .select("path", "length", "modificationTime")
    )
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return files.orderBy(F.col("modificationTime").desc(), "path") if newest_first else files


_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
PROBE_SCHEMA = T.StructType(
    [
        T.StructField("streams", T.ArrayType(T.StructType(_text(
            "codec_type", "codec_name", "width", "height", "r_frame_rate", "nb_frames", "pix_fmt", "profile",
            "bit_rate", "channels", "sample_rate",
        )))),
        T.StructField("format", T.StructType(_text("duration", "bit_rate", "size", "format_name"))),
    ]
)


def parse_probe(df: DataFrame, json_col: str = "probe_json") -> DataFrame:
    """Probe JSON to typed columns; ``probe_ok`` is false instead of silent default values."""
    staged = df.withColumn("_p", F.from_json(json_col, PROBE_SCHEMA))
    first = lambda kind: F.get(F.filter("_p.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    staged = staged.withColumn("_v", first("video")).withColumn("_a", first("audio"))
    whole = lambda c, default=0: F.coalesce(c.try_cast("bigint"), F.lit(default).cast("bigint"))
    fps = S.parse_fps(F.col("_v.r_frame_rate"))
    duration = F.coalesce(F.col("_p.format.duration").try_cast("double"), F.lit(0.0))
    frames = whole(F.col("_v.nb_frames"))
    kbps = lambda c: F.floor(whole(c) / 1000)
    out = {
        "probe_ok": F.col("_v").isNotNull(),
        "width": whole(F.col("_v.width")), "height": whole(F.col("_v.height")), "fps": fps,
        "duration_s": duration, "bitrate_kbps": kbps(F.col("_p.format.bit_rate")),
        "size_mb": whole(F.col("_p.format.size")) / S.MIB,
        "container": F.coalesce("_p.format.format_name", F.lit("unknown")),
        "codec": F.coalesce("_v.codec_name", F.lit("unknown")),
        "pix_fmt": F.coalesce("_v.pix_fmt", F.lit("unknown")),
        "frame_count": F.when(frames > 0, frames).otherwise(S.whole(duration * fps)),
        "video_kbps": kbps(F.col("_v.bit_rate")),
        "audio_codec": F.col("_a.codec_name"), "audio_channels": F.col("_a.channels").try_cast("bigint"),
        "audio_sample_rate": F.col("_a.sample_rate").try_cast("bigint"), "audio_kbps": kbps(F.col("_a.bit_rate")),
    }
    keep = [c for c in df.columns if c != json_col and c not in out]
    return staged.select(*keep, *[c.alias(n) for n, c in out.items()])


def read_eval_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log file: whole text and path.  For files that hold one log each; a file must fit in memory."""
    return (
        spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("log_path"), F.col("value").alias("text"))
    )


def read_stored_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log, (log_id, text), however many logs a part file holds."""
    return spark.read.schema("log_id bigint, text string").parquet(path)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))
