"""Idempotent sinks: every epoch owns a folder, so a replayed batch overwrites itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

EPOCH = "epoch"


def epoch_writer(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{EPOCH}={epoch}")

    return write


def latest(spark: SparkSession, path: str, keys: list[str], schema) -> DataFrame:
    """Current table behind an update-mode sink: the newest epoch's row per key."""
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, EPOCH)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), EPOCH).alias("_r"))
    return newest.select(*keys, "_r.*")


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what is there, then stop; the checkpoint lets the next run go on from here."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def split_late(batch: DataFrame, ts: str, newest, delay_s: int = 600) -> tuple[DataFrame, DataFrame]:
    """(on time, late): late rows are older than ``newest`` by more than the watermark delay.

    With a null ``newest`` (nothing seen yet) no row is late; rows without a time count as on time.
    """
    late = F.coalesce(F.unix_timestamp(ts) < F.unix_timestamp(newest) - delay_s, F.lit(False))
    return batch.where(~late), batch.where(late)
