"""Assets similar to requests, by sets of frame hashes, with the results cached for them.

A request and an asset are as similar as the share of the request's frames that the asset has too, where two frames are
one if their 64-bit hashes differ in at most three bits.  Such hashes agree on one of four 16-bit pieces, so hashes
meet on (piece, value); the catalogue is never compared with itself.  To be similar a pair needs a number of common frames, so
a request looks for assets by its rarest frames only, as many as it can miss plus one: a frame that a third of all videos
show (a black one) is a key only for requests made of little else.  Candidates are then counted on both whole sets, in the
row.  Equal sets are one class on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

PIECES, PIECE_BITS = 4, 16


def prints(frames: DataFrame, key: str, hash_column: str = "hash") -> DataFrame:
    """(key, hashes): the set of a video's sampled frame hashes, null hashes left out; videos without any have no row."""
    return frames.groupBy(key).agg(F.array_sort(F.collect_set(hash_column)).alias("hashes")).where(F.size("hashes") > 0)


def classes(sets: DataFrame, key: str) -> DataFrame:
    """Equal sets once: (key, the smallest; copies; hashes)."""
    return sets.groupBy("hashes").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies")).select(key, "copies", "hashes")


def hash_index(sets: DataFrame) -> DataFrame:
    """(piece, value, hash) of all distinct hashes, four rows each: the tables a catalogue keeps, to be stored by (piece, value)."""
    value = lambda i: F.shiftrightunsigned("hash", PIECE_BITS * i).bitwiseAND(F.lit((1 << PIECE_BITS) - 1))
    pieces = F.array(*[F.struct(F.lit(i).alias("piece"), value(i).alias("value")) for i in range(PIECES)])
    hashes = sets.select(F.explode("hashes").alias("hash")).distinct()
    return hashes.select("hash", F.explode(pieces).alias("_p")).select("_p.piece", "_p.value", "hash")


def close_hashes(asked: DataFrame, held: DataFrame, distance: int = PIECES - 1) -> DataFrame:
    """(asked, held): pairs of hashes of two indexes that differ in at most ``distance`` bits, each once."""
    if distance >= PIECES:
        raise ValueError("four pieces find hashes that differ in three bits at most")
    met = asked.withColumnRenamed("hash", "asked").join(held.withColumnRenamed("hash", "held"), ["piece", "value"])
    x = F.col("asked").bitwiseXOR(F.col("held"))
    same = lambda i: F.shiftrightunsigned(x, PIECE_BITS * i).bitwiseAND(F.lit((1 << PIECE_BITS) - 1)) == 0
    first = F.coalesce(*[F.when(same(i), F.lit(i)) for i in range(PIECES)])  # the first piece they agree on
    return met.where((F.bit_count(x) <= distance) & (F.col("piece") == first)).select("asked", "held")


def needed(hashes: str, threshold: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.size(hashes) * F.lit(threshold) - F.lit(1e-9))).cast("int")


def similar(requests: DataFrame, catalogue: DataFrame, threshold: float = 0.8, distance: int = PIECES - 1) -> DataFrame:
    """(request_id, request_copies, asset_id, copies, votes, frames, similarity) of similar classes.

    ``requests`` (request_id, hash) and ``catalogue`` (asset_id, hash) are frames.  Ids are the smallest of their class; the
    members of a class are the videos with its set (see ``prints``).
    """
    asked, held = classes(prints(requests, "request_id"), "request_id"), classes(prints(catalogue, "asset_id"), "asset_id")
    close = close_hashes(hash_index(asked), hash_index(held), distance)
    postings = held.select("asset_id", F.explode("hashes").alias("held"))
    often = close.join(postings.groupBy("held").agg(F.count(F.lit(1)).alias("n")), "held").groupBy("asked").agg(F.sum("n").alias("n"))
    frames = asked.select("request_id", F.explode("hashes").alias("asked"), (F.size("hashes") - needed("hashes", threshold) + 1).alias("_keys"))
    rarity = frames.join(often, "asked", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("n", "asked"))  # a video has few sampled frames
    keys = rarity.withColumn("_at", place).where((F.col("_at") <= F.col("_keys")) & (F.col("n") > 0)).select("request_id", "asked")
    candidates = keys.join(close, "asked").join(postings, "held").select("request_id", "asset_id").distinct()
    both = candidates.join(asked.withColumnsRenamed({"hashes": "_r", "copies": "request_copies"}), "request_id").join(held.withColumnRenamed("hashes", "_c"), "asset_id")
    shown = F.filter("_r", lambda h: F.exists("_c", lambda g: F.bit_count(h.bitwiseXOR(g)) <= distance))
    counted = both.withColumn("votes", F.size(shown).cast("bigint")).where(F.col("votes") >= needed("_r", threshold))
    frames_of = F.size("_r").cast("bigint")
    return counted.select("request_id", "request_copies", "asset_id", "copies", "votes", frames_of.alias("frames"), (F.col("votes") / frames_of).alias("similarity"))


def cached_results(found: DataFrame, catalogue: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """``found`` with the newest result that has not expired of any member of the asset's class (rows without one go).

    ``results``: asset_id, result_id, ts, expires_at (null: never), vmaf, ssim.
    """
    sets = prints(catalogue, "asset_id")
    member = sets.join(classes(sets, "asset_id").select(F.col("asset_id").alias("class_id"), "hashes"), "hashes").select("asset_id", "class_id")
    alive = results.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    newest = alive.join(member, "asset_id").groupBy("class_id").agg(F.max_by(F.struct("result_id", "vmaf", "ssim"), F.struct("ts", "result_id")).alias("_r"))
    return found.join(newest.withColumnRenamed("class_id", "asset_id"), "asset_id").select(*found.columns, "_r.*")


def predicted_quality(attached: DataFrame, top: int = 5, least: int = 2) -> DataFrame:
    """Per request a prediction from its ``top`` most similar results: means weighted by similarity, and a confidence.

    A metric is averaged over the rows that have it.  Requests with fewer than ``least`` results, or with neither metric, get none.
    """
    order = Window.partitionBy("request_id").orderBy(F.desc("similarity"), "asset_id")
    best = attached.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top)
    total = attached.groupBy("request_id").agg(F.count(F.lit(1)).alias("results"))
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("similarity")), F.sum(F.when(F.col(c).isNotNull(), F.col("similarity"))))
    out = best.groupBy("request_id").agg(weighted("vmaf").alias("vmaf"), weighted("ssim").alias("ssim"), F.max("similarity").alias("_top")).join(total, "request_id")
    sure = F.least(F.lit(0.9), F.col("results") * 0.15 + F.col("_top") * 0.5)
    return out.where((F.col("results") >= least) & (F.col("vmaf").isNotNull() | F.col("ssim").isNotNull())).select("request_id", "results", "vmaf", "ssim", sure.alias("confidence"))
