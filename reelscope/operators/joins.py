"""Joins. Every one is an equi-join on a bounded-fan-out key; none multiplies a group by itself."""

from __future__ import annotations

from itertools import combinations
from math import comb, floor

from pyspark.sql import Column, DataFrame, functions as F

from reelscope.functions import constants as K, scalars as S
from reelscope.session import checkpointed
from reelscope.sources import files


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests with ``hit`` and the live cache row (null on a miss). Cache keys are unique."""
    live = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).withColumn("_live", F.lit(True))
    joined = requests.join(live, "cache_key", "left")
    return joined.withColumn("hit", F.coalesce("_live", F.lit(False))).drop("_live")


def available_outputs(outputs: DataFrame) -> DataFrame:
    """(output, kind) pairs that exist: every file, and every folder holding at least one GIF."""
    single = outputs.select(F.col("path").alias("output"), F.lit("file").alias("_kind"))
    gifs = outputs.where(files.extension(F.col("path")) == ".gif")
    folders = gifs.select(files.folder(F.col("path")).alias("output"), F.lit("segments").alias("_kind")).distinct()
    return single.unionByName(folders)


def output_kind(out_type: Column) -> Column:
    """How an output type is checked; null for types that never count as present."""
    return F.when(out_type == "segments", "segments").when(out_type.isin("single_gif", "gif_input"), "file")


def unprocessed(listed: DataFrame, processed: DataFrame, outputs: DataFrame) -> DataFrame:
    """Files whose (path, size, mtime) has no recorded success with an output still present."""
    good = processed.withColumn("_kind", output_kind(F.col("out_type"))).where(F.col("_kind").isNotNull())
    present = good.join(available_outputs(outputs), ["output", "_kind"], "left_semi")
    return listed.join(present, ["path", "size", "mtime"], "left_anti")


def match_outputs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs left-joined to outputs by stem, with ``match_ok`` per pair.

    Inputs: stem, mtime, duration_s, width, height.  Outputs: stem, kind (mp4, gif, segments),
    out_mtime, out_duration, out_width, out_height, segment_count.
    """
    j = inputs.join(outputs, "stem", "left")
    fresh = F.col("out_mtime") >= F.col("mtime") - F.expr("INTERVAL 60 SECONDS")
    known = F.coalesce(F.col("duration_s"), F.lit(0.0)) != 0
    mp4 = (F.abs(F.col("duration_s") - F.col("out_duration")) <= 2.0) & (
        F.abs(F.col("width") - F.col("out_width")) + F.abs(F.col("height") - F.col("out_height")) <= 50
    )
    most = F.greatest(F.lit(1).cast("bigint"), S.whole(F.col("duration_s") / 20)) * 3
    segs = F.col("segment_count").between(1, most)
    fits = F.when(~known | (F.col("kind") == "gif"), True).when(F.col("kind") == "segments", segs).otherwise(mp4)
    return j.withColumn("match_ok", F.coalesce(fresh & fits, F.lit(False)))


def resolve_source(gifs: DataFrame, videos: DataFrame, extra_dirs: tuple[str, ...] = (), up: int = 4) -> DataFrame:
    """Nearest video per GIF: own folder, up to ``up`` ancestors, its segments folder, extra folders.

    Each GIF lists its few candidate folders and meets videos on (folder, stem), so a stem shared
    by very many files does not form a large group.
    """
    path = F.col("gif_path")
    parts = F.split(files.folder(path), "/")
    ancestors = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(up - 1), F.size(parts) - 1)),
        lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), F.size(parts) - i)),
    )
    own = F.concat(files.folder(path), F.lit("/"), files.stem(path), F.lit("_segments"))
    dirs = F.array_distinct(F.concat(ancestors, F.array(own, *[F.lit(d) for d in extra_dirs])))
    cand = gifs.select("gif_path", files.stem(path).alias("stem"), F.posexplode(dirs).alias("dir_rank", "folder"))
    order = {ext: i for i, ext in enumerate(K.SOURCE_EXTENSIONS)}
    vids = videos.select(
        F.col("path").alias("video_path"), files.folder(F.col("path")).alias("folder"), files.stem(F.col("path")).alias("stem"),
        S.lookup(files.extension(F.col("path")), order).alias("ext_rank"),
    ).where("ext_rank IS NOT NULL")
    best = cand.join(vids, ["folder", "stem"]).groupBy("gif_path").agg(
        F.min_by("video_path", F.struct("dir_rank", "ext_rank", "video_path")).alias("video_path")
    )
    return gifs.join(best, "gif_path", "left")


# ---------------------------------------------------------------- similar hashes


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_groups(hashes: DataFrame) -> DataFrame:
    """asset_id, hash -> hash, copies: equal hashes collapse map-side before any pairing."""
    return hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("asset_id").alias("first_asset"))


def similar_hashes(groups: DataFrame, threshold: float = 0.8, agree: int = 1, bits: int = 64, salts: int = 4) -> DataFrame:
    """All pairs of distinct hashes with 1 - hamming/bits >= threshold, each once, exact.

    With at most d differing bits and d + ``agree`` pieces, ``agree`` pieces are equal, so two
    near hashes meet on some combination of pieces.  A pair is kept only for the first
    combination it agrees on, so no de-duplicating shuffle is needed.  One side is spread over
    ``salts`` and the other copied to each, so a popular combination is shared by many tasks.

    A low threshold is costly on any exact method: at 0.8 the thirteen pieces have five bits.  For
    a large catalogue raise ``agree`` (fewer candidates, more keys per hash) or the threshold.
    """
    d = floor(bits * (1 - threshold) + 1e-9)
    n = d + agree
    edges = [round(i * bits / n) for i in range(n + 1)]
    h = F.col("hash")
    pieces = [
        F.shiftrightunsigned(h, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(n)
    ]
    combos = list(combinations(range(n), agree))
    keys = F.array(*[
        F.struct(F.lit(sum(1 << i for i in c)).cast("bigint").alias("mask"), F.xxhash64(F.lit(k), *[pieces[i] for i in c]).alias("key"))
        for k, c in enumerate(combos)
    ])
    keyed = groups.select("hash", "copies", "first_asset", F.explode(keys).alias("_k")).select("*", "_k.*").drop("_k")
    left = keyed.select(*[F.col(c).alias(f"{c}_a") if c not in ("mask", "key") else F.col(c) for c in keyed.columns])
    left = left.withColumn("_salt", F.pmod(F.xxhash64("hash_a"), F.lit(salts)).cast("int"))
    right = keyed.select(*[F.col(c).alias(f"{c}_b") if c not in ("mask", "key") else F.col(c) for c in keyed.columns])
    right = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    met = left.join(right, ["mask", "key", "_salt"]).where(F.col("hash_a") < F.col("hash_b"))
    x = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    met = met.withColumn("_x", x).where(F.bit_count("_x") <= d)
    flags = [
        F.when(F.shiftrightunsigned("_x", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) == 0, F.lit(1 << i))
        for i in range(n)
    ]
    first = F.aggregate(F.slice(F.array_compact(F.array(*flags)), 1, agree), F.lit(0), lambda a, b: a + b)
    kept = met.where(F.col("mask") == first.cast("bigint"))
    return kept.select(
        "hash_a", "hash_b", "copies_a", "copies_b", "first_asset_a", "first_asset_b",
        (1 - F.bit_count("_x") / float(bits)).alias("similarity"),
    )


#: Hashes of one side that a task compares with those of another at a time.
FACED = 1 << 14


def similar_everywhere(groups: DataFrame, threshold: float, bits: int = 64) -> DataFrame:
    """As ``similar_hashes``, for thresholds at which its pieces tell too little apart: all pairs are compared.

    The hashes are dealt over blocks of some ``FACED``, each pair of blocks is one group of rows, and a task compares a group
    in slices, so its memory is fixed.  The number of comparisons is the square of the number of distinct hashes.
    """
    import numpy as np
    import pandas as pd

    d = floor(bits * (1 - threshold) + 1e-9)
    count = F.greatest(F.lit(1), F.ceil(groups.agg(F.count(F.lit(1)).alias("n")).scalar() / FACED)).cast("int")
    dealt = groups.select("hash", "copies", "first_asset").withColumn("_n", count)
    dealt = dealt.withColumn("_at", F.pmod(F.xxhash64("hash"), F.col("_n")).cast("int"))
    met = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    met = met.select("hash", "copies", "first_asset", "_at", F.least("_at", "_with").alias("_lo"), F.greatest("_at", "_with").alias("_hi"))
    met = met.repartition(4 * groups.sparkSession.sparkContext.defaultParallelism, "_lo", "_hi")
    names = [f"{c}_{side}" for c in ("hash", "copies", "first_asset") for side in "ab"]

    def compared(key, pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["_at"] == key[0]].reset_index(drop=True)
        right = left if key[0] == key[1] else pdf[pdf["_at"] == key[1]].reset_index(drop=True)
        x, y = left["hash"].to_numpy(np.int64), right["hash"].to_numpy(np.int64)
        found = []
        for start in range(0, len(x), 128):
            apart = np.bitwise_count((x[start : start + 128, None] ^ y[None, :]).view(np.uint64))
            i, j = np.divmod(np.flatnonzero(apart <= d), len(y))
            near = np.column_stack([i + start, j, apart[i, j]])
            found.append(near[x[near[:, 0]] < y[near[:, 1]]] if key[0] == key[1] else near)
        i, j, apart = np.concatenate(found).T if found else np.zeros((3, 0), int)
        swapped = x[i] > y[j]
        out = {"differ": apart.astype(np.int64)}
        for c in ("hash", "copies", "first_asset"):
            a, b = left[c].to_numpy()[i], right[c].to_numpy()[j]
            out[f"{c}_a"], out[f"{c}_b"] = np.where(swapped, b, a), np.where(swapped, a, b)
        return pd.DataFrame(out)

    kinds = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    schema = "differ bigint, " + ", ".join(f"{n} {kinds[n[:-2]]}" for n in names)
    near = met.groupBy("_lo", "_hi").applyInPandas(compared, schema)
    return near.select(*names, (1 - F.col("differ") / float(bits)).alias("similarity"))


def similar_assets(hashes: DataFrame, threshold: float = 0.8, agree: int = 1) -> DataFrame:
    """Similar groups of assets: pairs of distinct hashes, plus one row per hash shared by copies.

    Equal copies are reported as one row (similarity 1) with their number, never as all pairs;
    the members of a hash are the rows of ``hashes`` with that value.
    """
    groups = checkpointed(hash_groups(hashes))  # read several times
    pieces = floor(64 * (1 - threshold) + 1e-9) + agree
    telling = comb(pieces, agree) / 2 ** (64 / pieces * agree)  # the share of all pairs that meet in some combination of pieces
    find = similar_everywhere(groups.where("hash IS NOT NULL"), threshold) if telling > 0.25 else similar_hashes(groups, threshold, agree)
    equal = groups.where("copies > 1").select(
        F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b"),
        F.col("first_asset").alias("first_asset_a"), F.col("first_asset").alias("first_asset_b"), F.lit(1.0).alias("similarity"),
    )
    return find.unionByName(equal)


# ---------------------------------------------------------------- history and sessions


def closeness(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Mean of five similarities: pixels, duration, complexity, motion, fps."""
    ratio = lambda x, y: 1 - F.coalesce(F.try_divide(F.abs(x - y), F.greatest(x, y)), F.lit(0.0))
    gap = lambda x, y: 1 - F.abs(x - y)
    parts = [ratio(a["pixels"], b["pixels"]), ratio(a["duration_s"], b["duration_s"]), gap(a["complexity"], b["complexity"]),
             gap(a["motion"], b["motion"]), ratio(a["fps"], b["fps"])]
    return sum(parts[1:], parts[0]) / 5


TRAITS = ("pixels", "duration_s", "complexity", "motion", "fps")


def newest_history(history: DataFrame, newest: int = 100) -> DataFrame:
    """The bounded history the predictor keeps: one row holding an array of the newest rows."""
    rows = history.orderBy(F.col("ts").desc(), F.col("history_id").desc()).limit(newest)
    return rows.agg(F.collect_list(F.struct("history_id", *TRAITS)).alias("h"))


def neighbours(assets: DataFrame, history: DataFrame, key: str = "asset_id", newest: int = 100, above: float = 0.7) -> DataFrame:
    """Per asset the history rows closer than ``above``: key, history_id, similarity.

    The history is bounded by definition (newest N), so it rides along as one scalar array: assets are
    neither shuffled nor joined, and the comparison stays in generated code.
    """
    held = assets.select(key, *TRAITS).withColumn("_h", newest_history(history, newest).scalar())
    rows = held.withColumn("_r", F.explode("_h")).drop("_h")
    close = closeness({t: F.col(t) for t in TRAITS}, {t: F.col(f"_r.{t}") for t in TRAITS})
    near = rows.withColumn("similarity", close).where(F.col("similarity") > above)
    return near.select(key, F.col("_r.history_id").alias("history_id"), "similarity")


def close_counts(held: list[tuple], above: float):
    """Task-side function: columns of traits to the number of ``held`` rows closer than ``above``, as ``closeness`` has it for doubles."""

    def counted(*columns):
        import numpy as np
        import pyarrow as pa

        missing = [c.is_null().to_numpy(zero_copy_only=False)[:, None] for c in columns]
        values = [c.to_numpy(zero_copy_only=False).astype(float)[:, None] for c in columns]
        theirs = [np.array([np.nan if r[i] is None else r[i] for r in held], float)[None, :] for i in range(len(TRAITS))]
        unknown = [np.array([r[i] is None for r in held], bool)[None, :] for i in range(len(TRAITS))]
        out = np.zeros(len(columns[0]), np.int64)
        for at in range(0, len(out) if held else 0, 1024):
            here = slice(at, at + 1024)
            total, counts = 0.0, True
            with np.errstate(all="ignore"):
                for i, name in enumerate(TRAITS):
                    x, y, null = values[i][here], theirs[i], missing[i][here] | unknown[i]
                    apart = np.abs(x - y)
                    if name in ("complexity", "motion"):
                        counts = counts & ~null
                    else:
                        top = np.maximum(x, y)
                        apart = np.where(null | (top == 0), 0.0, apart / top)
                    total = total + (1 - apart)
                near = total / 5
            out[here] = (counts & ((near > above) | np.isnan(near))).sum(axis=1)  # Spark has NaN above every number
        return pa.array(out)

    return counted


def with_neighbour_count(assets: DataFrame, history: DataFrame, newest: int = 100, above: float = 0.7) -> DataFrame:
    """Assets plus ``similar_results``, the number of close history rows.

    The history's traits (at most ``newest`` rows, by definition) are read when the plan is built and go along with the
    function; assets are compared in column batches, neither shuffled nor joined.
    """
    rows = history.orderBy(F.col("ts").desc(), F.col("history_id").desc()).limit(newest)
    held = [tuple(r) for r in rows.select(*[F.col(t).cast("double").alias(t) for t in TRAITS]).collect()]
    count = F.arrow_udf(close_counts(held, above), "bigint")
    return assets.withColumn("similar_results", count(*[F.col(t).cast("double") for t in TRAITS]))


LEAF_BITS = 16
TOP_LEVEL = LEAF_BITS + 1


def _leaf(size: Column, shift: float = 0.0) -> Column:
    """Position of a size on a logarithmic scale, in steps of 2^-16 of a doubling."""
    return F.floor((F.log2(F.greatest(size.cast("double"), F.lit(1e-9))) + shift) * float(1 << LEAF_BITS))


def _cover(low: Column, high: Column) -> Column:
    """The few power-of-two cells (level, cell) that tile the leaves low..high exactly."""
    cell = lambda level, c: F.struct(level.cast("int").alias("level"), c.alias("cell"))
    nothing = F.array().cast("array<struct<level:int,cell:bigint>>")
    start = F.struct(low.alias("lo"), high.alias("hi"), nothing.alias("cells"))

    def step(a, k):
        lo, hi = a["lo"], a["hi"]
        open_, odd, even = lo <= hi, F.pmod(lo, F.lit(2)) == 1, F.pmod(hi, F.lit(2)) == 0
        both = odd & even & (lo == hi)
        took = F.concat(
            a["cells"], F.when(open_ & odd, F.array(cell(k, lo))).otherwise(nothing),
            F.when(open_ & even & ~both, F.array(cell(k, hi))).otherwise(nothing),
        )
        up = lambda x: F.floor(x / 2)
        return F.struct(
            F.when(open_, up(F.when(odd, lo + 1).otherwise(lo))).otherwise(lo).alias("lo"),
            F.when(open_, up(F.when(even, hi - 1).otherwise(hi))).otherwise(hi).alias("hi"), took.alias("cells"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(TOP_LEVEL)), start, step, lambda a: a["cells"])


def _similar_stats(wants: DataFrame, points: DataFrame) -> DataFrame:
    """Count, sum, minimum and maximum over the points with size and target ratios above 1/2, per wanted pair.

    Points are summed once per cell of a power-of-two hierarchy over log size; a request reads the
    some thirty cells that tile its range, and only the cells at its two ends are compared row by row.
    """
    bucket = lambda c: F.floor(F.log2(F.greatest(F.col(c), F.lit(1e-9))))
    near = lambda a, b: F.least(F.col(a), F.col(b)) / F.greatest(F.col(a), F.col(b)) > 0.5
    have = points.select(F.col("size_mb").alias("_s"), F.col("target_mb").alias("_t"), "n", "s", "lo", "hi").withColumn("_leaf", _leaf(F.col("_s")))
    targets = have.select("_t").distinct().withColumn("_bt", bucket("_t"))
    probe = wants.withColumn("_bt", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: bucket("target_mb") + i)))
    pairs = probe.join(targets, "_bt").where(near("target_mb", "_t")).select("size_mb", "target_mb", "_t")
    ends = pairs.withColumns({"_a": _leaf(F.col("size_mb"), -1.0), "_b": _leaf(F.col("size_mb"), 1.0)})
    stats = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    levels = F.transform(F.sequence(F.lit(0), F.lit(TOP_LEVEL)), lambda k: F.struct(
        k.alias("level"), F.floor(F.col("_leaf") / F.pow(F.lit(2.0), k.cast("double"))).alias("cell")))
    cells = have.select("_t", "n", "s", "lo", "hi", F.explode(levels).alias("_c")).groupBy("_t", "_c.level", "_c.cell").agg(*stats)
    inside = ends.select("size_mb", "target_mb", "_t", F.explode(_cover(F.col("_a") + 2, F.col("_b") - 2)).alias("_c"))
    whole = inside.select("size_mb", "target_mb", "_t", "_c.level", "_c.cell").join(cells, ["_t", "level", "cell"])
    rim = ends.select("size_mb", "target_mb", "_t", F.explode(F.concat(
        F.sequence(F.col("_a") - 1, F.col("_a") + 1), F.sequence(F.col("_b") - 1, F.col("_b") + 1))).alias("_leaf"))
    edge = rim.join(have, ["_t", "_leaf"]).where(near("size_mb", "_s"))
    cols = ["size_mb", "target_mb", "n", "s", "lo", "hi"]
    return whole.select(*cols).unionByName(edge.select(*cols)).groupBy("size_mb", "target_mb").agg(*stats)


def estimate_time(requests: DataFrame, sessions: DataFrame, scale: float = 1.0) -> DataFrame:
    """Processing-time estimate per request from successful sessions of similar size and target.

    Sessions: size_mb, target_mb, duration, success.  Equal (size, target) points merge first.
    """
    good = sessions.where(F.col("success") & (F.coalesce("duration", F.lit(0.0)) != 0))
    points = good.groupBy("size_mb", "target_mb").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("s"), F.min("duration").alias("lo"), F.max("duration").alias("hi")
    )
    found = _similar_stats(requests.select("size_mb", "target_mb").distinct(), points)
    total = points.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("size_mb")).alias("mb"))
    all_row = total.select(F.struct("*")).scalar()
    j = requests.join(found, ["size_mb", "target_mb"], "left").withColumn("_all", all_row)
    few = F.coalesce(F.col("_all.n"), F.lit(0)) < 3
    base = F.greatest(F.lit(30.0), F.col("size_mb") * 0.5)
    scaled = F.col("_all.s") / F.col("_all.n") * (F.col("size_mb") / (F.col("_all.mb") / F.col("_all.n")))
    some = F.col("n").isNotNull()
    est = F.when(few, base).when(some, F.col("s") / F.col("n")).otherwise(scaled)
    return j.select(
        *requests.columns,
        (est * scale).alias("estimated_s"),
        F.when(~few & some & (F.col("n") >= 5), "high").when(~few & some, "medium").otherwise("low").alias("confidence"),
        (F.when(~few & some, F.col("lo")).otherwise(est * 0.5) * scale).alias("min_s"),
        (F.when(~few & some, F.col("hi")).otherwise(est * 2.0) * scale).alias("max_s"),
        F.when(few, 0).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("similar_sessions"),
    )


def pair(original: DataFrame, compressed: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join; non-key columns get the prefixes orig_ and comp_."""
    tag = lambda df, p: df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{p}_{c}") for c in df.columns])
    return tag(original, "orig").join(tag(compressed, "comp"), keys)


def assign_scenes(frames: DataFrame, scenes: DataFrame, bin_s: float = 60.0) -> DataFrame:
    """Frame to scene where start <= ts < end.

    Scenes are cut at fixed time bins and meet frames on (video, bin): a very long video spreads
    over its bins instead of forming one group.
    """
    bin_of = lambda c: F.floor(c / bin_s)
    last = F.greatest(bin_of(F.col("start_s")), F.ceil(F.col("end_s") / bin_s) - 1)
    cut = scenes.where("end_s > start_s").withColumn("_bin", F.explode(F.sequence(bin_of(F.col("start_s")), last)))
    tagged = frames.withColumn("_bin", bin_of(F.col("ts_s")))
    inside = tagged.join(cut, ["video_id", "_bin"]).where("ts_s >= start_s AND ts_s < end_s")
    return inside.drop("_bin")


def apply_caps(assets: DataFrame, platforms: DataFrame) -> DataFrame:
    """Assets for each platform: scaled to its box with even sides, frame rate capped.

    The platform table has a fixed handful of rows, which travel as one array value.
    """
    boxes = platforms.agg(F.sort_array(F.collect_list(F.struct("platform", "max_width", "max_height", "cap_fps"))).alias("p")).scalar()
    each = assets.withColumn("_p", F.explode(boxes)).select("*", "_p.*").drop("_p")
    scale = F.least(F.col("max_width") / F.col("width"), F.col("max_height") / F.col("height"), F.lit(1.0))
    return each.withColumns(
        {
            "capped_w": S.even(S.whole(F.col("width") * scale)),
            "capped_h": S.even(S.whole(F.col("height") * scale)),
            "capped_fps": F.least(F.col("cap_fps").cast("double"), F.col("fps")),
        }
    ).drop("max_width", "max_height", "cap_fps")


def stale(cache: DataFrame, outputs: DataFrame, now: Column, ttl_hours: int = 24) -> DataFrame:
    """Cache rows to drop with the reason: unknown type, too old, changed source, or output gone.

    Cache: path, out_type, output, recorded_at, and whether the signature still matches (same_signature).
    """
    kind = F.when(F.col("out_type") == "segments", "segments").when(
        F.col("out_type").isin("single_gif", "gif_input", "single_mp4"), "file")
    known = cache.withColumn("_kind", kind)
    present = available_outputs(outputs).withColumn("_there", F.lit(True))
    j = known.join(present, ["output", "_kind"], "left")
    old = F.unix_timestamp(now) - F.unix_timestamp("recorded_at") > ttl_hours * 3600
    reason = (
        F.when(F.col("_kind").isNull() | F.col("output").isNull(), "unknown_type")
        .when(old, "expired").when(~F.col("same_signature"), "changed")
        .when(F.col("_there").isNull(), "missing_output")
    )
    return j.withColumn("reason", reason).where("reason IS NOT NULL").select(*cache.columns, "reason")


def folder_health(listing: DataFrame) -> DataFrame:
    """Segment folders: without media (to remove) or without a canonical summary (to write)."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    media = files.extension(F.col("path")).isin(".mp4", ".gif") & ~name.startswith("~") & ~name.startswith("folder.")
    base = listing.withColumn("folder", files.folder(F.col("path"))).where(F.col("folder").contains("_segments"))
    agg = base.groupBy("folder").agg(F.count_if(media).alias("media"), F.bool_or(name == S.summary_name(F.col("folder"))).alias("has_summary"))
    return agg.withColumn("action", F.when(F.col("media") == 0, "remove").when(~F.col("has_summary"), "write_summary").otherwise("none"))
