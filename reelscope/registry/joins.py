"""Queries for joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.functions import scalars as S
from reelscope.operators import assets as A, frames as FR, joins as J
from reelscope.registry.base import query
from reelscope.registry.sqlviews import _pick, _q
from reelscope.sources import dims, stores, views as V
from reelscope.sources.views import pick

NOW = "1999-01-01 00:00:00"


def requests(spark, sf):
    o = V.table(spark, sf, "orders")
    key = F.md5(F.concat_ws("_", F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 6 + 1).cast("string")))
    return o.select(F.col("o_orderkey").alias("request_id"), key.alias("cache_key"))


REQUESTS = "SELECT o_orderkey AS request_id, md5(CAST(o_orderkey AS VARCHAR) || '_' || CAST(o_custkey % 6 + 1 AS VARCHAR)) AS cache_key FROM orders"


@query(
    "cache_lookup",
    f"""SELECT request_id, cache_key, c.data_size, coalesce(c.cache_key IS NOT NULL, false) AS hit
    FROM requests r LEFT JOIN (SELECT * FROM v_cache WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') c USING (cache_key)""",
    "v_cache", requests=REQUESTS,
)
def _(spark, sf):
    out = J.cache_lookup(requests(spark, sf), V.v_cache(spark, sf), F.to_timestamp(F.lit(NOW)))
    return out.select("request_id", "cache_key", "data_size", "hit")


@query(
    "cache_touch",
    f"""SELECT c.cache_key, c.access_count + coalesce(n, 0) AS access_count, CASE WHEN n IS NULL THEN c.last_accessed ELSE TIMESTAMP '{NOW}' END AS last_accessed
    FROM v_cache c LEFT JOIN (SELECT cache_key, count(*) AS n FROM requests JOIN v_cache v USING (cache_key) WHERE v.expires_at IS NULL OR v.expires_at > TIMESTAMP '{NOW}' GROUP BY 1) h ON c.cache_key = h.cache_key""",
    "v_cache", requests=REQUESTS,
)
def _(spark, sf):
    now = F.to_timestamp(F.lit(NOW))
    cache = V.v_cache(spark, sf)
    hits = J.cache_lookup(requests(spark, sf), cache.select("cache_key", "expires_at"), now)
    return stores.touch(cache.select("cache_key", "access_count", "last_accessed"), hits, now)


MTIME = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id)"
TYPES = ("single_gif", "segments", "gif_input", "single_mp4", "other")
PROCESSED = f"""SELECT doc_id, path, CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS size, {MTIME} AS mtime, {_pick('doc_id', *_q(*TYPES))} AS out_type,
  'out/' || doc_id || CASE WHEN doc_id % 5 = 1 THEN '_segments' ELSE '.gif' END AS output FROM v_files WHERE doc_id % 3 <> 0"""
OUTPUTS = """SELECT 'out/' || doc_id || CASE WHEN doc_id % 5 = 1 THEN CASE WHEN doc_id % 8 = 1 THEN '_segments/readme.txt' ELSE '_segments/a_segment_01.gif' END ELSE '.gif' END AS path, doc_id FROM v_files WHERE doc_id % 4 <> 0"""


def listed(spark, sf):
    mtime = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id").cast("decimal(18,6)"))
    return V.v_files(spark, sf).select("doc_id", "path", "size", mtime.alias("mtime"))


def processed(spark, sf):
    d = F.col("doc_id")
    return listed(spark, sf).where(d % 3 != 0).select(
        "doc_id", "path", F.when(d % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime",
        pick(d, *TYPES).alias("out_type"),
        F.concat(F.lit("out/"), d.cast("string"), F.when(d % 5 == 1, "_segments").otherwise(".gif")).alias("output"),
    )


def outputs(spark, sf):
    d = F.col("doc_id")
    tail = F.when((d % 5 == 1) & (d % 8 == 1), "_segments/readme.txt").when(d % 5 == 1, "_segments/a_segment_01.gif").otherwise(".gif")
    return V.v_files(spark, sf).where(d % 4 != 0).select(F.concat(F.lit("out/"), d.cast("string"), tail).alias("path"))


@query(
    "unprocessed",
    f"""SELECT doc_id, path, size FROM v_files f WHERE NOT EXISTS (SELECT 1 FROM processed p WHERE p.path = f.path AND p.size = f.size
      AND ((p.out_type IN ('single_gif', 'gif_input') AND EXISTS (SELECT 1 FROM outputs o WHERE o.path = p.output))
        OR (p.out_type = 'segments' AND EXISTS (SELECT 1 FROM outputs o WHERE starts_with(o.path, p.output || '/') AND ends_with(o.path, '.gif')))))""",
    "v_files", processed=PROCESSED, outputs=OUTPUTS,
)
def _(spark, sf):
    return J.unprocessed(listed(spark, sf), processed(spark, sf), outputs(spark, sf)).select("doc_id", "path", "size")


@query(
    "output_match",
    """SELECT asset_id, kind, coalesce(out_mtime >= mtime - INTERVAL 60 SECOND AND CASE kind WHEN 'gif' THEN true WHEN 'segments' THEN segment_count BETWEEN 1 AND greatest(1, CAST(floor(duration_s / 20) AS BIGINT)) * 3
        ELSE abs(duration_s - out_duration) <= 2 AND abs(width - out_width) + abs(height - out_height) <= 50 END, false) AS match_ok
    FROM (SELECT asset_id, 'a' || asset_id AS stem, TIMESTAMP '1998-01-01 00:00:00' AS mtime, duration_s, width, height FROM v_assets)
    LEFT JOIN (SELECT 'a' || asset_id AS stem, """ + _pick("crf", *_q("mp4", "gif", "segments")) + """ AS kind, ts AS out_mtime, 85 + size_mb * 2 AS out_duration, """ + _pick("crf", "1920", "1280") + """ AS out_width,
      """ + _pick("crf", "1080", "720") + """ AS out_height, step * 4 AS segment_count FROM v_encodes) USING (stem)""",
    "v_assets v_encodes",
)
def _(spark, sf):
    key = lambda: F.concat(F.lit("a"), F.col("asset_id").cast("string")).alias("stem")
    inputs = V.v_assets(spark, sf).select("asset_id", key(), F.lit("1998-01-01").cast("timestamp").alias("mtime"), "duration_s", "width", "height")
    outs = V.v_encodes(spark, sf).select(
        key(), pick(F.col("crf"), "mp4", "gif", "segments").alias("kind"), F.col("ts").alias("out_mtime"),
        (F.col("size_mb") * 2 + 85).alias("out_duration"), pick(F.col("crf"), 1920, 1280).alias("out_width"),
        pick(F.col("crf"), 1080, 720).alias("out_height"), (F.col("step") * 4).alias("segment_count"),
    )
    return J.match_outputs(inputs, outs).select("asset_id", "kind", "match_ok")


GIFS = "SELECT 'root/' || source || '/' || lang || '/c' || doc_id % 50 || '_' || doc_id // 50 || '.gif' AS gif_path, source, lang, doc_id FROM v_files WHERE doc_id % 2 = 0"
VIDEOS = "SELECT CASE doc_id % 4 WHEN 1 THEN 'root/' || source || '/' || lang ELSE 'root' || CASE WHEN doc_id % 4 = 3 THEN '/' || source ELSE '' END END || '/c' || (doc_id // 2 * 2) % 50 || '_' || doc_id // 50 || " + _pick("doc_id // 2", *_q(".mp4", ".mkv", ".avi", ".txt")) + " AS path FROM v_files WHERE doc_id % 2 = 1"


@query(
    "gif_source",
    """SELECT gif_path, (SELECT arg_min(path, (depth, ext, path)) FROM (SELECT path, ext, CASE WHEN folder = 'root/' || source || '/' || lang THEN 0 WHEN folder = 'root/' || source THEN 1 WHEN folder = 'root' THEN 2 END AS depth
        FROM (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem, CASE regexp_extract(path, '\\.[^.]*$') WHEN '.mp4' THEN 0 WHEN '.mkv' THEN 2 WHEN '.avi' THEN 4 END AS ext FROM videos) v
        WHERE v.stem = regexp_extract(g.gif_path, '([^/]*)\\.[^.]*$', 1) AND ext IS NOT NULL) WHERE depth IS NOT NULL) AS video_path
    FROM gifs g""",
    "v_files", gifs=GIFS, videos=VIDEOS,
)
def _(spark, sf):
    d, s = F.col("doc_id"), lambda c: c.cast("string")
    batch = s(F.floor(d / 50))
    gif = F.concat(F.lit("root/"), "source", F.lit("/"), "lang", F.lit("/c"), s(d % 50), F.lit("_"), batch, F.lit(".gif"))
    gifs = V.v_files(spark, sf).where(d % 2 == 0).select(gif.alias("gif_path"))
    folder = F.when(d % 4 == 1, F.concat(F.lit("root/"), "source", F.lit("/"), "lang")).otherwise(F.concat(F.lit("root/"), "source"))
    video = F.concat(folder, F.lit("/c"), s(F.floor(d / 2) * 2 % 50), F.lit("_"), batch, pick(F.floor(d / 2), ".mp4", ".mkv", ".avi", ".txt"))
    videos = V.v_files(spark, sf).where(d % 2 == 1).select(video.alias("path"))
    return J.resolve_source(gifs, videos)


HASHES = """SELECT video_id * 1000000 + frame_idx AS asset_id, list_reduce(list_transform(pixels, lambda x: CASE WHEN x > list_avg(pixels) THEN '1' ELSE '0' END), lambda a, b: a || b) AS bits FROM v_frames"""


def bit_text(c):
    return F.lpad(F.bin(c), 64, "0")


def hashes(spark, sf):
    h = FR.average_hash(V.v_frames(spark, sf))
    return h.select((F.col("video_id") * 1000000 + F.col("frame_idx")).alias("asset_id"), "hash")


@query(
    "similar_frames",
    """SELECT a.bits AS bits_a, b.bits AS bits_b, a.n AS copies_a, b.n AS copies_b, 1 - hamming(a.bits, b.bits) / 64.0e0 AS similarity
      FROM g a JOIN g b ON a.bits < b.bits AND hamming(a.bits, b.bits) <= 16
    UNION ALL SELECT bits, bits, n, n, 1.0e0 FROM g WHERE n > 1""",
    "v_frames", "similarity", hashes=HASHES, g="SELECT bits, count(*) AS n FROM hashes GROUP BY bits",
)
def _(spark, sf):
    out = J.similar_assets(hashes(spark, sf), 0.75)
    a, b = bit_text(F.col("hash_a")), bit_text(F.col("hash_b"))
    first = a <= b
    return out.select(
        F.least(a, b).alias("bits_a"), F.greatest(a, b).alias("bits_b"),
        F.when(first, F.col("copies_a")).otherwise(F.col("copies_b")).alias("copies_a"),
        F.when(first, F.col("copies_b")).otherwise(F.col("copies_a")).alias("copies_b"), "similarity",
    )


def clips(spark, sf):
    """Eight frames of a video are an asset; requests are re-encoded clips that begin four frames later."""
    frames = V.v_frames(spark, sf)
    number = lambda shift: (F.col("video_id") + 10 * F.floor((F.col("frame_idx") + shift) / 8)).cast("bigint")
    coarse = frames.withColumn("pixels", F.transform("pixels", lambda x: (F.floor(x / 4) * 4).cast("int")))
    held = FR.average_hash(frames).select(number(0).alias("asset_id"), "hash")
    return FR.average_hash(coarse).select(number(4).alias("request_id"), "hash"), held


def clip_results(spark, sf):
    """Attempts as cached results of the asset with the same number; slow presets expire a month on."""
    expires = F.when(F.col("preset") == "slow", F.col("ts") + F.expr("INTERVAL 30 DAYS"))
    return V.v_encodes(spark, sf).select("asset_id", (F.col("job_id") * 1000 + F.col("step")).alias("result_id"), "ts", expires.alias("expires_at"), "vmaf", "ssim")


CLIP_BITS = "list_reduce(list_transform({0}, lambda x: CASE WHEN x > list_avg({0}) THEN '1' ELSE '0' END), lambda a, b: a || b)"
CLIPS = dict(
    held=f"SELECT DISTINCT video_id + 10 * (frame_idx // 8) AS asset_id, {CLIP_BITS.format('pixels')} AS bits FROM v_frames",
    asked=f"SELECT DISTINCT video_id + 10 * ((frame_idx + 4) // 8) AS request_id, {CLIP_BITS.format('p4')} AS bits FROM (SELECT *, list_transform(pixels, lambda x: (x // 4) * 4) AS p4 FROM v_frames)",
    held_sets="SELECT asset_id, list_sort(list(bits)) AS s FROM held GROUP BY asset_id",
    asked_sets="SELECT request_id, list_sort(list(bits)) AS s FROM asked GROUP BY request_id",
    c="SELECT min(asset_id) AS asset_id, count(*) AS copies, s FROM held_sets GROUP BY s",
    r="SELECT min(request_id) AS request_id, count(*) AS request_copies, s FROM asked_sets GROUP BY s",
    near="SELECT DISTINCT a.request_id, a.bits, h.asset_id FROM asked a JOIN held h ON hamming(a.bits, h.bits) <= 3",
    found="""SELECT request_id, request_copies, asset_id, copies, count(*) AS votes, max(len(r.s)) AS frames, count(*) / max(len(r.s))::DOUBLE AS similarity
      FROM near JOIN r USING (request_id) JOIN c USING (asset_id) GROUP BY request_id, request_copies, asset_id, copies HAVING count(*) >= 0.5 * max(len(r.s))""",
)


@query("similar_assets", "SELECT * FROM found", "v_frames", "similarity", **CLIPS)
def _(spark, sf):
    return A.similar(*clips(spark, sf), threshold=0.5)


ATTACHED = """SELECT f.*, n.result_id, n.vmaf, n.ssim FROM found f JOIN (
    SELECT class_id, arg_max({result_id: result_id, vmaf: vmaf, ssim: ssim}, (ts, result_id)) AS x FROM (
      SELECT k.asset_id AS class_id, e.job_id * 1000 + e.step AS result_id, e.ts, e.vmaf, e.ssim FROM v_encodes e JOIN held_sets m ON m.asset_id = e.asset_id JOIN c k ON k.s = m.s
      WHERE e.preset <> 'slow' OR e.ts + INTERVAL 30 DAY > TIMESTAMP '1997-01-01') GROUP BY class_id) g ON g.class_id = f.asset_id, LATERAL (SELECT x.result_id, x.vmaf, x.ssim) n"""


def attached(spark, sf):
    asked, held = clips(spark, sf)
    return A.cached_results(A.similar(asked, held, threshold=0.5), held, clip_results(spark, sf), F.lit("1997-01-01").cast("timestamp"))


@query("similar_results", "SELECT * FROM attached", "v_frames v_encodes", "similarity vmaf ssim", **CLIPS, attached=ATTACHED)
def _(spark, sf):
    return attached(spark, sf)


@query(
    "cached_quality",
    """SELECT request_id, results, vmaf, ssim, least(0.9, results * 0.15 + top * 0.5)::DOUBLE AS confidence FROM (
      SELECT request_id, max(results) AS results, sum(vmaf * similarity) / sum(CASE WHEN vmaf IS NOT NULL THEN similarity END) AS vmaf,
        sum(ssim * similarity) / sum(CASE WHEN ssim IS NOT NULL THEN similarity END) AS ssim, max(similarity) AS top
      FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, asset_id) AS k, count(*) OVER (PARTITION BY request_id) AS results FROM attached)
      WHERE k <= 5 GROUP BY request_id) WHERE results >= 2 AND (vmaf IS NOT NULL OR ssim IS NOT NULL)""",
    "v_frames v_encodes", "vmaf ssim confidence", **CLIPS, attached=ATTACHED,
)
def _(spark, sf):
    return A.predicted_quality(attached(spark, sf))


def history(spark, sf):
    return V.v_encodes(spark, sf).join(V.v_assets(spark, sf), "asset_id").select(
        (F.col("job_id") * 1000 + F.col("step")).alias("history_id"), "ts", S.pixels(F.col("width"), F.col("height")).alias("pixels"),
        "duration_s", (F.col("complexity") / 10).alias("complexity"), (F.col("motion") / 10).alias("motion"), "fps",
    )


def traits(spark, sf):
    return V.v_assets(spark, sf).select(
        "asset_id", S.pixels(F.col("width"), F.col("height")).alias("pixels"), "duration_s",
        (F.col("complexity") / 10).alias("complexity"), (F.col("motion") / 10).alias("motion"), "fps",
    )


HISTORY = """SELECT job_id * 1000 + step AS history_id, ts, width * height AS pixels, duration_s, complexity / 10 AS complexity, motion / 10 AS motion, fps
  FROM v_encodes JOIN v_assets USING (asset_id) ORDER BY ts DESC, history_id DESC LIMIT 100"""
NEIGHBOURS = """SELECT asset_id, history_id, (1 - abs(a.pixels - h.pixels) / greatest(a.pixels, h.pixels) + 1 - abs(a.duration_s - h.duration_s) / greatest(a.duration_s, h.duration_s)
    + 1 - abs(a.complexity - h.complexity) + 1 - abs(a.motion - h.motion) + 1 - abs(a.fps - h.fps) / greatest(a.fps, h.fps)) / 5 AS similarity
  FROM (SELECT asset_id, width * height AS pixels, duration_s, complexity / 10 AS complexity, motion / 10 AS motion, fps FROM v_assets) a CROSS JOIN history h"""


@query("history_neighbours", f"SELECT * FROM ({NEIGHBOURS}) WHERE similarity > 0.7e0", "v_assets v_encodes", "similarity", 9, history=HISTORY)
def _(spark, sf):
    return J.neighbours(traits(spark, sf), history(spark, sf))


@query(
    "similar_sessions",
    """SELECT asset_id, size_mb, target_mb, CASE WHEN n IS NULL THEN fallback ELSE s / n END AS estimated_s, CASE WHEN n IS NULL THEN 'low' WHEN n >= 5 THEN 'high' ELSE 'medium' END AS confidence,
      CASE WHEN n IS NULL THEN fallback * 0.5e0 ELSE lo END AS min_s, CASE WHEN n IS NULL THEN fallback * 2 ELSE hi END AS max_s, coalesce(n, 0) AS similar_sessions
    FROM (SELECT r.asset_id, r.size_mb, r.target_mb, (SELECT avg(duration) / avg(size_mb) FROM sess) * r.size_mb AS fallback, g.n, g.s, g.lo, g.hi FROM req r LEFT JOIN
      (SELECT asset_id, count(*) AS n, sum(duration) AS s, min(duration) AS lo, max(duration) AS hi FROM req r JOIN sess s ON least(r.size_mb, s.size_mb) / greatest(r.size_mb, s.size_mb) > 0.5e0
         AND least(r.target_mb, s.target_mb) / greatest(r.target_mb, s.target_mb) > 0.5e0 GROUP BY asset_id) g USING (asset_id))""",
    "v_assets v_sessions", "size_mb estimated_s min_s max_s",
    req="SELECT asset_id, round(size_bytes / 1048576.0e0, 1) AS size_mb, target_mb FROM v_assets",
    sess="SELECT round(final_mb, 1) * 2 AS size_mb, CASE session_id % 2 WHEN 0 THEN 10.0e0 ELSE 16.0e0 END AS target_mb, duration FROM v_sessions WHERE success AND coalesce(duration, 0) <> 0",
)
def _(spark, sf):
    req = V.v_assets(spark, sf).select("asset_id", F.round(F.col("size_bytes") / S.MIB, 1).alias("size_mb"), "target_mb")
    sess = V.v_sessions(spark, sf).select(
        (F.round("final_mb", 1) * 2).alias("size_mb"), pick(F.col("session_id"), 10.0, 16.0).alias("target_mb"), "duration", "success"
    )
    return J.estimate_time(req, sess)


@query(
    "pair_eval",
    """SELECT job_id, step, asset_id, width AS orig_width, height AS orig_height, bitrate_kbps AS comp_bitrate_kbps, vmaf AS comp_vmaf FROM v_encodes JOIN v_assets USING (asset_id)""",
    "v_assets v_encodes",
)
def _(spark, sf):
    comp = V.v_encodes(spark, sf).select("asset_id", "job_id", "step", "bitrate_kbps", "vmaf")
    out = J.pair(V.v_assets(spark, sf).select("asset_id", "width", "height"), comp, ["asset_id"])
    return out.withColumnsRenamed({"comp_job_id": "job_id", "comp_step": "step"})


@query(
    "frames_in_scenes",
    """SELECT point_id, video_id, ts_s, start_s FROM v_points p JOIN scenes s USING (video_id) WHERE ts_s >= start_s AND ts_s < end_s""",
    "v_points", "ts_s start_s",
    scenes="SELECT video_id, ts_s AS start_s, lead(ts_s, 1, 1706745600.0e0) OVER (PARTITION BY video_id ORDER BY ts_s, point_id) AS end_s FROM v_points WHERE is_keyframe",
)
def _(spark, sf):
    from reelscope.operators import windows as W

    points = V.v_points(spark, sf)
    cuts = points.where("is_keyframe").select("video_id", F.col("ts_s").alias("cut_s"), "point_id")
    assets = cuts.select("video_id").distinct().withColumn("duration_s", F.lit(1706745600.0))
    scenes = W.scene_intervals(cuts, assets, min_s=0.0).select("video_id", "start_s", "end_s")
    return J.assign_scenes(points.select("point_id", "video_id", "ts_s"), scenes, bin_s=86400.0).select("point_id", "video_id", "ts_s", "start_s")


PLATFORMS = "SELECT * FROM (VALUES ('instagram', 1080, 1080, 30), ('twitter', 1280, 720, 30), ('tiktok', 1080, 1920, 30), ('youtube_shorts', 1080, 1920, 30), ('facebook', 1280, 720, 30), ('discord', 1920, 1080, 30)) t(platform, mw, mh, mf)"


@query(
    "platform_caps",
    """SELECT asset_id, platform, w - w % 2 AS capped_w, h - h % 2 AS capped_h, least(CAST(mf AS DOUBLE), fps) AS capped_fps FROM (
    SELECT asset_id, platform, mf, fps, CAST(floor(width * least(mw / width, mh / height, 1.0e0)) AS BIGINT) AS w, CAST(floor(height * least(mw / width, mh / height, 1.0e0)) AS BIGINT) AS h FROM v_assets CROSS JOIN platforms)""",
    "v_assets", platforms=PLATFORMS,
)
def _(spark, sf):
    assets = V.v_assets(spark, sf).select("asset_id", "width", "height", "fps")
    return J.apply_caps(assets, dims.load_dims(spark)["video_platforms"]).select("asset_id", "platform", "capped_w", "capped_h", "capped_fps")


@query(
    "stale_entries",
    f"""SELECT doc_id, reason FROM (SELECT doc_id, CASE WHEN out_type = 'other' THEN 'unknown_type' WHEN epoch(TIMESTAMP '2024-01-02 00:10:00') - epoch(mtime) > 86400 THEN 'expired' WHEN doc_id % 7 = 0 THEN 'changed'
      WHEN NOT CASE WHEN out_type = 'segments' THEN EXISTS (SELECT 1 FROM outputs o WHERE starts_with(o.path, p.output || '/') AND ends_with(o.path, '.gif')) ELSE EXISTS (SELECT 1 FROM outputs o WHERE o.path = p.output) END THEN 'missing_output' END AS reason
    FROM processed p) WHERE reason IS NOT NULL""",
    "v_files", processed=PROCESSED, outputs=OUTPUTS,
)
def _(spark, sf):
    cache = processed(spark, sf).select(
        "doc_id", "path", "out_type", "output", F.col("mtime").alias("recorded_at"), (F.col("doc_id") % 7 != 0).alias("same_signature")
    )
    return J.stale(cache, outputs(spark, sf), F.lit("2024-01-02 00:10:00").cast("timestamp")).select("doc_id", "reason")


@query(
    "folder_health",
    """SELECT folder, count(*) FILTER (media) AS media, bool_or(summary) AS has_summary, CASE WHEN count(*) FILTER (media) = 0 THEN 'remove' WHEN NOT bool_or(summary) THEN 'write_summary' ELSE 'none' END AS action
    FROM (SELECT 'out/show' || doc_id // 4 || '_segments' AS folder, doc_id % 3 = 1 AND doc_id % 5 <> 0 AS media, doc_id % 3 = 2 AND doc_id % 2 = 0 AS summary FROM v_files) GROUP BY folder""",
    "v_files",
)
def _(spark, sf):
    d = F.col("doc_id")
    show = F.concat(F.lit("show"), F.floor(d / 4).cast("string"))
    name = (
        F.when((d % 3 == 1) & (d % 5 != 0), "clip.MP4").when((d % 3 == 2) & (d % 2 == 0), F.concat(F.lit("~"), show, F.lit("_comprehensive_summary.txt")))
        .otherwise("~cover.gif")
    )
    return J.folder_health(V.v_files(spark, sf).select(F.concat(F.lit("out/"), show, F.lit("_segments/"), name).alias("path")))
