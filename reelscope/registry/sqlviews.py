"""SQL twins of ``sources.views`` as common table expressions."""

from __future__ import annotations

from reelscope.sources.views import ERROR_MESSAGES


def _pick(index: str, *values: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE CAST({index} AS BIGINT) % {len(values)} {arms} END"


def _q(*values: str) -> list[str]:
    return [f"'{v}'" for v in values]


STEP = (
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, "
    "l_extendedprice, l_quantity)"
)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_assets": ((), f"""
SELECT *, CAST(floor(bitrate * duration_s / 8) AS BIGINT) AS size_bytes FROM (
SELECT p_partkey AS asset_id,
  {_pick('p_size', '3840', '1920', '1280', '854')} AS width,
  {_pick('p_size', '2160', '1080', '720', '480')} AS height,
  CAST({_pick('p_size', '24', '30', '60')} AS DOUBLE) AS fps,
  p_retailprice / 10 AS duration_s,
  CAST(p_size AS BIGINT) * 100000 AS bitrate,
  {_pick('p_size', *_q('h264', 'hevc', 'vp9'))} AS codec,
  CAST(p_size % 11 AS DOUBLE) AS complexity,
  CAST(p_partkey % 11 AS DOUBLE) AS motion,
  {_pick('p_partkey', *_q('live_action', 'animation', 'gaming', 'screen_recording', 'mixed'))} AS content_type,
  {_pick('p_partkey', '32', '64', '128', '192', '256')} AS audio_kbps,
  CAST({_pick('p_size', '4', '8', '10', '25')} AS DOUBLE) AS target_mb,
  p_name AS path
FROM part)"""),
    "v_encodes": ((), f"""
SELECT l_orderkey AS job_id, {STEP} AS step, l_partkey AS asset_id,
  CAST(floor(l_extendedprice / 20) AS BIGINT) AS bitrate_kbps,
  l_linenumber + 18 AS crf,
  {_pick('l_linenumber', *_q('libx264', 'libx265', 'h264_nvenc', 'h264_amf', 'h264_qsv', 'h264_videotoolbox'))} AS encoder,
  CASE l_returnflag WHEN 'A' THEN 'fast' WHEN 'N' THEN 'medium' ELSE 'slow' END AS preset,
  l_extendedprice / 5000 AS size_mb,
  CASE WHEN l_linenumber <> 7 THEN l_quantity + 50 END AS vmaf,
  l_discount * 1.4e0 + 0.85e0 AS ssim, l_tax AS tax,
  l_shipdate AS ts
FROM lineitem"""),
    "v_sessions": ((), """
SELECT o_orderkey AS session_id,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS platform,
  o_orderdate AS start_ts, o_totalprice / 1000 AS duration, 10.0e0 AS target_mb,
  o_totalprice / 30000 AS final_mb, o_orderstatus <> 'P' AS success,
  CAST(o_orderkey % 100 AS DOUBLE) AS quality, o_custkey AS owner
FROM orders"""),
    "v_events": ((), "SELECT *, CAST(props ->> '$.k' AS BIGINT) AS k FROM events"),
    "v_ops": (("v_events",), """
SELECT event_id AS op_id, user_id AS session_id, event_type AS op_name, ts, value AS duration,
  k % 5 <> 0 AS success, CASE WHEN k >= 10 THEN value * 10 - 200 END AS memory_delta
FROM v_events"""),
    "v_attempts": (("v_events",), f"""
SELECT event_id AS attempt_id, user_id AS session_id, ts,
  {_pick('k', *_q('vmaf', 'ssim', 'combined'))} AS eval_type,
  {_pick('k', *_q('SUCCESS', 'FAILURE', 'TIMEOUT', 'SUCCESS'))} AS result,
  value AS duration, k / 100.0e0 AS confidence
FROM v_events"""),
    "v_frames": ((), """
SELECT *, frame_idx * 0.2e0 AS ts_s FROM (
SELECT CAST(label AS BIGINT) AS video_id,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
  list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor((CAST(x AS DOUBLE) + 1) * 127.5e0))) AS INTEGER)) AS pixels,
  8 AS w, 8 AS h
FROM embeddings)"""),
    "v_points": (("v_events",), """
SELECT event_id AS point_id, user_id AS video_id, CAST(floor(epoch(ts)) AS DOUBLE) AS ts_s,
  k / 100.0e0 AS complexity, (k * 7 % 100) / 100.0e0 AS motion, k % 4 = 0 AS is_keyframe
FROM v_events"""),
    "v_cache": ((), f"""
SELECT md5(CAST(l_orderkey AS VARCHAR) || '_' || CAST(step AS VARCHAR)) AS cache_key,
  l_extendedprice AS data_size, l_shipdate AS last_accessed, o_orderdate AS created_at,
  CASE WHEN l_returnflag <> 'N' THEN l_shipdate + INTERVAL 30 DAY END AS expires_at,
  CAST(l_linenumber AS BIGINT) AS access_count
FROM (SELECT *, {STEP} AS step FROM lineitem) JOIN orders ON l_orderkey = o_orderkey"""),
    "v_files": ((), """
SELECT source || '/' || CAST(doc_id AS VARCHAR) AS path, doc_id, source, lang, n_chars AS size,
  sha256(text) AS content_hash
FROM documents"""),
    "v_errors": (("v_events",), f"""
SELECT event_id AS seq, {_pick('k', *_q(*ERROR_MESSAGES))} AS message,
  'in/' || CAST(event_id AS VARCHAR) || '.mp4' AS path
FROM v_events"""),
    "v_eval_logs": (("v_encodes",), """
SELECT job_id AS log_id,
  string_agg('n:' || CAST(step AS VARCHAR) || ' Y:' || printf('%.4f', ssim) || ' All:' || printf('%.4f', ssim - 0.01e0) || ' (20.00)', chr(10) ORDER BY step) AS ssim_text,
  coalesce('{"vmaf":{"mean":' || printf('%.2f', max(vmaf)) || '}}', '') AS vmaf_text
FROM v_encodes GROUP BY job_id"""),
}


def sql(body: str, *names: str, **ctes: str) -> str:
    """Prefix ``body`` with the named views (and their inputs) and any extra CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in ordered]
    parts += [f"{n} AS ({text})" for n, text in ctes.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def rnd(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"
