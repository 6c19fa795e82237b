"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores).  Each query runs once unmeasured
at the same scale (class loading, code generation), then once measured, to a discarding sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "bottlenecks", "session_summary", "daily_stats", "op_trends", "report_export", "classify_errors", "param_audit",
    "cache_key", "ssim_robust", "vmaf_scores", "quality_gate", "failure_analysis", "cache_lookup", "cache_upsert",
    "lru_evict", "ladder_top8", "floor_adjust", "bpp_select", "similar_assets", "similar_sessions", "predict_decision",
    "frame_motion", "dedup_frames", "complexity_regions", "failure_runs", "best_attempt", "convergence", "eval_router",
    "spatial_10", "live_op_stats",
)


def main() -> None:
    from reelscope.registry import load
    from reelscope.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    queries, _ = load()
    spark = local_session(cpus, "bench")
    times: dict[str, float] = {}

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in names:
        once(name)
        times[name] = round(once(name), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline queries, total warm time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
