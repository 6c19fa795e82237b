"""Plan shape: no nested-loop joins, pruned scans, pushed filters, and no session needed to import."""

import subprocess
import sys

import pytest

from reelscope.registry import load
from reelscope.sources import files, stores, views as V

SLOW_TO_PLAN = {"session_log", "eval_log_scan"}  # these write files while building
QUERIES = load()[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["similar_assets", "history_neighbours", "similar_sessions", "frames_in_scenes", "platform_caps", "ladder",
                                  "floor_adjust", "bpp_select", "session_summary", "cache_stats", "gif_source", "unprocessed"])
def test_no_nested_loops(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_listing_reads_no_content(spark, sf_dir):
    text = plan(files.scan_media(spark, sf_dir, extensions=(".parquet",)))
    assert "content" not in text.split("ReadSchema:")[1].split("\n")[0]


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    from pyspark.sql import functions as F

    text = plan(stores.retain(V.v_ops(spark, sf_dir).select("op_id", "ts"), "ts", 7, F.lit("2024-01-31").cast("timestamp_ntz")))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text and "GreaterThanOrEqual(ts" in text


def test_projection_rules_do_not_shuffle(spark, sf_dir):
    for name in ("classify_errors", "fps_policy", "ladder_top8", "bpp_select", "gif_params", "segment_decision", "video_segments"):
        assert "Exchange" not in plan(QUERIES[name](spark, sf_dir)), name


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())"
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_minimum_size_guards_the_grid(spark):
    """No picture below the minimum; where no size of the grid meets it, the asset's own, raised to it."""
    from reelscope.plans import planning as P

    df = spark.createDataFrame([(1, 1920, 1080, 30.0, 50, "high"), (2, 320, 240, 30.0, 50, "high")],
                               "asset_id long, width int, height int, fps double, kbps long, motion_level string")
    got = {r.asset_id: (r.sel_w, r.sel_h) for r in P.select_res_fps(df, 0.023, min_size=(640, 360)).collect()}
    assert got == {1: (1920, 1080), 2: (640, 360)}
    free = {r.asset_id: r.sel_h for r in P.select_res_fps(df, 0.023).collect()}
    assert free[1] < 360 and free[2] < 360


def test_prediction_without_a_measured_feature(spark):
    """A row whose features are null is predicted as if they were 0, not dropped."""
    from reelscope.plans import predict as PR

    names = [*PR.STAT_FEATURES, "frames", "analysis_s"]
    df = spark.createDataFrame([(1, *[None] * len(PR.STAT_FEATURES), 4.0, 2.0), (2, *[0.0] * len(PR.STAT_FEATURES), 4.0, 2.0)],
                               ", ".join(["id int", *[f"{n} double" for n in names]]))
    a, b = PR.predict_stat(df).orderBy("id").select("pred_vmaf", "pred_ssim", "confidence").collect()
    assert a == b and a.pred_vmaf is not None


def test_cache_notices(spark):
    """Above 80 percent, below 20 percent over more than 20 lookups, and nothing between."""
    from reelscope.plans import reports as R

    df = spark.createDataFrame([(10, 90.0), (30, 80.0), (21, 10.0), (20, 10.0), (0, None)], "total_lookups long, hit_rate double")
    got = {(r.kind, r.severity, r.advice) for r in R.cache_notice(df).collect()}
    assert got == {("optimization_opportunity", "low", "increase_cache_size"), ("cache_optimization", "high", "review_cache_strategy")}
    assert R.cache_notice(df).count() == 2
    found = spark.createDataFrame([("poor_cache_performance", "cache", "high", 10.0, 5, 0.0, 0.0)],
                                  "kind string, op_name string, severity string, metric double, n long, variability double, max_memory double")
    kinds = [r.kind for r in R.recommend(found, lookups=df.where("total_lookups = 21")).collect()]
    assert "cache_optimization" in kinds and "poor_cache_performance" in kinds


def test_heavy_work_on_small_tables_is_spread(spark, sf_dir):
    """A small file is one task, so what costs much per row is dealt over the cores; options are chosen within the row."""
    for name in ("ladder", "ladder_quality", "pick_option"):
        assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, sf_dir)), name
    assert "lambda" not in plan(QUERIES["ladder"](spark, sf_dir))
    text = plan(QUERIES["pick_option"](spark, sf_dir))
    assert "Join" not in text and "Aggregate" not in text
