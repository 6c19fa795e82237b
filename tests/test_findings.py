"""Small cases from the review findings, one or more per finding."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from reelscope.functions import scalars as S
from reelscope.operators import joins as J
from reelscope.registry import load
from reelscope.sources import views as V


def test_sanitize_uses_each_step_once(spark):
    """F16: a text named twice in a rule was cleaned twice, so the steps doubled from rule to rule (87 in the plan)."""
    plan = spark.createDataFrame([("a",)], "t string").select(S.sanitize(F.col("t")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 16


def test_sanitize_long_runs(spark):
    """F16: a run inside a text was tried again from each of its characters, with the square of its length."""
    rows = [(1, "a" + "ж" * 300_000 + "b"), (2, "a" + " " * 300_000 + "b"), (3, "x" * 170 + "." * 300_000 + "y"), (4, " . _ " * 1000), (5, None)]
    df = spark.createDataFrame(rows, "id long, t string").select("id", S.sanitize(F.col("t")).alias("n"))
    start = time.time()
    got = {r.id: r.n for r in df.collect()}
    assert time.time() - start < 60
    assert got == {1: "a", 2: "a", 3: "x" * 170, 4: "segments_summary", 5: "segments_summary"}


def largest_method(df):
    """Bytes of the largest generated method of a plan; the JVM compiles none of more than 8,000."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text))


@pytest.mark.parametrize("name", ["failure_analysis", "strategy_list"])
def test_failure_rules_are_compiled(spark, name):
    """all rules made one method of 12,913 (strategy_list: 8,601) bytes."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan is final only then
    try:
        assert largest_method(load()[0][name](spark, "/root/testdata/sf0.001")) <= 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_neighbour_counts_match_rows(spark):
    """counts of column batches equal the comparison row by row, with nulls, zeros, NaN and negative values; no lambda is interpreted."""
    rnd = random.Random(5)
    value = lambda: rnd.choice([None, 0.0, -0.0, float("nan"), -2.0, *[rnd.random() for _ in range(12)]])
    kind = "pixels double, duration_s double, complexity double, motion double, fps double"
    assets = spark.createDataFrame([(i, *[value() for _ in range(5)]) for i in range(3000)], f"asset_id long, {kind}")
    history = spark.createDataFrame([(i, i % 50, *[value() for _ in range(5)]) for i in range(300)], f"history_id long, ts long, {kind}")
    found = J.with_neighbour_count(assets, history, newest=100, above=0.6)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = J.neighbours(assets, history, newest=100, above=0.6).groupBy("asset_id").count()
    want = {r.asset_id: r["count"] for r in rows.collect()}
    got = {r.asset_id: r.similar_results for r in found.select("asset_id", "similar_results").collect()}
    assert got == {i: want.get(i, 0) for i in range(3000)} and 0 < sum(got.values())
    assert {r.similar_results for r in J.with_neighbour_count(assets, history.limit(0)).collect()} == {0}


def test_cache_does_not_broadcast_orders(spark, sf_dir):
    """Spark took the well-packed order keys for small and sent all of them through the driver, which ran out of memory at 60 x sf0.1."""
    plan = V.v_cache(spark, sf_dir).groupBy("last_accessed").agg(F.sum("data_size"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
