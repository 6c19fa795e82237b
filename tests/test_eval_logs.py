"""Stored logs are scored one by one, wherever a part file puts them."""

from pyspark.sql import functions as F

from reelscope.functions import logs as L
from reelscope.registry import load
from reelscope.sources import files, views as V


def test_a_row_per_log(spark, sf_dir):
    logs = V.v_eval_logs(spark, sf_dir)
    got = {r.log_id: r for r in load()[0]["eval_log_scan"](spark, sf_dir).collect()}
    want = {r.log_id: r.vmaf_text for r in logs.collect()}
    assert set(got) == set(want) and len(want) > 64
    assert all(f'{got[k].vmaf:.2f}' in t if t else got[k].vmaf is None for k, t in want.items())


def test_logs_of_one_part_file_stay_apart(spark, tmp_path):
    texts = [(1, "n:1 Y:0.9000\n" + '{"vmaf":{"mean":80.5}}'), (2, "n:1 Y:0.5000\n" + '{"vmaf":{"mean":10.0}}'), (3, "")]
    path = str(tmp_path / "logs")
    spark.createDataFrame(texts, "log_id long, text string").coalesce(1).write.parquet(path)
    rows = L.vmaf_scores(L.ssim_scores(files.read_stored_logs(spark, path))).orderBy("log_id").select("log_id", F.round("ssim", 4), "vmaf").collect()
    assert [tuple(r) for r in rows] == [(1, 0.9, 80.5), (2, 0.5, 10.0), (3, None, None)]
