"""Streams over several files and restarts against their batch twins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reelscope.streaming import sinks, streams as ST


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def write(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


ATTEMPTS = "attempt_id long, session_id long, ts_s double, result string, duration double"


def test_limiter_survives_restart(spark, folder):
    data = [(i, i % 2, 100.0 * i, "FAILURE" if i in (2, 4) else "SUCCESS", 20.0) for i in range(8)]
    src = f"{folder}/in"
    out = []
    for part, rows in enumerate((data[:3], data[3:])):  # second run continues from the checkpoint
        write(spark, src, rows, ATTEMPTS, f"p{part}")
        stream = spark.readStream.schema(ATTEMPTS).option("recursiveFileLookup", "true").parquet(src)
        sinks.run_available(ST.limiter(stream), f"{folder}/ck", sinks.epoch_writer(f"{folder}/out"))
    out = {r.attempt_id: r.reason for r in spark.read.parquet(f"{folder}/out").collect()}
    assert len(out) == 8
    assert out[0] is None and out[2] is None
    assert out[4] == "expensive_evaluations_disabled" and out[6] == "expensive_evaluations_disabled"  # two in a row, latched
    assert out[1] is None and out[5] == "max_attempts_reached"


def test_update_sink_keeps_newest(spark, folder):
    schema = "metric string, seq long, label string, amount long"
    src = f"{folder}/in"
    for part in range(3):
        rows = [("m", part * 10 + i, f"e{part * 10 + i}", 1) for i in range(10)]
        write(spark, src, rows, schema, f"p{part}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        sinks.run_available(ST.ring(stream, 20), f"{folder}/ck", sinks.epoch_writer(f"{folder}/out"), "update")
    got = sinks.latest(spark, f"{folder}/out", ["metric"], "metric string, total long, recent array<string>, epoch int").first()
    assert got.total == 30 and list(got.recent) == [f"e{i}" for i in range(10, 30)]


def test_stable_files(spark, folder):
    schema = "path string, size long, mtime_s double, look_s double"
    rows = [("old", 1, 0.0, 100.0), ("new", 1, 95.0, 100.0), ("grow", 1, 96.0, 100.0), ("new", 1, 95.0, 101.0), ("grow", 2, 100.0, 101.0), ("new", 1, 95.0, 102.0)]
    write(spark, f"{folder}/in", rows, schema, "p")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    sinks.run_available(ST.stable(stream, 10.0), f"{folder}/ck", sinks.epoch_writer(f"{folder}/out"))
    got = {r.path: r.accepted_at_s for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {"old": 100.0, "new": 101.0}


def test_windows_equal_batch(spark, folder):
    schema = "op_id long, session_id long, op_name string, ts timestamp, duration double, success boolean"
    t = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, "cache_x" if i % 2 else "encode", t + dt.timedelta(minutes=7 * i), float(i), i % 4 != 0) for i in range(60)]
    write(spark, f"{folder}/in", rows, schema, "p")
    read = lambda r: r.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    stream = ST.live_op_stats(read(spark.readStream))
    sinks.run_available(stream, f"{folder}/ck", sinks.epoch_writer(f"{folder}/out"), "update")
    batch = ST.live_op_stats(read(spark.read))
    got = spark.read.parquet(f"{folder}/out").select(*batch.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    fold = ST.fold_sessions(read(spark.read), "30 minutes")
    assert fold.agg(F.sum("operations")).first()[0] == 60


def test_late_rows_are_split(spark):
    t = dt.datetime(2024, 1, 1, 1)
    df = spark.createDataFrame([(1, t), (2, t - dt.timedelta(minutes=5)), (3, t - dt.timedelta(minutes=11))], "id int, ts timestamp")
    ok, late = sinks.split_late(df, "ts", F.lit(t).cast("timestamp"))
    assert {r.id for r in ok.collect()} == {1, 2} and {r.id for r in late.collect()} == {3}


def test_sessions_close_on_end_start_and_gap(spark, folder):
    """Three epochs: an open session goes on, an end and a start close one, late and unusable rows go aside."""
    schema = "op_id long, session_id long, op_name string, ts timestamp, duration double, success boolean"
    t = dt.datetime(2024, 1, 1)
    at = lambda i, s, op, minute: (i, s, op, None if minute is None else t + dt.timedelta(minutes=minute), 1.0, True)
    epochs = [
        [at(1, 1, "start", 0), at(2, 1, "cache_get", 5), at(3, 2, "encode", 6)],
        [at(4, 1, "end", 20), at(5, 1, "encode", 21), at(6, 2, "start", 22), at(7, 2, "start", 23), at(8, 2, "encode", None), at(9, None, "encode", 22)],
        [at(10, 1, "encode", 55), at(11, 2, "encode", 30), at(12, 2, "encode", 1)],
    ]
    handle = ST.session_folder(f"{folder}/out", F.col("op_name") == "start", F.col("op_name") == "end", gap_s=1800)
    for part, rows in enumerate(epochs):
        write(spark, f"{folder}/in", rows, schema, f"p{part}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        sinks.run_available(stream, f"{folder}/ck", handle)
    minute = lambda x: int((x - t).total_seconds() // 60)
    got = sorted((r.session_id, minute(r.first_ts), minute(r.last_ts), r.operations, r.cache_lookups, r.ended) for r in ST.folded_sessions(spark, f"{folder}/out").collect())
    assert got == [(1, 0, 20, 3, 1, True), (1, 21, 21, 1, 0, False), (1, 55, 55, 1, 0, False), (2, 6, 6, 1, 0, False), (2, 22, 22, 1, 0, False), (2, 23, 30, 2, 0, False)]
    late = {r.op_id for r in spark.read.parquet(f"{folder}/out/late").collect()}
    assert late == {8, 9, 12}


def test_quarantine_names(spark):
    failed = spark.createDataFrame([(f"in/{i}", "f", "a.mp4") for i in range(5)] + [("in/x", "f", "b.mp4")], "path string, folder string, name string")
    have = spark.createDataFrame([("f", "a.mp4", 2)], "folder string, name string, taken int")
    got = sorted(r.quarantined_name for r in ST.quarantine(failed, have).collect())
    assert got == sorted([f"a ({i}).mp4" for i in range(2, 7)] + ["b.mp4"])


def test_table_streams_read_files_and_folders(spark, sf_dir, tmp_path):
    """The same rows for a table that is one file and for a folder of parts."""
    from reelscope.registry import load

    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    query = load()[0]["live_op_stats"]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(query(spark, str(tmp_path))) == key(query(spark, sf_dir))


@pytest.mark.parametrize("name", ["session_fold", "quarantine", "eval_limiter", "recent_events", "live_op_stats"])
def test_one_file_per_trigger_gives_the_same_table(spark, sf_dir, tmp_path, monkeypatch, name):
    """Two epochs end in the rows of one; files come in order of time."""
    import functools
    import os
    import shutil

    from reelscope.registry import load

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    os.makedirs(tmp_path / "events.parquet")
    for part, test in enumerate((F.col("event_id") <= half, F.col("event_id") > half)):
        events.where(test).coalesce(1).write.parquet(str(tmp_path / f"p{part}"))
        file = next(p for p in (tmp_path / f"p{part}").iterdir() if p.suffix == ".parquet")
        target = tmp_path / "events.parquet" / f"part-{part}.parquet"
        shutil.copy(file, target)
        os.utime(target, (1700000000 + part, 1700000000 + part))
    query = load()[0][name]
    key = lambda df: sorted(str(r.asDict()) for r in df.select(sorted(df.columns)).collect())
    want = query(spark, sf_dir)
    monkeypatch.setattr(ST, "table_stream", functools.partial(ST.table_stream, max_files=1))
    got = query(spark, str(tmp_path))
    approx = lambda rows: [__import__("re").sub(r"(\d+\.\d{6})\d+", r"\1", r) for r in rows]
    assert approx(key(got)) == approx(key(want))


def test_recent_events_merge_over_epochs(spark, folder):
    """Out of order over three epochs, one metric most of the rows; a replayed epoch changes nothing."""
    import random

    rng = random.Random(4)
    data = [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.7 else f"m{rng.randrange(3)}", i, f"l{i}", rng.choice([None, -2, 1, 3])) for i in range(600)]
    rng.shuffle(data)
    kind, src, out = "metric string, seq long, label string, amount long", f"{folder}/in", f"{folder}/out"
    for part in range(3):
        write(spark, src, data[part * 200 : part * 200 + 200], kind, f"p{part}")
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(src)
        sinks.run_available(stream, f"{folder}/ck", ST.recent_folder(out, keep=7, salts=3))
    ST.recent_folder(out, keep=7, salts=3)(spark.createDataFrame(data[400:], kind), 2)
    want = {}
    for metric, seq, label, amount in sorted(data, key=lambda r: -r[1]):
        at = want.setdefault(metric, [0, []])
        at[0] += max(amount or 0, 0)
        at[1] = (at[1] + [(seq, label)])[:7]
    got = {r.metric: [r.total, [(x.seq, x.label) for x in r.recent]] for r in ST.recent_events(spark, out).collect()}
    assert got == want
