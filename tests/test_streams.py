"""Streams over several batches, with rows out of order and too late."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from voxelmeter.session import scratch_path
from voxelmeter.streaming import streams as sm

T0 = datetime(2024, 1, 1)
DDL = "ts timestamp, arm string, n bigint"


def stream(spark, batches):
    path = scratch_path(spark, "in")
    for rows in batches:
        spark.createDataFrame([(T0 + timedelta(minutes=m), a, n) for m, a, n in rows], DDL).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, df, mode="append"):
    return sm.run_available(df, scratch_path(spark, "out"), scratch_path(spark, "chk"), mode)


def test_merge_takes_late_and_far_apart_copies(spark):
    src = stream(spark, [[(100, "a", 1), (99, "a", 2)], [(3, "a", 1), (2, "b", 1)], [(900, "a", 2), (1, "a", 3), (901, "c", 1), (900, "c", 1)]])
    got = sm.merge_by_key(src, ["arm", "n"], "ts", scratch_path(spark, "out"), scratch_path(spark, "chk"))
    assert sorted((int((r.ts - T0).total_seconds() // 60), r.arm, r.n) for r in got.collect()) == [(1, "a", 3), (2, "b", 1), (99, "a", 2), (100, "a", 1), (900, "c", 1)]


def test_late_rows_reach_the_side_table(spark):
    path = scratch_path(spark, "late")
    sm.late_rows(stream(spark, [[(100, "a", 1)], [(95, "b", 1), (89, "c", 1)], [(200, "d", 1), (10, "e", 1)]]), "ts", path, scratch_path(spark, "chk"))
    assert sorted(r.arm for r in spark.read.parquet(f"{path}/late").collect()) == ["c", "e"]


def test_heartbeat_ends_only_stale_sessions(spark):
    src = stream(spark, [[(0, "x", 1), (4, "x", 2)], [(20, "y", 1)], [(60, "y", 2)], [(200, "z", 1)]])
    got = sorted((r.arm, r.beats) for r in drain(spark, sm.heartbeat_stream(src, "ts", ["arm"], "10 minutes")).collect())
    assert got == [("x", 2), ("y", 1), ("y", 1)]


def test_progress_eta(spark):
    src = stream(spark, [[(0, "ok", 1), (30, "ok", 2)], [(61, "bad", 3), (90, "ok", 4)]])
    s = sm.progress_stream(src, "ts", F.col("arm") == "ok", F.col("arm") == "bad")
    r = sm.progress_report(drain(spark, s, "complete"), 10).first()
    assert (r.done, r.failed, r.remaining) == (3, 1, 7)
    assert abs(r.recent_rate - 1 / 1800) < 1e-9 and abs(r.eta_seconds - 7 * 1800) < 1e-6


def test_barrier_needs_exact_keys(spark):
    expected = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], "m int, key int")
    ddl = "m int, arm string, key int"
    path = scratch_path(spark, "in")
    for rows in ([(1, "a", 1), (1, "a", 2), (1, "b", 2), (2, "a", 1)], [(1, "b", 1), (2, "b", 1), (2, "b", 1), (3, "a", 1), (3, "b", 2)]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)
    reported = sm.barrier_stream(src, "m", "arm", ["key"], scratch_path(spark, "out"), scratch_path(spark, "chk"))
    got = {r.m: r.released for r in sm.released(reported, expected, "m", "arm", 2, ["key"]).collect()}
    assert got == {1: True, 2: False, 3: False}
