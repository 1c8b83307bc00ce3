"""Progress, journal, barrier and heartbeat streams (Structured Streaming).

J1 and J4 map a streaming DataFrame to another, with state bounded by a watermark of ten minutes unless said otherwise; rows
that come later go to a table of their own (:func:`late_rows`). J2 and J3 keep no state: each batch is merged into a table
by key, however late it comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELAY = "10 minutes"


def progress_stream(status: DataFrame, ts: str, done: Column, failed: Column, window: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Done and failed counts per time window."""
    return (status.select(F.col(ts).alias("ts"), done.cast("int").alias("d"), failed.cast("int").alias("f"))
            .withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"))
            .agg(F.sum("d").alias("done"), F.sum("f").alias("failed"), F.max("ts").alias("last_ts"), F.min("ts").alias("first_ts"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "done", "failed", "first_ts", "last_ts"))


def progress_report(windows: DataFrame, total: int) -> DataFrame:
    """Totals, average and recent rate and remaining seconds from the window counts.

    The recent rate is that of the last window; without progress there the average is used,
    and without any progress there is no estimate.
    """
    sec = lambda c: F.col(c).cast("double")
    row = windows.agg(F.sum("done").alias("done"), F.sum("failed").alias("failed"), F.min(sec("first_ts")).alias("t0"), F.max(sec("last_ts")).alias("t1"),
                      F.max_by("done", "window_start").alias("recent"), F.max_by(sec("window_start"), "window_start").alias("ws"))
    average = F.when((F.col("t1") > F.col("t0")) & (F.col("done") > 0), F.col("done") / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    recent = F.when((F.col("t1") > F.col("ws")) & (F.col("recent") > 0), F.col("recent") / (F.col("t1") - F.col("ws"))).otherwise(0.0)
    row = row.withColumn("average_rate", average).withColumn("recent_rate", recent)
    rate = F.when(F.col("recent_rate") > 0, F.col("recent_rate")).otherwise(F.col("average_rate"))
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0))
    return row.select("done", "failed", left.alias("remaining"), "average_rate", "recent_rate", F.when(rate > 0, left / rate).alias("eta_seconds"))


def late_rows(stream: DataFrame, ts: str, path: str, checkpoint: str, delay: str = DELAY) -> None:
    """Side table of rows that a watermark of ``delay`` lets go: those older than the newest row of former batches less the delay."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        seen = _batches(spark, f"{path}/seen", "newest timestamp", number).agg(F.max("newest")).first()[0]
        if seen is not None:
            late = batch.where(F.col(ts) < F.lit(seen) - F.expr(f"interval {delay}"))
            late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        batch.agg(F.max(ts).cast("timestamp").alias("newest")).write.mode("overwrite").parquet(f"{path}/seen/batch={number}")
    _run(stream, keep, checkpoint)


def _batches(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """What the batches before this one have written; a batch that is run again does not see itself."""
    try:
        return spark.read.schema(f"{schema}, batch bigint").parquet(path).where(F.col("batch") < before)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{schema}, batch bigint")


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def merge_by_key(stream: DataFrame, key: list[str], ts: str, path: str, checkpoint: str) -> DataFrame:
    """The first copy of every (arm, update) that arrived, however late and however far apart copies are.

    A batch appends the keys that the table lacks, to a folder of its own, so a batch that is run again after a failure writes
    the same rows again. Of copies in one batch, the one of least ``ts`` stays.
    """
    spark = stream.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)

    def merge(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        first = batch.groupBy(*key).agg(F.min(F.struct(ts, *[c for c in rest if c != ts])).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
        known = _batches(spark, path, schema, number).select(*key)
        first.join(known, key, "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")
    _run(stream, merge, checkpoint)
    return spark.read.schema(schema).parquet(path)


def barrier_stream(rows: DataFrame, milestone: str, arm: str, key: list[str], path: str, checkpoint: str) -> DataFrame:
    """(milestone, arm, key, times) as reported so far; each batch adds its own counts by key, and keeps no state."""
    names = [milestone, arm, *key]

    def count(batch: DataFrame, number: int) -> None:
        batch.groupBy(*names).agg(F.count(F.lit(1)).alias("times")).write.mode("overwrite").parquet(f"{path}/batch={number}")
    _run(rows, count, checkpoint)
    return rows.sparkSession.read.parquet(path).groupBy(*names).agg(F.sum("times").alias("times"))


def released(reported: DataFrame, expected: DataFrame, milestone: str, arm: str, arms: int, key: list[str]) -> DataFrame:
    """Milestones for which every arm reported exactly the expected keys, each once. Keys themselves are compared."""
    want = expected.select(milestone, *key).distinct().withColumn("__want", F.lit(1))
    sizes = want.groupBy(milestone).agg(F.count(F.lit(1)).alias("__size"))
    held = reported.join(want, [milestone, *key], "left").groupBy(milestone, arm).agg(
        F.count_if(F.col("__want").isNotNull() & (F.col("times") == 1)).alias("__good"), F.count(F.lit(1)).alias("__all"))
    same = (F.col("__good") == F.col("__size")) & (F.col("__all") == F.col("__size"))
    out = held.join(sizes, milestone).groupBy(milestone).agg(F.count(F.lit(1)).alias("arms_reported"), F.count_if(same).alias("arms_exact"))
    return out.withColumn("released", F.col("arms_exact") == arms)


def heartbeat_stream(beats: DataFrame, ts: str, who: list[str], ttl: str, delay: str = DELAY) -> DataFrame:
    """Sessions that ended because no beat came within ``ttl``; open sessions stay in state."""
    return (beats.withWatermark(ts, delay).groupBy(*who, F.session_window(ts, ttl).alias("w")).agg(F.count(F.lit(1)).alias("beats"), F.max(ts).alias("last_beat"))
            .select(*who, F.col("w.start").alias("started"), "last_beat", F.col("w.end").alias("expired"), "beats"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain the input once into Parquet and give the rows; ``complete`` keeps a folder per snapshot and gives the newest.

    The checkpoint makes a restart continue where the last finished batch ended; a snapshot that failed half-way has no success
    marker and is written again under the same name.
    """
    spark = stream.sparkSession
    if mode == "append":
        query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").format("parquet").option("path", path).start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()
        return spark.read.parquet(path)
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode).foreachBatch(
        lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    every = spark.read.parquet(path)
    newest = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == newest).drop("batch")
