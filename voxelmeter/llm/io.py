"""Reading of the given tables and of intermediate results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmeter import session
from voxelmeter.session import release


BATCH_ROWS = 2000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table. Arrow batches of the session hold at most BATCH_ROWS rows from then on, so whole texts fit small Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """A written table whose joins are planned by its size."""
    return session.checkpointed(df, shuffled=False)


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32 of the id as text is 2 modulo 4 are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


__all__ = ["checkpointed", "held_out", "read", "release"]
