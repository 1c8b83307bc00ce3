"""Write-once tables and results stored under the fingerprint of their recipe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmeter.operators.integrity import fingerprint


class ContentConflict(RuntimeError):
    """A stored result differs from the one about to be written."""


def _stored(spark: SparkSession, path: str) -> str | None:
    """Fingerprint of the newest finished result, or None."""
    try:
        row = spark.read.schema("fingerprint string, turn bigint").json(f"{path}/pointer").agg(F.max_by("fingerprint", "turn").alias("f"), F.max("turn").alias("t")).first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return row["f"]


def write_immutable(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "parquet") -> str:
    """``written``, ``unchanged`` or ``replaced``; other content under the path is an error.

    Rows go to a folder named by their fingerprint, and a line that points to it is appended last. A job that dies before that leaves
    the former result in place, and the next call writes again.
    """
    spark = df.sparkSession
    new = fingerprint(df).first()["fingerprint"]
    old = _stored(spark, path)
    if old == new:
        return "unchanged"
    if old is not None and not overwrite:
        raise ContentConflict(f"{path} holds other content")
    df.write.mode("overwrite").format(fmt).save(f"{path}/data-{new}")
    turn = 0 if old is None else spark.read.schema("fingerprint string, turn bigint").json(f"{path}/pointer").agg(F.max("turn")).first()[0] + 1
    spark.createDataFrame([(new, turn)], "fingerprint string, turn bigint").coalesce(1).write.mode("append").json(f"{path}/pointer")
    return "written" if old is None else "replaced"


def read_immutable(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Rows of the newest finished :func:`write_immutable` result."""
    mark = _stored(spark, path)
    if mark is None:
        raise FileNotFoundError(f"no finished result under {path}")
    return spark.read.format(fmt).load(f"{path}/data-{mark}")


def recipe_key(spark: SparkSession, recipe: str, *sources: DataFrame) -> str:
    """A10: one key for a recipe text and the content of its sources."""
    marks = [fingerprint(s).first()["fingerprint"] for s in sources]
    return spark.range(1).select(F.sha2(F.lit("|".join([recipe, *marks])), 256).alias("k")).first()["k"]


def cached(build: Callable[[], DataFrame], key: str, root: str, spark: SparkSession, verify: bool = False) -> DataFrame:
    """A10: stored result for ``key``, computed and stored on the first call.

    ``verify`` computes it again and fails when the stored rows differ.
    """
    path = f"{root.rstrip('/')}/fp={key}"
    if _stored(spark, path) is None or verify:
        write_immutable(build(), path)
    return read_immutable(spark, path)
