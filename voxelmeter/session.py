"""Session helpers: a shared scratch folder and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def build_session(app: str = "voxelmeter", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a fresh temporary folder; on a
    cluster an unset folder is an error rather than a machine-local guess.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below :func:`shared_dir`."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, shuffled: bool = True) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back.

    A written table survives lost executors like a reliable checkpoint does and is computed
    once. Joins with a ``shuffled`` one do not broadcast it by its size unless told to: its files
    are compressed to a small part of what its rows take in memory.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out = out.hint("merge") if shuffled else out
    out._cut_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a :func:`checkpointed` frame that nothing will read again, such as the last round of a loop."""
    path = getattr(df, "_cut_path", None)
    if path is not None:
        session = df.sparkSession
        where = session._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(session._jsc.hadoopConfiguration()).delete(where, True)
