"""A4: a Spark data source for stored score arrays, one ``.npy`` file per candidate and case with the findings on its first axis.

A file is cut into byte ranges, so that a large array is read by many tasks and none holds more than a chunk at a time. The files may lie
wherever Arrow's file systems reach: a local or mounted path, or a ``file``, ``hdfs``, ``s3`` or ``gs`` address.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PATTERN = r"([^/]+)/cases/([^/]+)\.npy$"
CHUNK_VOXELS = 1 << 16
SLICE_BYTES = 64 << 20
SCHEMA = "candidate_id string, case_id string, finding_id int, chunk int, offset long, shape array<int>, values array<float>"
_HEADER_BYTES = 1 << 16
BATCH_VOXELS, BATCH_ROWS = 1 << 18, 2_000  # of one batch: small chunks share it


def file_system(path: str):
    """The Arrow file system of a path or address, and the path within it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Slice(InputPartition):
    """Byte ranges ``(path, candidate, case, size, lo, hi)``; a chunk belongs to the range that holds its first byte."""

    ranges: list[tuple[str, str, str, int, int, int]]


def _array_header(raw: bytes, path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and place of the data."""
    stream = io.BytesIO(raw)
    version = np.lib.format.read_magic(stream)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if fortran or kind.kind != "f" or len(shape) < 2:
        raise ValueError(f"{path}: a C-ordered array of floats with findings on its first axis is wanted")
    return shape, kind, stream.tell()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of chunks as one batch."""
    *plain, values = zip(*rows, strict=True)
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
    ends = pa.array(np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32))
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(plain, kinds, strict=True)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values)))],
                                      ["candidate_id", "case_id", "finding_id", "chunk", "offset", "shape", "values"])


class ScoreArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", PATTERN)
        self.chunk, self.slice = int(options.get("chunk", CHUNK_VOXELS)), int(options.get("slicebytes", options.get("sliceBytes", SLICE_BYTES)))
        self.only = {c for c in options.get("candidates", "").split(",") if c}

    def partitions(self) -> list[InputPartition]:
        """Lists the files, without opening any: large ones in several ranges, small ones together. Files of other candidates are passed over."""
        from pyarrow import fs
        store, root = file_system(self.path)
        out, held, size = [], [], 0
        for info in sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            named = re.search(self.pattern, info.path)
            if not info.is_file or not named or self.only and named[1] not in self.only:
                continue
            for lo in range(0, info.size, self.slice):
                hi = min(info.size, lo + self.slice)
                if held and size + hi - lo > self.slice:
                    out.append(Slice(held))
                    held, size = [], 0
                held.append((info.path, named[1], named[2], info.size, lo, hi))
                size += hi - lo
        return [*out, Slice(held)] if held or not out else out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        rows, held = [], 0
        for path, candidate, case, size, lo, hi in getattr(partition, "ranges", []):
            with store.open_input_file(path) as file:
                shape, kind, front = _array_header(file.read(min(size, _HEADER_BYTES)), path)
                voxels = int(np.prod(shape[1:]))
                if front + shape[0] * voxels * kind.itemsize != size:
                    raise ValueError(f"{path}: {size} bytes do not hold an array of shape {shape}")
                for finding in range(shape[0]):
                    start = front + finding * voxels * kind.itemsize
                    step = self.chunk * kind.itemsize
                    first = max(0, -(-(lo - start) // step))
                    for chunk in range(first, -(-voxels // self.chunk)):
                        if start + chunk * step >= hi:
                            break
                        n = min(self.chunk, voxels - chunk * self.chunk)
                        file.seek(start + chunk * step)
                        values = np.frombuffer(file.read(n * kind.itemsize), kind).astype(np.float32)
                        if not np.isfinite(values).all():
                            raise ValueError(f"{path}: non-finite score in finding {finding}")
                        rows.append((candidate, case, finding, chunk, chunk * self.chunk, list(shape[1:]), values))
                        held += n
                        if held >= BATCH_VOXELS or len(rows) >= BATCH_ROWS:
                            yield _batch(rows)
                            rows, held = [], 0
        if rows:
            yield _batch(rows)


class ScoreArrays(DataSource):
    """``spark.read.format("score_arrays").load(path)``; options ``candidates`` (a comma list), ``chunk``, ``sliceBytes`` and ``pattern``."""

    @classmethod
    def name(cls) -> str:
        return "score_arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ScoreArrayReader(dict(self.options))


def read_score_arrays(spark: SparkSession, path: str, candidates: list[str] | None = None, chunk: int = CHUNK_VOXELS, slice_bytes: int = SLICE_BYTES,
                      pattern: str = PATTERN) -> DataFrame:
    """A4: chunks of all score arrays below ``path``, or of the named candidates only. Non-finite values and truncated files are errors.

    ``pattern`` finds candidate and case in a file's path, as its first two groups.
    """
    spark.dataSource.register(ScoreArrays)
    reader = spark.read.format("score_arrays").option("chunk", chunk).option("sliceBytes", slice_bytes).option("pattern", pattern)
    return (reader.option("candidates", ",".join(candidates)) if candidates else reader).load(path)


def array_shapes(chunks: DataFrame) -> DataFrame:
    """A4: per case and finding the number of candidates, and whether all have one shape and all its voxels."""
    each = chunks.groupBy("case_id", "finding_id", "candidate_id").agg(F.min("shape").alias("least"), F.max("shape").alias("most"), F.sum(F.size("values")).alias("voxels"))
    whole = F.aggregate("least", F.lit(1).cast("long"), lambda acc, n: acc * n) == F.col("voxels")
    return each.groupBy("case_id", "finding_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("voxels").alias("voxels"), ((F.min("least") == F.max("most")) & F.bool_and(whole)).alias("ok"))
