"""A3: volume files to a header table and a sparse voxel table.

Spark lists and splits the files; the only Python is the decoding of one file at a time
inside a task (single-file NIfTI-1, plain or gzip, per the public format).
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# NIfTI-1 datatype codes.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER_DDL = ("path string, shape array<int>, spacing array<double>, affine array<double>, dtype string, slope double, "
              "intercept double, axis_codes string")
VOXEL_DDL = "path string, channel int, i int, j int, k int, value double"
BATCH = 1_000_000
SHARED = 100_000
HEADER_BYTES = 352


def _header(raw: bytes) -> dict:
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", raw[:4])[0] != 348 or raw[344:348] not in (b"n+1\0", b"ni1\0"):
        raise ValueError("not a single-file NIfTI-1 volume")
    dim = struct.unpack(order + "8h", raw[40:56])
    code, = struct.unpack(order + "h", raw[70:72])
    pix = struct.unpack(order + "8f", raw[76:108])
    offset, slope, inter = struct.unpack(order + "3f", raw[108:120])
    _, sform = struct.unpack(order + "2h", raw[252:256])
    if sform > 0:
        affine = np.vstack([np.array(struct.unpack(order + "12f", raw[280:328]), float).reshape(3, 4), [0, 0, 0, 1]])
    else:
        affine = np.diag([*pix[1:4], 1.0])
    linear = affine[:3, :3]
    axes = np.abs(linear).argmax(axis=0)
    codes = "".join(("LR", "PA", "IS")[row][int(linear[row, col] > 0)] for col, row in enumerate(axes))
    return {"shape": [int(n) for n in dim[1:dim[0] + 1]], "spacing": np.sqrt((linear ** 2).sum(axis=0)).tolist(),
            "affine": affine.ravel().tolist(), "dtype": DTYPES[code], "order": order, "offset": int(offset),
            "slope": float(slope) if slope else 1.0, "intercept": float(inter) if slope else 0.0, "axis_codes": codes}


def _opened(content) -> io.BufferedIOBase:
    """The volume as a stream, inflated as it is read."""
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if bytes(content[:2]) == b"\x1f\x8b" else raw


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [{"path": p, **_header(_opened(c).read(HEADER_BYTES))} for p, c in zip(batch.path, batch.content)]
        yield pd.DataFrame(rows, columns=["path", "shape", "spacing", "affine", "dtype", "slope", "intercept", "axis_codes"])


def _frame(held: list[tuple]) -> pd.DataFrame:
    path, *rest = zip(*held, strict=True)
    columns = dict(zip(("channel", "i", "j", "k", "value"), (np.concatenate(x) for x in rest), strict=True))
    return pd.DataFrame({"path": np.repeat(np.array(path, object), [len(x) for x in rest[0]]), **columns})


def _voxels(channel_axis: str):
    """Slab by slab of the two first axes (three with the channel in front), so memory holds one slab and its voxels; small slabs share a batch."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size_held = [], 0
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                stream = _opened(content)
                first = stream.read(HEADER_BYTES)
                head = _header(first)
                stream.read(head["offset"] - len(first))
                shape, kind = head["shape"], np.dtype(head["order"] + head["dtype"])
                front = len(shape) == 4 and channel_axis != "last"
                slab, rest = shape[:3 if front else 2], shape[3 if front else 2:]
                size = int(np.prod(slab))
                for outer in range(int(np.prod(rest))):
                    flat = np.frombuffer(stream.read(size * kind.itemsize), kind, count=size)
                    hits = np.flatnonzero(flat)
                    inner = np.unravel_index(hits, slab, order="F")
                    outer_at = [np.full(len(hits), x) for x in np.unravel_index(outer, rest, order="F")]
                    axes = [*inner, *outer_at]
                    channel = axes[0] if front else axes[3] if len(shape) == 4 else np.zeros(len(hits), int)
                    i, j, k = axes[1:4] if front else axes[:3]
                    for start in range(0, len(hits), BATCH):
                        cut = slice(start, start + BATCH)
                        value = flat[hits[cut]].astype(float) * head["slope"] + head["intercept"]
                        held.append((path, channel[cut], i[cut], j[cut], k[cut], value))
                        size_held += len(value)
                        if size_held >= SHARED or len(held) >= SHARED // 16:
                            yield _frame(held)
                            held, size_held = [], 0
        if held:
            yield _frame(held)
    return decode


def decode_volumes(files: DataFrame, channel_axis: str = "first") -> tuple[DataFrame, DataFrame]:
    """A3: headers and non-background voxels of ``(path, content)`` rows."""
    files = files.select("path", "content")
    return files.mapInPandas(_headers, HEADER_DDL), files.mapInPandas(_voxels(channel_axis), VOXEL_DDL)


def read_volumes(spark: SparkSession, path: str, channel_axis: str = "first", pattern: str = r"([^/]+?)\.nii(\.gz)?$"
                 ) -> tuple[DataFrame, DataFrame]:
    """A3: the same for files below ``path``, with ``case_id`` taken from the file name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    headers, voxels = decode_volumes(files, channel_axis)
    case = F.regexp_extract("path", pattern, 1).alias("case_id")
    return (headers.select(case, *[c for c in headers.columns if c != "path"]),
            voxels.select(case, "channel", "i", "j", "k", "value"))
