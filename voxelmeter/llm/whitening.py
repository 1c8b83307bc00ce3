"""Whitening of embeddings from exact cross-products of bit-sliced vectors, with DataFrame functions alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmeter.llm.exact_search import finite
from voxelmeter.llm.io import checkpointed
from voxelmeter.llm.sanitisation import let

SCALE = 1024
COMPONENTS = 8
PLANES = 6  # planes of one slice: few enough that the popcounts of two slices are one compiled method
_LARGEST = 1 << 50
_LEAST_SHARE = 1e-12


def _sums(rows: DataFrame) -> tuple[int, list[int], list[int], list[int]]:
    """Number of vectors; sum, least and largest of each dimension."""
    each = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(
        F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("d").collect()
    return each[0]["n"], [int(r["s"]) for r in each], [r["lo"] for r in each], [r["hi"] for r in each]


def cross_products(rows: DataFrame, least: list[int], most: list[int]) -> dict[tuple[int, int], int]:
    """Sums over all rows of (x_d - least_d) (x_e - least_e), d <= e, exactly.

    Rows are numbered within their partition, 64 to a block. Bit b of dimension d of a block's rows is one word, a plane.
    The product of two dimensions is the sum over pairs of planes a, b of 2^(a+b) popcount(plane_a & plane_b).
    """
    slices = max(1, -(-max((h - m).bit_length() for h, m in zip(most, least, strict=True)) // PLANES))
    place = F.monotonically_increasing_id()
    lanes = rows.select(F.shiftright(place, 6).alias("block"), place.bitwiseAND(63).cast("int").alias("lane"), "x").select("block", "lane", F.posexplode("x").alias("d", "v"))
    lanes = lanes.withColumn("v", F.col("v") - F.get(F.array(*(F.lit(m).cast("long") for m in least)), F.col("d")))
    words = lanes.groupBy("block", "d").agg(*(F.bit_or(F.expr(f"shiftleft(shiftright(v, {b}) & 1L, lane)")).alias(f"w{b}") for b in range(slices * PLANES)))
    cut = F.array(*(F.struct((F.col("d") * slices + s).alias("u"), *(F.col(f"w{s * PLANES + b}").alias(f"p{b}") for b in range(PLANES))) for s in range(slices)))
    blocks = words.groupBy("block").agg(F.flatten(F.collect_list(cut)).alias("units"))
    pairs = blocks.select("units", F.explode("units").alias("a")).select("a", F.explode("units").alias("b")).where("a.u <= b.u")
    ones = sum((F.bit_count(F.col(f"a.p{i}").bitwiseAND(F.col(f"b.p{j}"))).cast("long") * (1 << (i + j)) for i in range(PLANES) for j in range(PLANES)), F.lit(0).cast("long"))
    out: dict[tuple[int, int], int] = {}
    # One short row for each pair of dimensions and slices, however many vectors there are.
    for r in pairs.groupBy(F.col("a.u").alias("a"), F.col("b.u").alias("b")).agg(F.sum(ones).alias("n")).toLocalIterator():
        (d, i), (e, j) = divmod(r["a"], slices), divmod(r["b"], slices)
        out[d, e] = out.get((d, e), 0) + (r["n"] << PLANES * (i + j)) * (2 if d == e and i != j else 1)
    return out


def _weighted(values: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(values, F.array(*(F.lit(float(w)) for w in weights)), lambda v, w: v * w), F.lit(0.0), lambda acc, v: acc + v)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component, the largest eigenvalues first.

    Entries c become x = floor(1024 c) + 100000; the constant cancels wherever x is centred, so it is left out. Cross-products are exact integers,
    centred as integers: n^2 V = n sum(x_d x_e) - S_d S_e. Only this matrix, of the dimensions, goes to the driver for its eigenvectors. ``deviation`` is the sum of (n x - S)^2; ``identity_error`` is measured on the
    whitened vectors of all rows.

    Rows whose vector is null, empty, or holds null or non-finite entries give no rows, nor do vectors of another length than most (the longer
    of equally frequent ones). Every other row counts, also those that repeat or lack a vec_id. Components that hold no share of the variance (1e-12 of the trace) are
    left out, so equal vectors, or a single one, give no rows. A deviation beyond 64 bits is null; entries of 2^40 and more are an error.
    """
    vector = F.col("embedding")
    fit = embeddings.where(finite(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double"))).alias("x"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = checkpointed(fit)
    size = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    dims = size["d"]
    fit = fit.where(F.size("x") == dims)
    n, sums, least, most = _sums(fit)
    if max(map(abs, (*least, *most))) >= _LARGEST:
        raise ValueError("an entry is too large for exact cross-products")
    found, front = cross_products(fit, least, most), [s - n * m for s, m in zip(sums, least, strict=True)]
    centred = [[n * found[min(d, e), max(d, e)] - front[d] * front[e] for e in range(dims)] for d in range(dims)]
    value, basis = np.linalg.eigh(np.array([[c / (n * n) for c in row] for row in centred]))
    trace = sum(centred[d][d] for d in range(dims)) / (n * n)
    keep = [k for k in np.argsort(-value, kind="stable")[:components].tolist() if value[k] > _LEAST_SHARE * trace and value[k] > 0]
    if not keep:
        return embeddings.sparkSession.createDataFrame([], schema)
    whole = F.array(*(F.lit(s).cast("long") for s in sums))
    means = F.array(*(F.lit(s / n) for s in sums))
    off = F.zip_with("x", means, lambda v, m: v.cast("double") - m)
    squares = F.aggregate(off, F.lit(0.0), lambda acc, v: acc + v * v) * (float(n) * n)
    exact = F.aggregate(F.zip_with("x", whole, lambda v, s: (v * n - s) * (v * n - s)), F.lit(0).cast("long"), lambda acc, v: acc + v)
    # Every square is at most the sum, so where that fits a long nothing on the way there passes it.
    deviation = F.when(squares < 9.2e18, exact)
    white = let(off, lambda c: F.array(*(_weighted(c, (basis[:, k] / np.sqrt(value[k])).tolist()) for k in keep)))
    done = checkpointed(fit.select("vec_id", deviation.alias("deviation"), white.alias("white")))
    pairs = [(i, j) for i in range(len(keep)) for j in range(i, len(keep))]
    got = done.agg(*(F.covar_pop(F.get("white", F.lit(i)), F.get("white", F.lit(j))) for i, j in pairs)).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(got, pairs, strict=True))
    share = F.array(*(F.lit(float(value[k] / trace)) for k in keep))
    return done.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"))
