"""Physical distance to a support mask, dilation, and margin sweeps.

The exact squared distance is separable. Two axes are done within a sheet of voxels (one k), the third within a block of
lines through the sheets. What is shuffled is one row of distances per sheet and block, not one per voxel. Along a line the least of the
parabolas that stand on its seeds is read off their lower envelope, in time linear in the line whatever the cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmeter.functions import salted_join
from voxelmeter.operators.masks import KEY, VOXEL, flagged, support_columns

SLACK = 1e-7
BLOCK_VOXELS = 1 << 17
_STACK = 1 << 20


def envelope(values: np.ndarray, pace: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each line, the least of ``values[q] + ((x - q) pace)^2`` at its positions ``at`` (rising); infinite values are no seeds.

    All lines take a step at once. A parabola enters the envelope of its line where it meets the last one, which goes if it is nowhere least any more.
    """
    out = np.full(at.shape, np.inf)
    lines = np.flatnonzero(np.isfinite(values).any(axis=1))
    values, pace, at = values[lines], pace[lines], at[lines]
    n, length = values.shape
    seed, begin, top = np.zeros((n, length), np.int64), np.full((n, length), -np.inf), np.full(n, -1)
    for q in range(length):
        rows = np.flatnonzero(np.isfinite(values[:, q]))
        front = np.full(n, -np.inf)
        open_ = rows[top[rows] >= 0]
        while len(open_):
            last = seed[open_, top[open_]]
            meet = (q + last) / 2 + (values[open_, q] - values[open_, last]) / (2 * pace[open_] ** 2 * (q - last))
            hidden = meet <= begin[open_, top[open_]]
            front[open_[~hidden]] = meet[~hidden]
            open_ = open_[hidden]
            top[open_] -= 1
            open_ = open_[top[open_] >= 0]
        top[rows] += 1
        seed[rows, top[rows]], begin[rows, top[rows]] = q, front[rows]
    place, every = np.zeros(n, np.int64), np.arange(n)
    best = np.full(at.shape, np.inf)
    for m in range(at.shape[1]):
        x = at[:, m]
        while len(ahead := np.flatnonzero((place < top) & (begin[every, np.minimum(place + 1, length - 1)] < x))):
            place[ahead] += 1
        own = seed[every, place]
        best[:, m] = values[every, own] + ((x - own) * pace) ** 2
    out[lines] = best
    return out


def _chunks(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of like size together, so that padded to the largest they hold about _STACK numbers."""
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * sizes[order[hi]] <= _STACK:
            hi += 1
        yield order[lo:hi]
        lo = hi


def _parts(batches: Iterator[pa.RecordBatch], seeds: str | None) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts whose ranges to fill (and ``seeds``) come to about _STACK numbers, or one larger row: memory does not grow with a batch."""
    for batch in batches:
        names = ["lo0", "hi0", "lo1", "hi1", *(["lo2", "hi2", "block", "wide"] if seeds is None else [])]
        lo0, hi0, lo1, hi1, *rest = (np.nan_to_num(x).astype(np.int64) for x in _numbers(batch, names))
        size = np.maximum(hi0 - lo0 + 1, 1) * np.maximum(hi1 - lo1 + 1, 1)
        if seeds is None:
            lo2, hi2, block, wide = rest
            size = np.clip(np.minimum(wide, hi0 - lo0 - block * wide + 1), 1, None) * np.maximum(hi1 - lo1 + 1, 1) * np.maximum(hi2 - lo2 + 1, 1)
        else:
            size = size + np.diff(batch.column(seeds).offsets.to_numpy())
        ends = np.append(0, np.cumsum(size))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _STACK // 4, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _numbers(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _span(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions from ``start`` on, one row for each, as many as the longest needs."""
    return start[:, None] + np.arange(int((end - start).max()) + 1)


def _sheet_distances(key: list[str], limit: float):
    """Rows of sheets with their seeds to rows (key, block, k, data): squared distances in the sheet, i by j, over the range to fill."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, "i"):
            lists = [batch.column(c) for c in ("i", "j")]
            first = lists[0].offsets.to_numpy().astype(np.int64)
            i, j = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            first = first - first[0]
            p0, p1, lo0, hi0, lo1, hi1, wide = _numbers(batch, ["p0", "p1", "lo0", "hi0", "lo1", "hi1", "wide"])
            si, sj = np.minimum.reduceat(i, first[:-1]), np.minimum.reduceat(j, first[:-1])
            ni, nj = np.maximum.reduceat(i, first[:-1]) - si + 1, np.maximum.reduceat(j, first[:-1]) - sj + 1
            for own in _chunks(np.maximum(ni, hi0 - lo0 + 1) * np.maximum(nj, hi1 - lo1 + 1)):
                count = np.diff(first)[own]
                row = np.repeat(np.arange(len(own)), count)
                take = np.repeat(first[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
                seeds = np.full((len(own), int(nj[own].max()), int(ni[own].max())), np.inf)
                seeds[row, j[take] - sj[own][row], i[take] - si[own][row]] = 0.0
                to = _span(lo0[own] - si[own], hi0[own] - si[own])
                along = envelope(seeds.reshape(-1, seeds.shape[2]), np.repeat(p0[own], seeds.shape[1]), np.repeat(to, seeds.shape[1], axis=0))
                along = np.where(along <= limit, along, np.inf).reshape(len(own), seeds.shape[1], -1).transpose(0, 2, 1)
                to = _span(lo1[own] - sj[own], hi1[own] - sj[own])
                sheet = envelope(along.reshape(-1, along.shape[2]), np.repeat(p1[own], along.shape[1]), np.repeat(to, along.shape[1], axis=0))
                sheet = np.where(sheet <= limit, sheet, np.inf).reshape(len(own), along.shape[1], -1)
                who, block, data = [], [], []
                for r, x in enumerate(own.tolist()):
                    mine = sheet[r, :hi0[x] - lo0[x] + 1, :hi1[x] - lo1[x] + 1]
                    for b in range(0, len(mine), int(wide[x])):
                        if np.isfinite(part := mine[b:b + int(wide[x])]).any():
                            who.append(x)
                            block.append(b // int(wide[x]))
                            data.append(part.tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(who, pa.int64())) for c in [*key, "k"]), pa.array(block, pa.int32()), pa.array(data, pa.binary())],
                                                 [*key, "k", "block", "data"])
    return run


def _block_distances(key: list[str], limit: float, asked: bool):
    """Blocks with their sheets to (key, i, j, k, d2): at the asked voxels (null beyond the limit), or at all voxels within the limit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, None):
            names = ["block", "p2", "lo0", "hi0", "lo1", "hi1", "lo2", "hi2", "wide"]
            block, p2, lo0, hi0, lo1, hi1, lo2, hi2, wide = (np.nan_to_num(x).astype(float if c == "p2" else np.int64) for c, x in zip(names, _numbers(batch, names), strict=True))
            sheets, asks = batch.column("sheets").to_pylist(), batch.column("asks") if asked else None
            with_sheets = np.array([bool(s) for s in sheets], bool)
            k0 = np.array([min(x["k"] for x in s) if s else 0 for s in sheets], np.int64)
            nk = np.array([max(x["k"] for x in s) if s else 0 for s in sheets], np.int64) - k0 + 1
            rows, cols = np.minimum(wide, hi0 - lo0 - block * wide + 1), hi1 - lo1 + 1
            at, got = [], []
            if asked:
                ends = asks.offsets.to_numpy().astype(np.int64)
                ends = ends - ends[0]
                flat = asks.flatten()
                ai, aj, ak = (flat.field(c).to_numpy().astype(np.int64) for c in ("i", "j", "k"))
                d2 = np.full(len(ai), np.inf)
            todo = np.flatnonzero(with_sheets)
            for part in _chunks((rows * cols * np.maximum(nk, hi2 - lo2 + 1))[todo]):
                own = todo[part]
                cells = rows[own] * cols[own]
                dense = np.full((len(own), int(nk[own].max()), int(cells.max())), np.inf)
                for r, x in enumerate(own.tolist()):
                    for s in sheets[x]:
                        dense[r, s["k"] - k0[x], :cells[r]] = np.frombuffer(s["data"])
                dense = dense.transpose(0, 2, 1)
                to = _span(lo2[own] - k0[own], hi2[own] - k0[own])
                found = envelope(dense.reshape(-1, dense.shape[2]), np.repeat(p2[own], dense.shape[1]), np.repeat(to, dense.shape[1], axis=0)).reshape(len(own), dense.shape[1], -1)
                for r, x in enumerate(own.tolist()):
                    mine = found[r, :cells[r], :hi2[x] - lo2[x] + 1]
                    if asked:
                        q = slice(ends[x], ends[x + 1])
                        inside = (aj[q] >= lo1[x]) & (aj[q] <= hi1[x]) & (ak[q] >= lo2[x]) & (ak[q] <= hi2[x])
                        cell = (ai[q] - lo0[x] - block[x] * wide[x]) * cols[x] + aj[q] - lo1[x]
                        d2[q] = np.where(inside, mine[np.where(inside, cell, 0), np.where(inside, ak[q] - lo2[x], 0)], np.inf)
                    else:
                        cell, k = np.nonzero(mine <= limit)
                        at.append(np.full(len(cell), x))
                        got.append((lo0[x] + block[x] * wide[x] + cell // cols[x], lo1[x] + cell % cols[x], lo2[x] + k, mine[cell, k]))
            if asked:
                rest = [pa.array(np.where(d2 <= limit, d2, np.nan), from_pandas=True), flat.field("box_mm")]
                who, place = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), (ai, aj, ak)
            elif at:
                who, (*place, d2) = np.concatenate(at), [np.concatenate(x) for x in zip(*got, strict=True)]
                rest = [pa.array(d2)]
            else:
                continue
            out = pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(who)) for c in key), *(pa.array(x, pa.int32()) for x in place), *rest],
                                             [*key, *VOXEL, "d2", *(["box_mm"] if asked else [])])
            for lo in range(0, out.num_rows, 100_000):
                yield out.slice(lo, 100_000)
    return run


def _nearest(seeds: DataFrame, frame: DataFrame, key: list[str], cap_mm: float, query: DataFrame | None = None) -> DataFrame:
    """Squared distance ``d2`` to the nearest seed, up to the cap: for each row of ``query`` (which brings ``box_mm``), or for all voxels in range.

    ``frame`` has for each key the paces ``p0..p2`` (mm per step), the range to fill ``lo0..hi2``, and ``wide``, the i-planes of a block.
    """
    limit = (cap_mm + 1e-6) ** 2
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seeds.select(*key).schema)
    reach = F.floor(F.lit(cap_mm + 1e-6) / F.col("p2")).cast("int")
    planes = seeds.groupBy(*key, "k").agg(F.collect_list("i").alias("i"), F.collect_list("j").alias("j")).join(frame, key)
    planes = planes.where(F.col("k").between(F.col("lo2") - reach, F.col("hi2") + reach))
    # The columns and types that both kinds of rows share.
    sheets = planes.mapInArrow(_sheet_distances(key, limit), f"{kinds}, k int, block int, data binary").groupBy(*key, "block").agg(F.collect_list(F.struct("k", "data")).alias("sheets"))
    if query is None:
        return sheets.join(frame, key).mapInArrow(_block_distances(key, limit, False), f"{kinds}, i int, j int, k int, d2 double")
    # A voxel beside every block, of a key without seeds for instance, goes to a group of its own i-plane.
    block = F.when(F.col("i").between(F.col("lo0"), F.col("hi0")), F.floor((F.col("i") - F.col("lo0")) / F.col("wide"))).otherwise(-1 - F.abs("i"))
    asks = query.withColumn("block", block.cast("int")).groupBy(*key, "block").agg(F.collect_list(F.struct(*VOXEL, "box_mm")).alias("asks"))
    both = asks.join(sheets, [*key, "block"], "left").join(frame, key, "left")
    return both.mapInArrow(_block_distances(key, limit, True), f"{kinds}, i int, j int, k int, d2 double, box_mm double")


def _paces(headers: DataFrame, *extra) -> DataFrame:
    return headers.select("case_id", *[F.col("spacing")[n].alias(f"p{n}") for n in range(3)], *extra)


def _box(voxels: DataFrame, key: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Inclusive range of a voxel set per axis."""
    return voxels.groupBy(*key).agg(*[f(a).cast("int").alias(f"{name}{n}") for n, a in enumerate(VOXEL) for f, name in ((F.min, lo), (F.max, hi))])


def _frame(support: DataFrame, key: list[str], headers: DataFrame, wanted: DataFrame, cap_mm: float) -> DataFrame:
    """Per key: paces, the support's box ``blo0..bhi2``, and the part ``lo0..hi2`` of the wanted range within the cap of it."""
    rows = _box(support, key, "blo", "bhi").join(wanted, key).join(_paces(headers), "case_id")
    near = []
    for n in range(3):
        reach = F.floor(F.lit(cap_mm + 1e-6) / F.col(f"p{n}")).cast("int")
        near += [F.greatest(f"wlo{n}", F.col(f"blo{n}") - reach).alias(f"lo{n}"), F.least(f"whi{n}", F.col(f"bhi{n}") + reach).alias(f"hi{n}")]
    rows = rows.select(*key, "p0", "p1", "p2", *[f"b{e}{n}" for n in range(3) for e in ("lo", "hi")], *near)
    lines = (F.col("hi1") - F.col("lo1") + 1) * (F.col("hi2") - F.col("lo2") + 1)
    return rows.withColumn("wide", F.greatest(F.floor(BLOCK_VOXELS / F.greatest(lines, F.lit(1))), F.lit(1)).cast("int"))


def _fits() -> F.Column:
    return (F.col("lo0") <= F.col("hi0")) & (F.col("lo1") <= F.col("hi1")) & (F.col("lo2") <= F.col("hi2"))


def support_distance(query: DataFrame, support: DataFrame, headers: DataFrame, cap_mm: float = 20.0,
                     key: list[str] | None = None) -> DataFrame:
    """C11: for each query voxel ``dist_mm`` to the support and ``box_mm`` to its bounding box.

    Distances are exact up to ``cap_mm`` and infinity beyond; an empty support gives
    infinity for both. ``key`` must start with ``case_id``.
    """
    key = key or ["case_id"]
    query = query.select(*key, *VOXEL).distinct()
    support = support.select(*key, *VOXEL)
    frame = _frame(support, key, headers, _box(query, key, "wlo", "whi"), cap_mm)
    gaps = [F.greatest(F.lit(0.0), (F.col(f"blo{n}") - F.col(a)) * F.col(f"p{n}"), (F.col(a) - F.col(f"bhi{n}")) * F.col(f"p{n}"))
            for n, a in enumerate(VOXEL)]
    far = F.lit(float("inf"))
    asked = salted_join(query, frame, key, VOXEL, "left").select(*key, *VOXEL, "lo0", F.when(_fits(), F.col("hi0")).alias("hi0"), "wide", F.when(
        F.col("blo0").isNotNull(), F.greatest(*gaps)).otherwise(far).alias("box_mm"))
    fill = frame.where(_fits()).select(*key, "p0", "p1", "p2", *[f"{e}{n}" for n in range(3) for e in ("lo", "hi")], "wide")
    near = _nearest(support, fill, key, cap_mm, asked)
    return near.select(*key, *VOXEL, F.coalesce(F.sqrt("d2"), far).alias("dist_mm"), "box_mm")


def dilate(mask: DataFrame, headers: DataFrame, mm: float, key: list[str] | None = None) -> DataFrame:
    """Every voxel of the grid within ``mm`` of the mask; 0 is the identity."""
    key = key or ["case_id"]
    mask = mask.select(*key, *VOXEL)
    if mm == 0:
        return mask.distinct()
    grid = [c for n in range(3) for c in (F.lit(0).alias(f"wlo{n}"), (F.col("shape")[n] - 1).cast("int").alias(f"whi{n}"))]
    wanted = mask.select(*key).distinct().join(headers.select("case_id", *grid), "case_id")
    frame = _frame(mask, key, headers, wanted, mm).where(_fits())
    grown = _nearest(mask, frame, key, mm).where(F.col("d2") <= F.lit((mm + SLACK) ** 2))
    return grown.select(*key, *VOXEL).union(mask).distinct()


def gate(pred: DataFrame, allowed: DataFrame) -> DataFrame:
    """Predicted voxels inside an allowed region of their case."""
    return pred.join(allowed.select("case_id", *VOXEL).distinct(), ["case_id", *VOXEL], "left_semi")


def margin_sweep(findings: DataFrame, pred: DataFrame, gt: DataFrame, routing: DataFrame, supports: DataFrame,
                 headers: DataFrame, margins: list[float], cap_mm: float | None = None) -> DataFrame:
    """Metrics for every (family, shape, margin) from one distance pass.

    ``routing`` has one ``(case_id, finding_id, family, scope)`` row per finding and family,
    with a null scope when the finding is unsupported; ``supports`` holds the voxels of
    ``(case_id, scope)``. Unsupported findings and empty supports keep the baseline.
    """
    cap = max(margins) if cap_mm is None else cap_mm
    voxels = flagged({"p": pred, "g": gt})
    base = voxels.groupBy(*KEY).agg(F.count_if(F.col("p") & F.col("g")).alias("tp0"), F.count_if("p").alias("p0"),
                                    F.count_if("g").alias("g0"))
    routed = salted_join(voxels, routing.where(F.col("scope").isNotNull()), KEY, VOXEL)
    dist = support_distance(routed.select("case_id", "scope", *VOXEL), supports, headers, cap, ["case_id", "scope"])
    rows = routed.join(dist, ["case_id", "scope", *VOXEL])
    aggs = []
    for shape, column in (("mask", "dist_mm"), ("bbox", "box_mm")):
        for n, margin in enumerate(margins):
            ok = F.col(column) <= F.lit(margin + SLACK)
            aggs += [F.count_if(F.col("p") & F.col("g") & ok).alias(f"tp_{shape}_{n}"),
                     F.count_if(F.col("p") & ok).alias(f"pn_{shape}_{n}"),
                     F.count_if(F.col("g") & ok).alias(f"gn_{shape}_{n}")]
    counts = rows.groupBy(*KEY, "family").agg(*aggs)
    present = supports.select("case_id", "scope").distinct().withColumn("available", F.lit(True))
    out = (findings.join(routing, KEY).join(base, KEY, "left").join(counts, [*KEY, "family"], "left")
           .join(present, ["case_id", "scope"], "left").fillna(0, ["tp0", "p0", "g0"]))
    variants = F.explode(F.array(*[
        F.struct(F.lit(shape).alias("shape"), F.lit(float(m)).alias("margin_mm"),
                 *[F.coalesce(F.col(f"{c}_{shape}_{n}"), F.lit(0)).alias(c) for c in ("tp", "pn", "gn")])
        for shape in ("mask", "bbox") for n, m in enumerate(margins)]))
    selected = F.col("scope").isNotNull() & F.coalesce(F.col("available"), F.lit(False))
    out = out.withColumn("v", variants).withColumn("selected", selected)
    pick = lambda c, b: F.when(F.col("selected"), F.col(f"v.{c}")).otherwise(F.col(b)).alias(c)
    out = out.select(*findings.columns, "family", "v.shape", "v.margin_mm", "selected", "tp0", "p0", "g0",
                     pick("tp", "tp0"), pick("pn", "p0"), pick("gn", "g0"))
    return out.select(*findings.columns, "family", "shape", "margin_mm", "selected", *support_columns())


