"""Boxes, projections, resampling, intensities, tiles and proposals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmeter.functions import exact_quantiles, ratio, salted_join
from voxelmeter.operators.masks import KEY, VOXEL
from voxelmeter.session import checkpointed, release

LOW = ["i_lo", "j_lo", "k_lo"]
HIGH = ["i_hi", "j_hi", "k_hi"]


# ------------------------------------------------------------------ C17 boxes

def bbox(voxels: DataFrame, key: list[str] = KEY) -> DataFrame:
    """C17: inclusive bounds of every non-empty mask."""
    return voxels.groupBy(*key).agg(*[F.min(a).alias(lo) for a, lo in zip(VOXEL, LOW)],
                                    *[F.max(a).alias(hi) for a, hi in zip(VOXEL, HIGH)])


def bbox_deficits(outer: DataFrame, inner: DataFrame, on: list[str]) -> DataFrame:
    """C17: how far ``inner`` leaves ``outer`` in each of six directions.

    ``expansion`` is the isotropic growth that would make ``outer`` contain ``inner``.
    """
    renamed = outer.select(*on, *[F.col(c).alias(f"o_{c}") for c in LOW + HIGH])
    rows = salted_join(inner, renamed, on, [c for c in inner.columns if c not in LOW + HIGH])
    zero = F.lit(0)
    short = [F.greatest(zero, F.col(f"o_{c}") - F.col(c)).alias(f"deficit_{c}") for c in LOW]
    long = [F.greatest(zero, F.col(c) - F.col(f"o_{c}")).alias(f"deficit_{c}") for c in HIGH]
    out = rows.select(*inner.columns, *short, *long)
    most = F.greatest(*[F.col(f"deficit_{c}") for c in LOW + HIGH])
    return out.withColumn("expansion", most).withColumn("contained", most == 0)


def expand_bbox(boxes: DataFrame, headers: DataFrame, expansion: int) -> DataFrame:
    """C17: grow boxes on all sides and clip them to the grid."""
    rows = salted_join(boxes, headers.select("case_id", "shape"), ["case_id"], LOW)
    grown = [F.greatest(F.lit(0), F.col(c) - expansion).alias(c) for c in LOW]
    grown += [F.least(F.col("shape")[n] - 1, F.col(c) + expansion).alias(c) for n, c in enumerate(HIGH)]
    return rows.select(*[c for c in boxes.columns if c not in LOW + HIGH], *grown)


# ------------------------------------------------------------------ C18 projections

def project_values(voxels: DataFrame, axis: str, how: str, centre: float, width: float,
                   key: list[str] | None = None) -> DataFrame:
    """Mean or 75th percentile along an axis after an intensity window.

    One ray is bounded by the volume depth, so the exact ``percentile`` buffer is small.
    """
    key = key or ["case_id"]
    low = centre - width / 2
    value = (F.least(F.greatest(F.col("value"), F.lit(low)), F.lit(low + width)) - low) / width
    keep = [a for a in VOXEL if a != axis]
    agg = {"mean": F.avg("w"), "p75": F.percentile("w", F.lit(0.75))}[how]
    return voxels.select(*key, *keep, value.alias("w")).groupBy(*key, *keep).agg(agg.alias("projected"))


def project_errors(flags: DataFrame, axis: str, key: list[str] = KEY) -> DataFrame:
    """Class of every ray that meets a mask; a true positive anywhere wins.

    ``flags`` is :func:`voxelmeter.operators.masks.flagged` with ``p`` and ``g``.
    """
    keep = [a for a in VOXEL if a != axis]
    p, g = F.col("p"), F.col("g")
    rays = flags.groupBy(*key, *keep).agg(F.max(p & g).alias("tp"), F.max(p & ~g).alias("fp"), F.max(~p & g).alias("fn"))
    name = (F.when(F.col("tp"), "tp").when(F.col("fp") & F.col("fn"), "depth_mismatch")
            .when(F.col("fp"), "fp").otherwise("fn"))
    return rays.select(*key, *keep, name.alias("error_class"))


# ------------------------------------------------------------------ C19 resampling

def with_output_shape(headers: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """Grid size at a target spacing, ``max(1, round_half_even(n * from / to))`` per axis."""
    size = lambda n: F.greatest(F.lit(1), F.bround(F.col("shape")[n] * F.col("spacing")[n] / F.lit(spacing[n]), 0)
                                .cast("int"))
    return headers.withColumn("out_shape", F.array(*[size(n) for n in range(3)]))


def resample_mask(voxels: DataFrame, headers: DataFrame, spacing: tuple[float, float, float],
                  key: list[str] = KEY) -> DataFrame:
    """Nearest-exact resampling; a target that would vanish is splatted by voxel centre."""
    grid = with_output_shape(headers, spacing).select("case_id", "shape", "out_shape")
    rows = salted_join(voxels.select(*key, *VOXEL), grid, ["case_id"], VOXEL)
    for n, a in enumerate(VOXEL):
        size, out = F.col("shape")[n], F.col("out_shape")[n]
        first = F.floor(F.col(a) * out / size - 0.5).cast("int")
        last = F.ceil((F.col(a) + 1) * out / size).cast("int")
        source = F.floor((F.col("o") + 0.5) * size / out)
        rows = (rows.withColumn("o", F.explode(F.sequence(F.greatest(F.lit(0), first), F.greatest(F.lit(0), last))))
                .withColumn(f"{a}_hit", (source == F.col(a)) & (F.col("o") < out))
                .where(F.col(f"{a}_hit")).withColumnRenamed("o", f"o{a}").drop(f"{a}_hit"))
    direct = rows.select(*key, *[F.col(f"o{a}").alias(a) for a in VOXEL]).distinct()
    kept = direct.select(*key).distinct()
    lost = voxels.select(*key, *VOXEL).join(kept, key, "left_anti")
    lost = salted_join(lost, grid, ["case_id"], VOXEL)
    centre = [F.least(F.floor((F.col(a) + 0.5) * F.col("out_shape")[n] / F.col("shape")[n]).cast("int"),
                      F.col("out_shape")[n] - 1).alias(a) for n, a in enumerate(VOXEL)]
    splat = lost.select(*key, *centre).distinct()
    return direct.withColumn("fallback", F.lit(False)).union(splat.withColumn("fallback", F.lit(True)))


def resample_image(voxels: DataFrame, headers: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """Trilinear resampling (corners not aligned), two axes and then the third.

    Each source voxel sends its weighted value to the outputs whose two taps include it;
    missing source voxels count as 0. Voxels are shuffled by plane, where two axes are done; what is left of a plane goes to the third.
    """
    grid = with_output_shape(headers, spacing)
    grid = grid.select("case_id", *[F.col(c)[n].alias(f"__{c}{n}") for c in ("shape", "out_shape") for n in range(3)])
    planes = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("__shape2") - 1)))

    def taps(rows: DataFrame, n: int, a: str) -> DataFrame:
        """A row for each output along the axis that the voxel counts for, with its place ``o`` and the weighted value."""
        size, out = F.col(f"__shape{n}"), F.col(f"__out_shape{n}")
        first = F.floor((F.col(a) - 0.5) * out / size - 1).cast("int")
        last = F.ceil((F.col(a) + 1.5) * out / size).cast("int")
        lo = F.when(F.col(a) == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), first))
        hi = F.when(F.col(a) == size - 1, out - 1).otherwise(F.least(out - 1, last))
        place = F.greatest(F.lit(0.0), (F.col("o") + 0.5) * size / out - 0.5)
        base = F.floor(place)
        frac = place - base
        upper = F.least(base + 1, size - 1)
        weight = (F.when(base == F.col(a), 1 - frac).otherwise(0.0)
                  + F.when(upper == F.col(a), frac).otherwise(0.0))
        rows = rows.where(lo <= hi).withColumn("o", F.explode(F.sequence(lo, hi))).withColumn("w", weight).where(F.col("w") > 0)
        return rows.withColumn("value", F.col("w") * F.col("value")).drop(a, "w").withColumnRenamed("o", a)

    ends = ["__shape2", "__out_shape2"]
    rows = voxels.select("case_id", *VOXEL, "value").join(planes.hint("shuffle_hash"), ["case_id", "k"])
    flat = taps(taps(rows, 0, "i"), 1, "j").groupBy("case_id", "k", "i", "j").agg(F.sum("value").alias("value"), *[F.max(c).alias(c) for c in ends])
    return taps(flat, 2, "k").groupBy("case_id", *VOXEL).agg(F.sum("value").alias("value"))


# ------------------------------------------------------------------ C20-C21 intensities

def normalise(voxels: DataFrame, how: str, centre: float = -600.0, width: float = 1500.0,
              clip: float = 1024.0) -> DataFrame:
    """C20: crop to the non-zero box, then ``zscore``, ``clip_zscore``, ``clip_linear`` or ``window``."""
    box = bbox(voxels.where("value <> 0"), ["case_id"])
    rows = salted_join(voxels, box, ["case_id"], VOXEL)
    inside = reduce(lambda x, y: x & y, [F.col(a).between(F.col(lo), F.col(hi)) for a, lo, hi in zip(VOXEL, LOW, HIGH)])
    rows = rows.where(inside).drop(*LOW, *HIGH)
    clipped = F.least(F.greatest(F.col("value"), F.lit(-clip)), F.lit(clip))
    if how == "clip_linear":
        return rows.withColumn("value", clipped / clip)
    if how == "window":
        low = centre - width / 2
        return rows.withColumn("value", (F.least(F.greatest("value", F.lit(low)), F.lit(low + width)) - low) / width)
    if how == "clip_zscore":
        rows = rows.withColumn("value", clipped)
    elif how != "zscore":
        raise ValueError(f"unknown normalisation {how!r}")
    stats = rows.groupBy("case_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    rows = salted_join(rows, stats, ["case_id"], VOXEL)
    return rows.withColumn("value", (F.col("value") - F.col("m")) / F.greatest(F.col("s"), F.lit(1e-8))).drop("m", "s")


def value_profile(findings: DataFrame, voxels: DataFrame, mask: DataFrame,
                  cuts: dict[str, tuple[str, float]]) -> DataFrame:
    """Distribution of image values under a mask per finding, per category and overall.

    ``cuts`` maps a column name to ("below" | "above", value). All scopes are voxel-weighted.
    """
    rows = mask.select(*KEY, *VOXEL).join(voxels.select("case_id", *VOXEL, "value").hint("merge"), ["case_id", *VOXEL])  # a grid is never broadcast
    counted = rows.groupBy(*KEY, "value").agg(F.count(F.lit(1)).alias("n"))
    counted = salted_join(counted, findings.select(*KEY, "category"), KEY, ["value"])
    scopes = F.explode(F.array(
        F.struct(F.lit("finding").alias("scope"), F.concat_ws(":", *KEY).alias("member")),
        F.struct(F.lit("category").alias("scope"), F.col("category").alias("member")),
        F.struct(F.lit("all").alias("scope"), F.lit("all").alias("member"))))
    by = ["scope", "member"]
    tagged = (counted.select(scopes.alias("s"), "value", "n").groupBy("s.scope", "s.member", "value")
              .agg(F.sum("n").alias("n")))
    n, v = F.col("n"), F.col("value")
    share = lambda side, cut: F.sum(F.when(v < cut if side == "below" else v > cut, n).otherwise(0)) / F.sum(n)
    base = tagged.groupBy(*by).agg(
        F.sum("n").alias("voxels"), (F.sum(n * v) / F.sum(n)).alias("mean"), (F.sum(n * v * v) / F.sum(n)).alias("__sq"),
        *[share(side, cut).alias(name) for name, (side, cut) in cuts.items()])
    base = base.withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.col("__sq") - F.col("mean") ** 2))).drop("__sq")
    qs = exact_quantiles(tagged, by, "value", {"p5": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95}, weight=n)
    return base.join(qs, by)


# ------------------------------------------------------------------ C22 points

def positive_points(voxels: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The voxel nearest the box centre, then the two extremes of each axis.

    Ties go to the first voxel in C order; repeated points are dropped, first kept.
    """
    box = bbox(voxels, key)
    rows = salted_join(voxels.select(*key, *VOXEL), box, key, VOXEL)
    point = F.struct(*[F.col(a).cast("int").alias(a) for a in VOXEL])
    d2 = sum((F.pow(F.col(a) - (F.col(lo) + F.col(hi)) / 2.0, F.lit(2.0)) for a, lo, hi in zip(VOXEL, LOW, HIGH)), F.lit(0.0))
    back = [-F.col(a) for a in VOXEL]
    picks = [F.min_by(point, F.struct(d2, *[F.col(a) for a in VOXEL]))]
    for a in VOXEL:
        picks.append(F.min_by(point, F.struct(F.col(a).alias("v"), *[F.col(x) for x in VOXEL])))
        picks.append(F.max_by(point, F.struct(F.col(a).alias("v"), *back)))
    out = rows.groupBy(*key).agg(*[p.alias(f"p{n}") for n, p in enumerate(picks)])
    points = F.array_distinct(F.array(*[F.col(f"p{n}") for n in range(7)]))
    return out.select(*key, F.posexplode(points).alias("rank", "p")).select(*key, "rank", "p.*")


# ------------------------------------------------------------------ C23 tiles

def axis_starts(n, size: int, overlap: float) -> F.Column:
    """Evenly spread tile starts on one axis; an axis smaller than the tile is centred."""
    n = F.col(n) if isinstance(n, str) else n
    count = F.ceil((n - size) / F.lit(size * (1 - overlap))).cast("int") + 1
    spread = F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.greatest(count, F.lit(2)) - 1),
        lambda t: F.bround(t * (n - size) / F.greatest(count - 1, F.lit(1)), 0).cast("int")))
    return F.when(n <= size, F.array(F.floor((n - F.lit(size)) / 2.0).cast("int"))).otherwise(spread)


def with_starts(headers: DataFrame, size: tuple[int, int, int], overlap: float) -> DataFrame:
    """Header rows with the array of tile starts on each axis."""
    return headers.select("case_id", "shape", *[
        axis_starts(F.col("shape")[n], size[n], overlap).alias(f"s{a}") for n, a in enumerate(VOXEL)])


def _starts_over(axis: str, size: int) -> F.Column:
    """Starts of the tiles that hold this voxel on one axis."""
    return F.filter(f"s{axis}", lambda s: (s <= F.col(axis)) & (F.col(axis) < s + size))


def _clipped_ends(axis: str, n: int, size: int) -> F.Column:
    return F.transform(f"s{axis}", lambda s: F.least(s + size, F.col("shape")[n]))


def _between(edges: str, lo: F.Column, hi: F.Column) -> F.Column:
    return F.filter(edges, lambda e: (e >= lo) & (e < hi))


def _next_edge(axis: str) -> F.Column:
    return F.array_min(F.filter(f"e{axis}", lambda e: e > F.col(f"c{axis}")))


def tiles(headers: DataFrame, size: tuple[int, int, int], overlap: float = 0.5) -> DataFrame:
    """One row per tile with its start per axis."""
    out = with_starts(headers, size, overlap)
    for a in VOXEL:
        out = out.withColumn(f"t{a}", F.explode(f"s{a}"))
    return out.select("case_id", *[f"t{a}" for a in VOXEL])


def tile_counts(flags: DataFrame, headers: DataFrame, size: tuple[int, int, int], overlap: float = 0.5) -> DataFrame:
    """Tp and fp per (finding, tile) with any voxel; ``flags`` has ``p`` and ``g``.

    The tiles over a voxel follow from the starts of its case, so no range join is needed.
    """
    starts = with_starts(headers, size, overlap).drop("shape")
    rows = salted_join(flags, starts, ["case_id"], VOXEL)
    for n, a in enumerate(VOXEL):
        rows = rows.withColumn(f"t{a}", F.explode(_starts_over(a, size[n]))).drop(f"s{a}")
    p, g = F.col("p"), F.col("g")
    return rows.groupBy(*KEY, *[f"t{a}" for a in VOXEL]).agg(
        F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(g).alias("gt"),
        (F.count_if(p) > 0).alias("active"))


def tile_coverage(findings: DataFrame, flags: DataFrame, headers: DataFrame, size: tuple[int, int, int],
                  overlap: float = 0.5) -> DataFrame:
    """Volume and truth covered by the union of the active tiles of each finding.

    The union is measured on the grid of box edges of the case, so a box only emits the
    compressed cells it covers.
    """
    counts = tile_counts(flags, headers, size, overlap)
    active = counts.where("active").select(*KEY, *[f"t{a}" for a in VOXEL])
    grid = with_starts(headers, size, overlap)
    cuts = []
    for n, a in enumerate(VOXEL):
        dim = F.col("shape")[n]
        lows = F.transform(f"s{a}", lambda s: F.greatest(s, F.lit(0)))
        highs = _clipped_ends(a, n, size[n])
        cuts.append(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), dim), lows, highs))).alias(f"e{a}"))
    edges = grid.select("case_id", "shape", *cuts)
    cells = salted_join(active, edges, ["case_id"], [f"t{a}" for a in VOXEL])
    volume = F.lit(1)
    for n, a in enumerate(VOXEL):
        lo = F.greatest(F.col(f"t{a}"), F.lit(0))
        hi = F.least(F.col(f"t{a}") + size[n], F.col("shape")[n])
        cells = cells.withColumn(f"c{a}", F.explode(_between(f"e{a}", lo, hi)))
        cells = cells.withColumn(f"w{a}", _next_edge(a) - F.col(f"c{a}"))
        volume = volume * F.col(f"w{a}")
    covered = (cells.select(*KEY, *[f"c{a}" for a in VOXEL], *[f"w{a}" for a in VOXEL]).distinct()
               .groupBy(*KEY).agg(F.sum(volume).alias("covered_volume")))
    truth = flags.where("g").select(*KEY, *VOXEL)
    starts = grid.drop("shape")
    reach = salted_join(truth, starts, ["case_id"], VOXEL)
    for n, a in enumerate(VOXEL):
        reach = reach.withColumn(f"t{a}", F.explode(_starts_over(a, size[n]))).drop(f"s{a}")
    reach = (reach.join(active.withColumn("on", F.lit(True)), [*KEY, *[f"t{a}" for a in VOXEL]], "left")
             .groupBy(*KEY, *VOXEL).agg(F.max(F.col("on").isNotNull()).alias("on"))
             .groupBy(*KEY).agg(F.count(F.lit(1)).alias("gt_voxels"), F.count_if("on").alias("reachable_gt")))
    seen = counts.groupBy(*KEY).agg(F.count_if("active").alias("active_tiles"),
                                    F.count_if(~F.col("active") & (F.col("gt") > 0)).alias("inactive_tiles_with_gt"))
    total = grid.select("case_id", (F.size("si") * F.size("sj") * F.size("sk")).alias("tiles"),
                        F.aggregate("shape", F.lit(1), lambda x, n: x * n).alias("volume"))
    names = ["covered_volume", "gt_voxels", "reachable_gt", "active_tiles", "inactive_tiles_with_gt"]
    out = findings.select(*KEY)
    for part in (covered, reach, seen):
        out = out.join(part, KEY, "left")
    out = salted_join(out.fillna(0, names), total, ["case_id"], ["finding_id"])
    return out.select(*KEY, "tiles", "volume", *names,
                      ratio("covered_volume", "volume").alias("covered_fraction"),
                      ratio("reachable_gt", "gt_voxels").alias("reachable_fraction"))


# ------------------------------------------------------------------ C24-C25 proposals

def topk_nms(scores: DataFrame, headers: DataFrame, k: int, radius: int, patch: tuple[int, int, int],
             key: list[str] = KEY, max_attempts: int | None = None) -> DataFrame:
    """The k best peaks per key, each suppressing a box of ``radius`` voxels around it.

    Greedy by score, then C order. A peak whose clipped patch start was already proposed
    suppresses its box but is not kept. One distributed arg-max per attempt: the state is
    one short row of peaks per key, cut with a checkpoint, and scores are never grouped
    into one task. Runs until each key is done or out of scores; a ``max_attempts`` that
    does not suffice is an error, never a shorter result.
    """
    best = F.max_by(F.struct(*VOXEL, "score"), F.struct("score", *[-F.col(a) for a in VOXEL]))
    peak_type = "array<struct<i:int,j:int,k:int,score:double>>"
    shape = headers.select("case_id", "shape")
    pool = scores.select(*key, *[F.col(a).cast("int").alias(a) for a in VOXEL], F.col("score").cast("double").alias("score"))
    start_of = lambda p: F.struct(*[
        F.greatest(F.lit(0), F.least(p[a] - patch[n] // 2, F.greatest(F.lit(0), F.col("shape")[n] - patch[n]))).alias(a)
        for n, a in enumerate(VOXEL)])
    state = checkpointed(salted_join(pool.select(*key).distinct(), shape, ["case_id"], key).select(
        *key, "shape", F.lit(None).cast(peak_type).alias("peaks"), F.lit(None).cast(peak_type).alias("kept"),
        F.lit(False).alias("done")))
    state = state.fillna(False).withColumn("peaks", F.coalesce("peaks", F.array().cast(peak_type))).withColumn(
        "kept", F.coalesce("kept", F.array().cast(peak_type)))
    attempts = 0
    while True:
        attempts += 1
        if max_attempts is not None and attempts > max_attempts:
            raise RuntimeError(f"peaks not settled in {max_attempts} attempts")
        open_rows = state.where(~F.col("done")).select(*key, "peaks")
        near = lambda p: reduce(lambda x, y: x & y, [F.abs(p[a] - F.col(a)) <= radius for a in VOXEL])
        live = salted_join(pool, open_rows, key, VOXEL).where(~F.exists("peaks", near))
        found = live.groupBy(*key).agg(best.alias("next"))
        step = state.join(found, key, "left")
        fresh = F.col("next").isNotNull() & ~F.exists(
            "kept", lambda p: start_of(p) == start_of(F.col("next")))
        kept = F.when(fresh, F.concat("kept", F.array("next"))).otherwise(F.col("kept"))
        peaks = F.when(F.col("next").isNotNull(), F.concat("peaks", F.array("next"))).otherwise(F.col("peaks"))
        before, state = state, checkpointed(step.select(
            *key, "shape", peaks.alias("peaks"), kept.alias("kept"),
            (F.col("done") | F.col("next").isNull() | (F.size(kept) >= k)).alias("done")))
        release(before)
        if state.where(~F.col("done")).isEmpty():
            break
    out = state.select(*key, "shape", F.posexplode("kept").alias("pos", "p"))
    begin = start_of(F.col("p"))
    return out.select(*key, (F.col("pos") + 1).alias("rank"), "p.i", "p.j", "p.k", "p.score",
                      *[begin[a].alias(f"s{a}") for a in VOXEL])


def proposal_metrics(proposals: DataFrame, gt: DataFrame, findings: DataFrame, patch: tuple[int, int, int],
                     ks: tuple[int, ...] = (1, 3, 5), empty_included: bool = False) -> DataFrame:
    """Any hit, full inclusion by one patch and covered share within the first k proposals.

    An empty truth is never hit and has coverage 0; whether it counts as fully included by any proposal is ``empty_included``.
    """
    # At most max(ks) proposals per finding are ever looked at, so the array is short.
    starts = proposals.where(F.col("rank") <= max(ks)).groupBy(*KEY).agg(F.sort_array(F.collect_list(
        F.struct("rank", *[f"s{a}" for a in VOXEL]))).alias("ps"))
    rows = salted_join(gt.select(*KEY, *VOXEL), starts, KEY, VOXEL, "left")
    inside = lambda p: reduce(lambda x, y: x & y, [
        (p[f"s{a}"] <= F.col(a)) & (F.col(a) < p[f"s{a}"] + patch[n]) for n, a in enumerate(VOXEL)])
    rows = rows.withColumn("in", F.coalesce(F.transform("ps", inside), F.array().cast("array<boolean>")))
    top = max(ks)
    held = lambda n: F.coalesce(F.get("in", F.lit(n)), F.lit(False))
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(held(n)).alias(f"one_{n}") for n in range(top)]
    aggs += [F.count_if(F.exists(F.slice("in", 1, k), lambda b: b)).alias(f"cov_{k}") for k in ks]
    sums = rows.groupBy(*KEY).agg(*aggs)
    names = [c for c in sums.columns if c not in KEY]
    out = findings.select(*KEY).join(sums, KEY, "left").fillna(0, names)
    if empty_included:
        proposed = starts.select(*KEY, F.transform("ps", lambda p: p["rank"]).alias("ranks"))
        out = out.join(proposed, KEY, "left")
    cols = []
    for k in ks:
        full = reduce(lambda x, y: x | y, [F.col(f"one_{n}") == F.col("total") for n in range(k)])
        nothing = F.coalesce(F.exists("ranks", lambda x: x <= k), F.lit(False)) if empty_included else F.lit(False)  # noqa: B023
        cols += [(F.col(f"cov_{k}") > 0).alias(f"hit_at_{k}"), F.when(F.col("total") > 0, full).otherwise(nothing).alias(f"full_inclusion_at_{k}"),
                 F.coalesce(ratio(f"cov_{k}", "total"), F.lit(0.0)).alias(f"coverage_at_{k}")]
    return out.select(*KEY, *cols)


def proposal_coverage(counts: DataFrame, by: list[str]) -> DataFrame:
    """Coverage and size of proposals; ``counts`` has gt, pred and tp voxels per finding.

    Findings without truth have no coverage and are left to ``undefined``.
    """
    rows = counts.withColumn("coverage", ratio("tp", "gt")).withColumn("volume_ratio", ratio("pred", "gt"))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("tp") > 0).alias("findings_with_overlap"),
        F.count_if(F.col("gt") == 0).alias("undefined"),
        F.avg((F.col("tp") > 0).cast("double")).alias("overlap_rate"), F.avg("coverage").alias("mean_coverage"),
        ratio(F.sum("tp"), F.sum("gt")).alias("pooled_coverage"), F.avg("volume_ratio").alias("mean_volume_ratio"),
        ratio(F.sum("pred"), F.sum("gt")).alias("pooled_volume_ratio"))
    cov = exact_quantiles(rows, by, "coverage", {"median_coverage": 0.5})
    vol = exact_quantiles(rows, by, "volume_ratio", {"median_volume_ratio": 0.5})
    return base.join(cov, by, "left").join(vol, by, "left")


# ------------------------------------------------------------------ C27 patches

def stitch(patches: DataFrame, headers: DataFrame, size: tuple[int, int, int], how: str = "max",
           key: list[str] = KEY) -> DataFrame:
    """Merge overlapping patch values on the full grid.

    ``patches`` has the patch start ``si, sj, sk`` and local ``i, j, k``. ``max`` keeps the
    largest value, ``gaussian`` the mean weighted by a centred bell (sigma = size / 8).
    """
    rows = salted_join(patches, headers.select("case_id", "shape"), ["case_id"], VOXEL)
    weight = F.lit(1.0)
    for n, a in enumerate(VOXEL):
        weight = weight * F.exp(-0.5 * F.pow((F.col(a) - (size[n] - 1) / 2.0) / (size[n] / 8.0), F.lit(2.0)))
    peak = 1.0
    for n in range(3):
        off = 0.0 if size[n] % 2 else 0.5
        peak *= float(2.718281828459045 ** (-0.5 * (off / (size[n] / 8.0)) ** 2))
    weight = F.greatest(weight / F.lit(peak), F.lit(1e-7))
    rows = rows.select(*key, *[(F.col(a) + F.col(f"s{a}")).alias(f"g{a}") for a in VOXEL], "shape", "value",
                       weight.alias("w"))
    inside = reduce(lambda x, y: x & y, [(F.col(f"g{a}") >= 0) & (F.col(f"g{a}") < F.col("shape")[n])
                                         for n, a in enumerate(VOXEL)])
    merged = {"max": F.max("value"), "gaussian": F.sum(F.col("w") * F.col("value")) / F.sum("w")}[how]
    return rows.where(inside).groupBy(*key, *[F.col(f"g{a}").alias(a) for a in VOXEL]).agg(merged.alias("value"))


def paste_back(voxels: DataFrame, crops: DataFrame, order: tuple[int, int, int] = (0, 1, 2)) -> DataFrame:
    """Shift cropped voxels by the crop's lower corner and re-order the axes."""
    rows = salted_join(voxels, crops.select("case_id", *LOW), ["case_id"], VOXEL)
    full = [F.col(a) + F.col(lo) for a, lo in zip(VOXEL, LOW)]
    return rows.select(*[c for c in voxels.columns if c not in VOXEL],
                       *[full[old].alias(VOXEL[new]) for new, old in enumerate(order)])
