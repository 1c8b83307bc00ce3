"""Binarisation and threshold sweeps.

A sweep bins every score once and sums the histogram from the top, so its cost does not
grow with the number of thresholds and only (finding, bin) counts are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelmeter.functions import dice, exact_quantiles, hit, ordered_counts, precision, ratio, recall
from voxelmeter.operators.chunks import chunk_counts, recipe_counts, recipe_totals
from voxelmeter.operators.masks import KEY
from voxelmeter.session import checkpointed

# Means that decide a choice are rounded, so that summation order cannot.
TIE_DIGITS = 12


def cut_of(threshold: float, kind: str) -> float:
    """A probability threshold in the domain the score is stored in."""
    if not 0.0 < threshold < 1.0:
        raise ValueError("threshold must lie strictly between 0 and 1")
    return math.log(threshold / (1.0 - threshold)) if kind == "logit" else threshold


def binarise(score: str, threshold: float, kind: str = "probability", inclusive: bool = True) -> Column:
    """Mask column of a score column."""
    cut = F.lit(cut_of(threshold, kind))
    return F.col(score) >= cut if inclusive else F.col(score) > cut


def mask_equivalence(scores: DataFrame, mask: DataFrame, voxel: list[str], by: list[str], threshold: float, score: str,
                     kind: str = "probability", inclusive: bool = True) -> DataFrame:
    """Voxels where the thresholded score and a stored mask differ."""
    rows = scores.select(*voxel, binarise(score, threshold, kind, inclusive).alias("a")).join(
        mask.select(*voxel).withColumn("m", F.lit(True)), voxel, "full_outer")
    on, stored = F.coalesce("a", F.lit(False)), F.coalesce("m", F.lit(False))
    out = rows.groupBy(*by).agg(F.count_if(on).alias("thresholded"), F.count_if(stored).alias("stored"),
                                F.count_if(on != stored).alias("mismatches"))
    return out.withColumn("exact", F.col("mismatches") == 0)


def to_half(x: str, clip: float = 30.0) -> Column:
    """Value after clipping and rounding to a 16-bit float (half to even)."""
    v = F.least(F.greatest(F.col(x).cast("double"), F.lit(-clip)), F.lit(clip))
    exponent = F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-14))
    step = F.pow(F.lit(2.0), exponent - 10)
    return F.when(v == 0, F.lit(0.0)).otherwise(F.bround(v / step, 0) * step)


def quantisation_flips(rows: DataFrame, raw: str, stored: str, by: list[str]) -> DataFrame:
    """Sign flips at cut 0 between a raw and a stored score.

    A stored array without zeros keeps every sign, which ``sign_safe`` states without the raw
    array.
    """
    a, b = F.col(raw), F.col(stored)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("voxels"), F.count_if((a >= 0) != (b >= 0)).alias("flips"), F.count_if(b == 0).alias("stored_zeros"),
        F.max(F.abs(a - b)).alias("max_error"), (F.count_if(b == 0) == 0).alias("sign_safe"))


def bin_of(score: Column, cuts: list, inclusive: bool = True) -> Column:
    """Number of cuts at or below the score, found by a balanced comparison tree."""
    if not cuts:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        cut = cuts[mid] if isinstance(cuts[mid], Column) else F.lit(cuts[mid])
        return F.when(score >= cut if inclusive else score > cut, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def histogram_counts(rows: DataFrame, keys: DataFrame, key: list[str], bins: Column, label: Column, size: int) -> DataFrame:
    """Suffix sums of a score histogram: ``n`` and ``n_true`` at or above each cut.

    ``keys`` lists the groups to report; those without any row get zeros. Output has one
    row per (key, ``cut`` in 1..size).
    """
    return suffix_counts(rows.groupBy(*key, bins.alias("cut")).agg(F.count(F.lit(1)).alias("n"), F.count_if(label).alias("n_true")), keys, key, size)


def suffix_counts(hist: DataFrame, keys: DataFrame, key: list[str], size: int) -> DataFrame:
    """The same from a histogram ``(key, cut, n, n_true)``."""
    blank = keys.select(*key, F.explode(F.sequence(F.lit(1), F.lit(size))).alias("cut"),
                        F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("n_true"))
    full = hist.where("cut > 0").unionByName(blank).groupBy(*key, "cut").agg(F.sum("n").alias("n"), F.sum("n_true").alias("n_true"))
    above = W.partitionBy(*key).orderBy(F.desc("cut")).rowsBetween(W.unboundedPreceding, 0)
    return full.select(*key, "cut", F.sum("n").over(above).alias("n"), F.sum("n_true").over(above).alias("n_true"))


def dense_counts(counts: DataFrame, keys: DataFrame, truth: DataFrame, key: list[str], size: int, keep: list[str] = (), base: int | None = None) -> DataFrame:
    """``n`` and ``n_true`` for each of ``keys`` and each ``cut`` in 1..size, beside ``n_gt``, from rows of arrays (key, n, n_true).

    The arrays are added entry by entry and stay one row per key in every shuffle; they are unrolled at the end. ``keep`` names columns
    of ``keys`` to carry along, ``base`` a cut whose counts stand on each row as ``base_n`` and ``base_true``.
    """
    names = [f"__{c}{x}" for c in ("n", "t") for x in range(size)]
    sums = counts.groupBy(*key).agg(*[F.sum(F.col("n" if name[2] == "n" else "n_true")[int(name[3:])]).alias(name) for name in names])
    wanted = keys.select(*key, *keep).join(truth.select(*KEY, "n_gt"), KEY, "left")
    # The thin side is the one that is hashed, a partition at a time, so that rows of arrays are not sorted.
    rows = wanted.hint("shuffle_hash").join(sums, key, "left").fillna(0, ["n_gt", *names])
    # Two arrays of numbers, read in step: an array of a struct per cut would make an object of each.
    pair = [F.array(*[F.col(f"__{c}{x}") for x in range(size)]).alias(name) for c, name in (("n", "n"), ("t", "n_true"))]
    return unrolled(rows.select(*key, *keep, "n_gt", *pair), [*key, *keep], base)


def unrolled(rows: DataFrame, key: list[str], base: int | None = None) -> DataFrame:
    """A row per cut from one with the arrays ``n`` and ``n_true`` beside ``n_gt``; ``base`` names a cut whose counts stand on each row as ``base_n`` and ``base_true``."""
    extra = [] if base is None else [F.col("n")[base - 1].alias("base_n"), F.col("n_true")[base - 1].alias("base_true")]
    stays = [*key, "n_gt", *extra]
    cells = rows.select(*stays, F.posexplode(F.arrays_zip("n", "n_true")).alias("cut", "c"))
    return cells.select(*key, "n_gt", *(["base_n", "base_true"] if extra else []), (F.col("cut") + 1).alias("cut"), "c.*")


def whole_counts(stack: DataFrame, trial: list | None, cuts: list[float], keep: list[str], name: str, base: int | None = None) -> DataFrame:
    """What :func:`dense_counts` gives, from a stack whose rows are whole findings with all their truth: no row is shuffled or joined."""
    gt = stack.withColumn("n_gt", F.size("truth").cast("bigint"))
    return unrolled(recipe_counts(gt, trial, cuts, [*keep, "n_gt"], name), [name, *KEY, *keep], base)


def _levels(values: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("cut").cast("int"))


def sweep(scores: DataFrame, keys: DataFrame | None, truth: DataFrame | None, thresholds: list[float], score: str = "z", kind: str = "logit",
          key: list[str] | None = None, keep: list[str] = (), baseline: float | None = None) -> DataFrame:
    """D3: all metrics at every threshold from one pass.

    ``scores`` carries ``is_gt``, or is a chunk table with ``values`` and ``truth``; ``truth`` gives ``n_gt`` per finding including voxels
    without a score. The output is dense over ``keys`` x thresholds, and carries the columns of ``keys`` that ``keep`` names. From a chunk table
    it can have ``base_dice`` and ``base_hit`` as well, of the same key at the threshold ``baseline``.

    A stack of all candidates whose rows are whole findings, as ``voxel_stacks`` gives, needs neither ``keys`` nor ``truth`` (None): its findings
    are those reported, its true voxels all there are, and ``keep`` names columns of its own. The key is then ``candidate_id`` and the finding.
    """
    key = key or KEY
    values = sorted(set(float(t) for t in thresholds))
    cuts = [cut_of(t, kind) for t in values]
    base = []
    if "values" in scores.columns:
        at = None if baseline is None else values.index(baseline) + 1
        if keys is None:
            key = ["candidate_id", *KEY]
            rows = whole_counts(scores, None, cuts, keep, "candidate_id", at)
        else:
            rows = dense_counts(chunk_counts(scores, key, cuts), keys, truth, key, len(values), keep, at)
        if baseline is not None:
            b = dice("base_true", "base_n", "n_gt")
            base = [b.alias("base_dice"), hit(b).alias("base_hit")]
    else:
        if baseline is not None:
            raise ValueError("a baseline needs a chunk table")
        counts = histogram_counts(scores, keys, key, bin_of(F.col(score), cuts), F.col("is_gt"), len(values))
        rows = counts.join(truth.select(*KEY, "n_gt"), KEY, "left").fillna(0, ["n_gt"])
        rows = rows.join(keys.select(*key, *keep), key) if keep else rows
    d = dice("n_true", "n", "n_gt")
    return rows.select(
        *key, *keep, *base, _levels(values).alias("threshold"), F.col("n").alias("pred"), F.col("n_true").alias("tp"),
        (F.col("n") - F.col("n_true")).alias("fp"), (F.col("n_gt") - F.col("n_true")).alias("fn"), d.alias("dice"), hit(d).alias("hit"),
        precision("n_true", "n", "n_gt", "zero").alias("precision"), recall("n_true", "n_gt", "null").alias("recall"))


def removal_sweep(rows: DataFrame, keys: DataFrame, truth: DataFrame, cuts: list[float], score: str = "score", label: str = "label",
                  key: list[str] | None = None) -> DataFrame:
    """Effect of deleting base-positive voxels whose removal score exceeds each cut.

    Scores and cuts are compared as 32-bit floats, strictly, so nothing goes at cut 1. ``rows`` may be a chunk table: the removal
    scores of base-positive voxels as ``values``, with ``truth``.
    """
    key = key or KEY
    values = sorted(set(float(c) for c in cuts))
    if "values" in rows.columns:
        counts = dense_counts(chunk_counts(rows, key, values, inclusive=False, single=True), keys, truth, key, len(values)).drop("n_gt")
        base = rows.groupBy(*key).agg(F.sum(F.size("truth")).alias("base_tp"), F.sum(F.size("values") - F.size("truth")).alias("base_fp"))
    else:
        as_float = [F.lit(v).cast("float") for v in values]
        bins = bin_of(F.col(score).cast("float"), as_float, inclusive=False)
        counts = histogram_counts(rows, keys, key, bins, F.col(label), len(values))
        base = rows.groupBy(*key).agg(F.count_if(F.col(label)).alias("base_tp"), F.count_if(~F.col(label)).alias("base_fp"))
    out = counts.join(base, key, "left").join(truth.select(*KEY, "n_gt"), KEY, "left").fillna(0, ["base_tp", "base_fp", "n_gt"])
    out = out.withColumn("tp_removed", F.col("n_true")).withColumn("fp_removed", F.col("n") - F.col("n_true"))
    return _removal_metrics(out.withColumn("threshold", _levels(values)), [*key, "threshold"])


def _removal_metrics(rows: DataFrame, keep: list[str]) -> DataFrame:
    rows = rows.withColumn("tp", F.col("base_tp") - F.col("tp_removed")).withColumn("fp", F.col("base_fp") - F.col("fp_removed"))
    smooth = lambda tp, fp: (2 * F.col(tp) + 1e-6) / (F.col(tp) + F.col(fp) + F.col("n_gt") + 1e-6)
    before, after = smooth("base_tp", "base_fp"), smooth("tp", "fp")
    return rows.select(
        *keep, "base_tp", "base_fp", "n_gt", "tp", "fp", (F.col("n_gt") - F.col("tp")).alias("fn"), "tp_removed", "fp_removed",
        before.alias("base_dice"), after.alias("dice"), (after - before).alias("delta_dice"), hit(before).alias("base_hit"),
        hit(after).alias("hit"), F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
        ratio("tp", "n_gt").alias("recall"), ratio("tp", "base_tp").alias("tp_retention"), ratio("fp_removed", "base_fp").alias("fp_removal"),
        ratio("fp_removed", F.col("tp_removed") + F.col("fp_removed")).alias("deletion_precision"))


def with_subsets(rows: DataFrame, half: str) -> DataFrame:
    """Each row once under its half and once under ``full``."""
    return rows.withColumn("subset", F.explode(F.array(F.col(half), F.lit("full"))))


def _changes(delta: str) -> list[Column]:
    d = F.col(delta)
    return [F.avg(d).alias("delta_dice"), F.count_if(d > 1e-12).alias("improved"),
            F.count_if(F.abs(d) <= 1e-12).alias("unchanged"), F.count_if(d < -1e-12).alias("worsened")]


def sweep_summary(swept: DataFrame, half: str, baseline: float = 0.5, by: list[str] | None = None, key: list[str] | None = None) -> DataFrame:
    """Sweep rows per threshold and subset, compared with the same finding at ``baseline``, as the sweep put it beside them or by a join."""
    by, key = by or [], key or KEY
    if "base_dice" in swept.columns:
        both = swept.withColumnsRenamed({"base_dice": "__d", "base_hit": "__h"})
    else:
        both = swept.join(swept.where(F.col("threshold") == baseline).select(*by, *key, F.col("dice").alias("__d"), F.col("hit").alias("__h")), [*by, *key])
    rows = with_subsets(both.withColumn("__c", F.col("dice") - F.col("__d")), half)
    out = rows.groupBy(*by, "threshold", "subset").agg(
        F.count(F.lit(1)).alias("findings"), F.avg("dice").alias("dice"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.count_if("hit").alias("hits"),
        *_changes("__c"), F.count_if(F.col("hit") & ~F.col("__h")).alias("hits_gained"),
        F.count_if(~F.col("hit") & F.col("__h")).alias("hits_lost"))
    pooled = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return out.withColumn("hit_rate", F.col("hits") / F.col("findings")).withColumn("pooled_dice", pooled)


def removal_summary(swept: DataFrame, half: str, by: list[str] | None = None) -> DataFrame:
    """Removal sweep per cut and subset with the distribution of true-positive retention."""
    by = [*(by or []), "threshold", "subset"]
    rows = with_subsets(swept, half)
    kept = F.col("tp_retention")
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("findings"), F.avg("dice").alias("dice"), F.avg("base_dice").alias("base_dice"),
        *[F.sum(c).alias(c) for c in ("base_tp", "base_fp", "tp", "fp", "tp_removed", "fp_removed")],
        F.count_if("hit").alias("hits"), F.count_if("base_hit").alias("base_hits"), *_changes("delta_dice"),
        F.avg(kept).alias("retention_mean"), F.min(kept).alias("retention_min"), F.count_if(kept < 0.95).alias("below_95"),
        F.count_if(kept < 0.80).alias("below_80"), F.count_if(kept.isNull()).alias("undefined_retention"))
    qs = exact_quantiles(rows, by, "tp_retention", {"retention_median": 0.5, "retention_p10": 0.1}, buckets=16)
    out = out.join(qs, by, "left")
    return (out.withColumn("tp_retention", ratio("tp", "base_tp")).withColumn("fp_removal", ratio("fp_removed", "base_fp"))
            .withColumn("deletion_precision", ratio("fp_removed", F.col("fp_removed") + F.col("tp_removed"))))


def threshold_totals(stack: DataFrame, thresholds: list[float], by: list[str] = (), kind: str = "logit", trial: list | None = None, name: str = "candidate_id") -> DataFrame:
    """(candidate, by, threshold, dice_sum, hits, findings) from a stack whose rows are whole findings: what :func:`threshold_sums` makes of its sweep, with no row per finding."""
    values = sorted(set(float(t) for t in thresholds))
    rows = recipe_totals(stack, trial, [cut_of(t, kind) for t in values], by, name)
    return rows.select(name, *by, _levels(values).alias("threshold"), "dice_sum", "hits", "findings")


def threshold_sums(swept: DataFrame, by: list[str]) -> DataFrame:
    """Dice, hits and findings added up per (by, threshold), from rows per finding or from totals of them."""
    if "dice_sum" in swept.columns:
        return swept.groupBy(*by, "threshold").agg(*[F.sum(c).alias(c) for c in ("dice_sum", "hits", "findings")])
    return swept.groupBy(*by, "threshold").agg(F.sum("dice").alias("dice_sum"), F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("findings"))


def per_threshold(swept: DataFrame, by: list[str]) -> DataFrame:
    """Mean dice and hits per (by, threshold): the only table that choices look at."""
    return threshold_sums(swept, by).select(*by, "threshold", F.round(F.col("dice_sum") / F.col("findings"), TIE_DIGITS).alias("dice"), "hits", "findings")


def best_threshold(rows: DataFrame, by: list[str], coarse: list[float], reach: float = 0.04) -> DataFrame:
    """Best of a coarse grid, then best of all thresholds within ``reach`` of it.

    ``rows`` is :func:`per_threshold`, so a group is one short array of thresholds and both
    steps happen on it. Order: dice, hits, lower threshold.
    """
    grid = F.array(*[F.lit(float(c)) for c in coarse])
    arrays = rows.groupBy(*by).agg(F.collect_list(F.struct((-F.col("dice")).alias("d"), (-F.col("hits")).alias("h"), F.col("threshold").alias("t"),
                                                           F.col("findings").alias("n"))).alias("a"))
    on_grid = F.filter("a", lambda x: F.exists(grid, lambda c: F.abs(c - x["t"]) < 1e-9))
    arrays = arrays.withColumn("c", F.array_min(on_grid)["t"])
    best = F.array_min(F.filter("a", lambda x: F.abs(x["t"] - F.col("c")) <= reach + 1e-7))
    out = arrays.select(*by, best.alias("b")).where("b is not null").select(
        *by, F.col("b.t").alias("threshold"), (-F.col("b.d")).alias("dice"), (-F.col("b.h")).alias("hits"), F.col("b.n").alias("findings"))
    return out.withColumn("hit_rate", F.col("hits") / F.col("findings"))


def category_thresholds(swept: DataFrame, by: list[str], coarse: list[float], min_findings: int = 20, reach: float = 0.04) -> DataFrame:
    """Own threshold for categories with support, the global one for the rest.

    Chosen on the rows it is scored on, hence ``in_sample``.
    """
    # (by, category, threshold) is the only table the choices need, so it is kept once.
    cats = checkpointed(threshold_sums(swept, [*by, "category"]))
    whole = cats.groupBy(*by, "threshold").agg(F.round(F.sum("dice_sum") / F.sum("findings"), TIE_DIGITS).alias("dice"),
                                               F.sum("hits").alias("hits"), F.sum("findings").alias("findings"))
    overall = best_threshold(whole, by, coarse, reach).select(*by, F.col("threshold").alias("global_threshold"))
    cats = cats.withColumn("dice", F.round(F.col("dice_sum") / F.col("findings"), TIE_DIGITS))
    own = best_threshold(cats, [*by, "category"], coarse, reach).withColumnRenamed("threshold", "own_threshold")
    own = own.join(overall, by) if by else own.crossJoin(F.broadcast(overall))
    small = F.col("findings") < min_findings
    picked = own.select(*by, "category", F.when(small, F.col("global_threshold")).otherwise(F.col("own_threshold")).alias("threshold"),
                        F.when(small, "global_fallback").otherwise("category").alias("policy"), "global_threshold")
    at = cats.select(*by, "category", "threshold", "dice", "hits", "findings")
    out = picked.join(at, [*by, "category", "threshold"])
    base = at.select(*by, "category", F.col("threshold").alias("global_threshold"), F.col("dice").alias("global_dice"))
    return out.join(base, [*by, "category", "global_threshold"]).withColumn("in_sample", F.lit(True))


def category_oracle_score(chosen: DataFrame, by: list[str]) -> DataFrame:
    """Global score rebuilt from the category choices, with macro and minimum."""
    return chosen.groupBy(*by).agg(
        (F.sum(F.col("dice") * F.col("findings")) / F.sum("findings")).alias("recomposed_dice"),
        (F.sum(F.col("global_dice") * F.col("findings")) / F.sum("findings")).alias("global_dice"),
        F.avg("dice").alias("macro_dice"), F.min("dice").alias("min_dice"), F.sum("hits").alias("hits"),
        F.sum("findings").alias("findings"), F.lit(True).alias("in_sample"))


def retention_threshold(scores: DataFrame, by: list[str], score: str, retention: float, higher_means_delete: bool = True) -> DataFrame:
    """Cut that removes at most floor((1 - r) n) of the given true-positive scores.

    An order statistic, not an interpolated quantile; with strict comparison all values tied
    at the cut stay.
    """
    ranked = ordered_counts(scores, by, score)
    allowed = F.floor(F.lit(1.0 - retention) * F.col("total") + F.lit(1e-9))
    rank = F.col("total") - allowed - 1 if higher_means_delete else allowed
    at = (F.col("cum") - F.col("cnt") <= rank) & (F.col("cum") > rank)
    return ranked.groupBy(*by).agg(F.max(F.when(at, F.col(score))).alias("cut"), F.max("total").alias("n"))


def compare_at_retention(rows: DataFrame, truth: DataFrame, retention: float, editor: str, base: str, label: str) -> DataFrame:
    """Learned deletion against a simple cut of the base score at equal retention."""
    positives = rows.where(label)
    cuts = retention_threshold(positives, [], editor, retention).select(F.col("cut").alias("editor_cut")).crossJoin(
        retention_threshold(positives, [], base, retention, False).select(F.col("cut").alias("base_cut")))
    tagged = rows.crossJoin(F.broadcast(cuts))
    arms = {"editor": F.col(editor) > F.col("editor_cut"), "simple": F.col(base) < F.col("base_cut")}
    y = F.col(label)
    counts = tagged.groupBy(*KEY).agg(
        F.count_if(y).alias("base_tp"), F.count_if(~y).alias("base_fp"),
        *[F.count_if(gone & y).alias(f"tp_{a}") for a, gone in arms.items()],
        *[F.count_if(gone & ~y).alias(f"fp_{a}") for a, gone in arms.items()])
    arm = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"tp_{a}").alias("tp_removed"), F.col(f"fp_{a}").alias("fp_removed"))
                              for a in arms]))
    long = counts.join(truth.select(*KEY, "n_gt"), KEY, "left").fillna(0, ["n_gt"]).withColumn("a", arm).select(
        *KEY, "base_tp", "base_fp", "n_gt", "a.*")
    m = _removal_metrics(long, [*KEY, "arm"])
    out = m.groupBy("arm").agg(
        F.count(F.lit(1)).alias("findings"), F.avg("dice").alias("dice"), F.avg("base_dice").alias("base_dice"), *_changes("delta_dice"),
        *[F.sum(c).alias(c) for c in ("base_tp", "base_fp", "tp", "fp", "tp_removed", "fp_removed")])
    return out.withColumn("tp_retention", ratio("tp", "base_tp")).withColumn("fp_removal", ratio("fp_removed", "base_fp"))
