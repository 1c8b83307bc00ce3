"""The error atlas, a composition of mask, component, sweep and bootstrap operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmeter.functions import ratio
from voxelmeter.operators import components as comp
from voxelmeter.operators import masks, stats
from voxelmeter.operators.masks import KEY
from voxelmeter.session import checkpointed

MEANS = ["dice", "hit", "known_positive_recall", "certified_precision", "predicted_mm3", "off_location_fraction",
         "detached_fraction", "candidate_recall", "anatomy_fraction"]
TOTALS = ["prediction_voxels", "known_positive_voxels", "certified_fp_voxels", "unknown_voxels", "off_location_voxels", "components", "detached",
          "detached_off_location"]


def error_atlas(findings: DataFrame, pred: DataFrame, gt: DataFrame, regions: DataFrame, headers: DataFrame,
                anatomy: DataFrame | None = None, supervised: DataFrame | None = None) -> DataFrame:
    """One row per finding.

    Dice is unsmoothed here. ``anatomy`` is the compatible region per case. Findings outside
    ``supervised`` have no certified region, so the columns that need one are null.
    """
    pred, gt = checkpointed(masks.words(pred)), checkpointed(masks.words(gt))
    m = masks.mask_metrics(findings, pred, gt, epsilon=0.0, recall_empty="null")
    parts = checkpointed(masks.partition_words(pred, gt, regions))
    place = masks.partition_summary(findings, parts, headers)
    # Both masks are labelled in the same rounds, with the mask as part of the key.
    both = pred.select(F.lit("pred").alias("mask"), "*").union(gt.select(F.lit("gt").alias("mask"), "*"))
    labels = checkpointed(comp.components(both, ["mask", *KEY]))
    of = lambda name: labels.where(F.col("mask") == name).drop("mask")
    rel = comp.relation_summary(findings, comp.component_relations(of("pred"), parts), of("gt"), pred)
    out = m.join(place, KEY).join(rel, KEY)
    if anatomy is not None:
        inside = masks.supported_metrics(findings.select(*KEY), pred, gt, anatomy).select(*KEY, F.col("pred_voxels").alias("__in"))
        out = out.join(inside, KEY)
    else:
        out = out.withColumn("__in", F.lit(None).cast("bigint"))
    n_pred = F.col("tp") + F.col("fp")
    known = F.lit(True)
    if supervised is not None:
        out = out.join(supervised.select(*KEY).distinct().withColumn("__sup", F.lit(True)), KEY, "left")
        known = F.col("__sup").isNotNull()
    off_mm3 = F.col("ipsilateral_mm3") + F.col("contralateral_mm3") + F.col("outside_lung_mm3")
    total_mm3 = sum((F.col(f"{p}_mm3") for p in masks.PARTITION), F.lit(0.0))
    guarded = lambda c: F.when(known, c)
    return out.select(
        *findings.columns, "dice", "hit", (n_pred == 0).alias("prediction_empty"), n_pred.alias("prediction_voxels"),
        (F.col("tp") + F.col("fn")).alias("known_positive_voxels"), F.col("recall").alias("known_positive_recall"), total_mm3.alias("predicted_mm3"),
        guarded(F.col("certified_precision")).alias("certified_precision"), guarded(F.col("certified_fp_voxels")).alias("certified_fp_voxels"),
        F.col("unknown_voxels"), guarded(F.col("off_location_voxels")).alias("off_location_voxels"), guarded(off_mm3).alias("off_location_mm3"),
        guarded(F.col("off_location_fraction")).alias("off_location_fraction"), "components", "detached",
        guarded(F.col("detached_off_location")).alias("detached_off_location"), "detached_fraction", "gt_components", "recalled", "candidate_recall",
        ratio("__in", n_pred).alias("anatomy_fraction"))


def atlas_summary(atlas: DataFrame, draws: int, seed: int) -> DataFrame:
    """Means with observation counts and case-cluster intervals, and totals, one row per metric."""
    numeric = atlas.select("case_id", *[F.col(c).cast("double").alias(c) for c in MEANS])
    boot = stats.cluster_bootstrap(numeric, "case_id", MEANS, draws, seed).select(
        F.lit("mean").alias("kind"), "metric", F.col("estimate").alias("value"), "observations", "ci_low", "ci_high")
    sums = atlas.agg(*[F.sum(c).cast("double").alias(c) for c in TOTALS], *[F.count(c).alias(f"{c}__n") for c in TOTALS])
    flat = sums.select(F.explode(F.array(*[F.struct(
        F.lit("total").alias("kind"), F.lit(c).alias("metric"), F.col(c).alias("value"), F.col(f"{c}__n").alias("observations"),
        F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high")) for c in TOTALS])).alias("x")).select("x.*")
    return boot.union(flat)
