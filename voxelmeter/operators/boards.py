"""Leaderboards, comparisons and roll-ups.

Boards rank aggregated tables (a row per candidate, category or arm); row-level data only
meets map-side combined aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelmeter.functions import bucketed_row_number, ratio, with_buckets
from voxelmeter.operators.masks import KEY

TIE_DIGITS = 12


def overall(evals: DataFrame, by: list[str] = ("candidate_id",)) -> DataFrame:
    """Mean dice over findings, hits and case-weighted mean per candidate."""
    by = list(by)
    per_case = evals.groupBy(*by, "case_id").agg(F.sum("dice").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("h"))
    out = per_case.groupBy(*by).agg(
        F.round(F.sum("s") / F.sum("n"), TIE_DIGITS).alias("dice"), F.sum("h").alias("hits"), F.sum("n").alias("findings"),
        F.count(F.lit(1)).alias("cases"), F.avg(F.col("s") / F.col("n")).alias("case_mean_dice"))
    return out.withColumn("hit_rate", F.col("hits") / F.col("findings"))


def rank_overall(evals: DataFrame) -> DataFrame:
    """Rank by dice, hits, id, with the observed best, worst and spread on every row."""
    order = W.orderBy(F.desc("dice"), F.desc("hits"), "candidate_id")
    rows = overall(evals)
    ends = rows.agg(F.max("dice").alias("best_dice"), F.min("dice").alias("worst_dice"))
    return rows.withColumn("rank", F.row_number().over(order)).crossJoin(F.broadcast(ends)).withColumn(
        "spread", F.col("best_dice") - F.col("worst_dice"))


def by_category(evals: DataFrame, categories: list[str]) -> DataFrame:
    """Candidate x category results; categories without findings stay as null rows."""
    per = evals.groupBy("candidate_id", "category").agg(
        F.round(F.avg("dice"), TIE_DIGITS).alias("dice"), F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("findings"))
    grid = per.select("candidate_id").distinct().withColumn("category", F.explode(F.array(*[F.lit(c) for c in categories])))
    return grid.join(per, ["candidate_id", "category"], "left").fillna(0, ["hits", "findings"])


def rank_category(evals: DataFrame, categories: list[str]) -> DataFrame:
    """Rank inside each category by dice, overall dice, id; no rank where there is nothing to rank."""
    rows = by_category(evals, categories).join(overall(evals).select("candidate_id", F.col("dice").alias("overall_dice")), "candidate_id")
    order = W.partitionBy("category").orderBy(F.desc_nulls_last("dice"), F.desc("overall_dice"), "candidate_id")
    return rows.withColumn("rank", F.when(F.col("dice").isNotNull(), F.row_number().over(order)))


def submitter_rank(entries: DataFrame, submitter: str, score: str, entry: str, pending: Column) -> DataFrame:
    """The best entry of a submitter takes the next rank, its others are ``secondary``.

    Submitters are compared in lower case; equal scores go to the lower entry id; pending
    entries have no rank and the state ``pending``.
    """
    rows = entries.withColumn("__k", F.lower(submitter)).withColumn("__p", pending)
    scored = rows.where(~F.col("__p") & F.col(score).isNotNull())
    first = scored.groupBy("__k").agg(F.min(F.struct((-F.col(score)).alias("neg"), F.col(entry).alias("e"))).alias("b")).select("__k", "b.neg", "b.e")
    ranked = bucketed_row_number(with_buckets(first, [], "neg"), [], F.col("__b"), ["neg", "e"], "rank")
    out = rows.join(ranked.select(F.col("e").alias(entry), "rank"), entry, "left")
    state = F.when(F.col("__p") | F.col(score).isNull(), "pending").when(F.col("rank").isNotNull(), "ranked").otherwise("secondary")
    return out.withColumn("state", state).drop("__k", "__p")


def wide(evals: DataFrame, categories: list[str], value: str = "dice", by: list[str] = ("candidate_id",)) -> DataFrame:
    """I4: one row per candidate (and threshold) with a mean per category and overall."""
    by = list(by)
    v = F.col(value).cast("double")
    return evals.groupBy(*by).agg(F.avg(v).alias("overall"), *[
        F.avg(F.when(F.col("category") == c, v)).alias(f"c_{c}") for c in categories])


def _best_per_metric(evals: DataFrame) -> DataFrame:
    rows = evals.select("candidate_id", "dice", "hit", F.explode(F.array(F.lit("overall"), F.col("category"))).alias("metric"))
    per = rows.groupBy("candidate_id", "metric").agg(
        F.round(F.avg("dice"), TIE_DIGITS).alias("dice"), F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("findings"))
    order = F.struct(-F.col("dice"), -F.col("hits"), "candidate_id")
    return per.groupBy("metric").agg(F.min_by(F.struct("candidate_id", "dice", "hits", "findings"), order).alias("b")).select("metric", "b.*")


def head_to_head(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b"), tolerance: float = 1e-12) -> DataFrame:
    """Best candidate of each pool per metric, the difference and the winner."""
    x, y = _best_per_metric(a), _best_per_metric(b)
    left = x.select("metric", "findings", *[F.col(c).alias(f"{names[0]}_{c}") for c in ("candidate_id", "dice", "hits")])
    right = y.select("metric", *[F.col(c).alias(f"{names[1]}_{c}") for c in ("candidate_id", "dice", "hits")])
    delta = F.col(f"{names[0]}_dice") - F.col(f"{names[1]}_dice")
    win = F.when(F.abs(delta) <= tolerance, "tie").when(delta > 0, names[0]).otherwise(names[1])
    return left.join(right, "metric").withColumn("delta", delta).withColumn("winner", win)


def policy_summary(rows: DataFrame, by: list[str], strata: list[Column] = (), tolerance: float = 1e-7) -> DataFrame:
    """Before and after of each policy, overall and per stratum.

    ``rows`` holds per finding and policy the gated metrics (``dice``, ``hit``, ...) and the
    baseline as ``base_dice`` and ``base_hit``. ``strata`` are string columns; each row also
    counts under ``all``.
    """
    tags = F.array_distinct(F.array(F.lit("all"), *strata))
    tagged = rows.withColumn("stratum", F.explode(tags)).withColumn("__d", F.col("dice") - F.col("base_dice"))
    by = [*by, "stratum"]
    d, sel = F.col("__d"), F.col("selected")
    pick = lambda c: F.avg(F.when(sel, F.col(c)))
    per_case = tagged.groupBy(*by, "case_id").agg(F.avg("dice").alias("m")).groupBy(*by).agg(
        F.avg("m").alias("per_case_dice"), F.count(F.lit(1)).alias("cases"))
    out = tagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sel).alias("selected"), F.avg("base_dice").alias("before"), F.avg("dice").alias("after"),
        F.avg(d).alias("delta"), F.count_if("base_hit").alias("hits_before"), F.count_if("hit").alias("hits_after"),
        F.count_if(d > tolerance).alias("improved"), F.count_if(d < -tolerance).alias("worsened"), F.count_if(F.abs(d) <= tolerance).alias("unchanged"),
        F.count_if(F.col("hit") & ~F.col("base_hit")).alias("hit_gains"), F.count_if(~F.col("hit") & F.col("base_hit")).alias("hit_losses"),
        F.sum("tp_removed").alias("tp_removed"), F.sum("fp_removed").alias("fp_removed"), F.count_if("prediction_emptied").alias("prediction_emptied"),
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.min(d).alias("worst_delta"), F.max(d).alias("best_delta"),
        pick("base_dice").alias("selected_before"), pick("dice").alias("selected_after"), pick("gt_coverage").alias("gt_coverage_mean"),
        F.min(F.when(sel, F.col("gt_coverage"))).alias("gt_coverage_min"), F.count_if(sel & (F.col("gt_coverage") < 0.95)).alias("gt_coverage_below95"),
        F.count_if(sel & F.col("gt_completely_excluded")).alias("gt_completely_excluded"))
    return out.join(per_case, by)


def slice_summary(evals: DataFrame, by: list[str], targets: list[str], subset: DataFrame | None = None) -> DataFrame:
    """Target, non-target and, for a fixed subset of findings, total and sentinel slices."""
    is_target = F.col("category").isin(targets)
    tags = [F.lit("overall"), F.when(is_target, "target").otherwise("non_target")]
    rows = evals
    if subset is not None:
        rows = rows.join(subset.select(*KEY).distinct().withColumn("__in", F.lit(True)), KEY, "left")
        inside = F.col("__in").isNotNull()
        tags += [F.when(inside, "subset_total"), F.when(inside & ~is_target, "sentinel_non_target")]
    rows = rows.withColumn("slice", F.explode(F.array_compact(F.array(*tags))))
    out = rows.groupBy(*by, "slice").agg(F.count(F.lit(1)).alias("findings"), F.round(F.avg("dice"), TIE_DIGITS).alias("dice"), F.count_if("hit").alias("hits"))
    return out.withColumn("hit_rate", F.col("hits") / F.col("findings"))


def select_milestone(df: DataFrame, by: list[str], epoch: str = "epoch", dice: str = "dice", hit: str = "hit_rate", margin: float = 1e-6) -> DataFrame:
    """I8: walk the milestones in order and move on a dice gain beyond ``margin``, or on equal dice a better hit rate.

    An arm has a handful of milestones, so the walk is a fold over their sorted array.
    """
    item = F.struct(F.col(epoch).cast("bigint").alias("e"), F.col(dice).cast("double").alias("d"), F.col(hit).cast("double").alias("h"))
    rows = df.where(F.col(dice).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("m"))

    def step(best, x):
        better = (x["d"] > best["d"] + margin) | ((F.abs(x["d"] - best["d"]) <= margin) & (x["h"] > best["h"] + 1e-12))
        return F.when(better, x).otherwise(best)

    best = F.aggregate(F.slice("m", F.lit(2), F.size("m")), F.element_at("m", 1), step)
    start = F.get(F.filter("m", lambda x: x["e"] == 0), F.lit(0))
    return rows.withColumn("b", best).select(*by, F.col("b.e").alias("epoch"), F.col("b.d").alias("dice"), F.col("b.h").alias("hit_rate"),
                                             (F.col("b.d") - start["d"]).alias("delta_from_start"))


def trajectory(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Change from the first milestone and from the one before."""
    w = W.partitionBy(*by).orderBy(order)
    return df.withColumn("from_first", F.col(value) - F.first(value).over(w)).withColumn("from_previous", F.col(value) - F.lag(value).over(w))


def matched_deltas(df: DataFrame, arm: str, baseline: str, index: str, value: str) -> DataFrame:
    """Every arm against a baseline arm at the same update; updates without a match are left out."""
    base = df.where(F.col(arm) == baseline).select(index, F.col(value).alias("baseline_value"))
    return df.where(F.col(arm) != baseline).join(base, index).withColumn("delta", F.col(value) - F.col("baseline_value"))


def timing(journal: DataFrame, by: list[str], index: str, seconds: str, batch: int, checkpoints: list[int] | None = None,
           chunk: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Cumulative seconds per update (optionally only checkpoint rows) and totals per run.

    The running sum is taken per chunk of updates on top of chunk totals, so one long run is
    spread over tasks.
    """
    rows = journal.select(*by, index, F.coalesce(F.col(seconds), F.lit(0.0)).alias("s")).withColumn("__b", F.floor(F.col(index) / chunk))
    base = rows.groupBy(*by, "__b").agg(F.sum("s").alias("t"))
    before = F.sum("t").over(W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    base = base.select(*by, "__b", F.coalesce(before, F.lit(0.0)).alias("off"))
    inner = W.partitionBy(*by, "__b").orderBy(index).rowsBetween(W.unboundedPreceding, 0)
    cum = rows.join(base, [*by, "__b"]).withColumn("cumulative_seconds", F.col("off") + F.sum("s").over(inner))
    cum = cum.select(*by, index, F.col("s").alias("seconds"), "cumulative_seconds")
    if checkpoints is not None:
        cum = cum.where(F.col(index).isin(checkpoints))
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("updates"), F.sum("s").alias("total_seconds"))
    total = total.withColumn("seconds_per_update", ratio("total_seconds", "updates")).withColumn(
        "samples_per_second", ratio(F.col("updates") * batch, "total_seconds"))
    return cum, total


def roster(catalog: DataFrame, n: int) -> DataFrame:
    """Top n eligible candidates by dice, hits, id.

    Too few candidates, or missing or repeated content hashes among them, are an error.
    """
    order = W.orderBy(F.desc("dice"), F.desc("hits"), "candidate_id")
    top = catalog.where("eligible").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    check = top.agg(F.count(F.lit(1)).alias("k"), F.count("content_hash").alias("h"), F.countDistinct("content_hash").alias("d"))
    ok = (F.col("k") == n) & (F.col("h") == n) & (F.col("d") == n)
    return top.crossJoin(F.broadcast(check.select(F.when(ok, True).otherwise(F.raise_error(F.lit(
        "roster needs n eligible candidates with distinct content hashes"))).alias("__ok")))).where("__ok").drop("__ok")


def merge_rosters(a: DataFrame, b: DataFrame, ready: DataFrame, need: int) -> DataFrame:
    """Candidates of two frozen rosters with where they come from and how many parts are ready.

    Equal ids with different hashes are a ``conflict``.
    """
    x = a.select("candidate_id", F.col("content_hash").alias("ha"), F.col("rank").alias("rank_a"))
    y = b.select("candidate_id", F.col("content_hash").alias("hb"), F.col("rank").alias("rank_b"))
    rows = x.join(y, "candidate_id", "full_outer")
    origin = (F.when(F.col("ha").isNull(), "second").when(F.col("hb").isNull(), "first").when(F.col("ha") == F.col("hb"), "both").otherwise("conflict"))
    done = ready.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("parts"))
    out = rows.join(done, "candidate_id", "left").fillna(0, ["parts"])
    return out.select("candidate_id", origin.alias("origin"), "rank_a", "rank_b", "parts", (F.col("parts") >= need).alias("ready"))
