"""F1-F16: descriptive, resampling and comparison statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelmeter.functions import (bucketed_row_number, exact_quantiles, finite, hash_rank, md5_int, ordered_counts, ratio, salted_join,
                                  trailing_window, two_proportion_p, wilson_high, wilson_low, with_buckets)
from voxelmeter.operators.masks import KEY
from voxelmeter.session import checkpointed

# Means compared for order are rounded so that summation order cannot decide.
TIE_DIGITS = 12


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, mean, sample variance and sd, R-7 quartiles, range, IQR and MAD."""
    rows = df.where(F.col(value).isNotNull())
    v = F.col(value).cast("double")
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.avg(v).alias("mean"),
        F.when(F.count(F.lit(1)) > 1, F.var_samp(v)).alias("sample_variance"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp(v)).alias("sample_sd"), F.min(v).alias("minimum"), F.max(v).alias("maximum"))
    # Both quantile passes work on counted values, which are kept once.
    counted = checkpointed(rows.groupBy(*by, v.alias("__v")).agg(F.count(F.lit(1)).alias("__c")))
    qs = checkpointed(exact_quantiles(counted, by, "__v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, weight=F.col("__c")))
    near = counted.join(qs.select(*by, "median"), by) if by else counted.crossJoin(F.broadcast(qs.select("median")))
    mad = exact_quantiles(near.withColumn("__dev", F.abs(F.col("__v") - F.col("median"))), by, "__dev", {"mad": 0.5}, weight=F.col("__c"))
    out = base.join(qs, by).join(mad, by) if by else base.crossJoin(F.broadcast(qs)).crossJoin(F.broadcast(mad))
    return out.withColumn("range", F.col("maximum") - F.col("minimum")).withColumn("iqr", F.col("q3") - F.col("q1"))


def top_values(df: DataFrame, value: str, by: list[str], n: int, digits: int | None = None) -> DataFrame:
    """the n most frequent (optionally rounded) values of each group; ties to the lower value."""
    v = F.round(F.col(value), digits) if digits is not None else F.col(value)
    counts = df.groupBy(*by, v.alias(value)).agg(F.count(F.lit(1)).alias("n"))
    # Keep n per task slice first, so the final ranking sees few rows of a group.
    part = F.pmod(F.xxhash64(value), F.lit(64))
    order = [F.desc("n"), F.asc(value)]
    local = counts.withColumn("__p", part).withColumn("__r", F.row_number().over(W.partitionBy(*by, "__p").orderBy(*order))).where(f"__r <= {n}")
    return local.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(f"rank <= {n}").drop("__p", "__r")


# ------------------------------------------------------------------ F2-F3 bootstrap

def cluster_bootstrap(df: DataFrame, cluster: str, values: list[str], draws: int, seed: int, mode: str = "pooled",
                      confidence: float = 0.95) -> DataFrame:
    """percentile interval of a mean when whole clusters are resampled.

    Clusters are reduced to (sum, n) first. Slot ``s`` of draw ``d`` takes cluster number
    ``md5(seed:d:s) mod clusters`` in a seeded hash order, so the result depends on neither
    row order nor partitioning. ``pooled`` divides sums by counts, ``equal_case`` averages
    cluster means. Nulls are left out with their clusters kept.
    """
    if mode not in ("pooled", "equal_case"):
        raise ValueError(f"unknown bootstrap mode {mode!r}")
    per = df.groupBy(cluster).agg(*[F.sum(F.col(v).cast("double")).alias(f"{v}__s") for v in values],
                                  *[F.count(v).alias(f"{v}__n") for v in values])
    ranked = hash_rank(per, [], seed, [cluster], "__rn").withColumn("__rn", F.col("__rn") - 1)
    size = per.count()
    num = lambda v: F.col(f"{v}__s") if mode == "pooled" else F.when(F.col(f"{v}__n") > 0, F.col(f"{v}__s") / F.col(f"{v}__n"))
    den = lambda v: F.col(f"{v}__n") if mode == "pooled" else (F.col(f"{v}__n") > 0).cast("bigint")
    slim = ranked.select("__rn", *[F.coalesce(num(v), F.lit(0.0)).alias(f"{v}__s") for v in values], *[den(v).alias(f"{v}__n") for v in values])
    slots = df.sparkSession.range(draws * size).select(F.expr(f"id div {size}").alias("draw"), (F.col("id") % size).alias("slot"))
    picks = slots.select("draw", (md5_int(seed, "draw", "slot") % F.lit(size)).alias("__rn"))
    sums = picks.join(slim, "__rn").groupBy("draw").agg(*[F.sum(f"{v}__{c}").alias(f"{v}__{c}") for v in values for c in "sn"])
    alpha = (1 - confidence) / 2
    per_draw = sums.select("draw", F.explode(F.array(*[
        F.struct(F.lit(v).alias("metric"), ratio(f"{v}__s", f"{v}__n").alias("m")) for v in values])).alias("x")).select("draw", "x.*")
    # One row per draw and metric: the number of draws bounds the buffer of percentile.
    spread = per_draw.groupBy("metric").agg(
        F.avg("m").alias("bootstrap_mean"), F.percentile("m", F.lit(alpha)).alias("ci_low"), F.percentile("m", F.lit(1 - alpha)).alias("ci_high"),
        F.count("m").alias("valid_draws"))
    whole = slim.agg(*[F.sum(f"{v}__{c}").alias(f"{v}__{c}") for v in values for c in "sn"],
                     *[F.count_if(F.col(f"{v}__n") > 0).alias(f"{v}__c") for v in values])
    obs = per.agg(*[F.sum(f"{v}__n").alias(f"{v}__o") for v in values])
    stats = whole.crossJoin(obs).select(F.explode(F.array(*[
        F.struct(F.lit(v).alias("metric"), ratio(f"{v}__s", f"{v}__n").alias("estimate"), F.col(f"{v}__c").alias("clusters_with_values"),
                 F.col(f"{v}__o").alias("observations")) for v in values])).alias("x")).select("x.*")
    return stats.join(spread, "metric", "left").withColumn("draws", F.lit(draws)).withColumn("clusters", F.lit(size).cast("bigint"))


def paired_bootstrap(a: DataFrame, b: DataFrame, key: list[str], cluster: str, value: str, draws: int, seed: int) -> DataFrame:
    """the same for the difference b - a on rows present in both."""
    rows = a.select(*key, F.col(value).alias("__a")).join(b.select(*key, F.col(value).alias("__b")), key)
    return cluster_bootstrap(rows.withColumn("delta", F.col("__b") - F.col("__a")), cluster, ["delta"], draws, seed)


# ------------------------------------------------------------------ F4-F7 proportions

def wilson(df: DataFrame, k: str, n: str) -> DataFrame:
    """Wilson interval columns."""
    return df.withColumn("ci_low", wilson_low(k, n)).withColumn("ci_high", wilson_high(k, n))


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], name: str = "p_adjusted") -> DataFrame:
    """step-up adjusted p values per family of tests, capped at 1.

    Tests with equal p share the largest rank; distinct p values of a family are split over
    ordered buckets, with bucket minima carried from the top.
    """
    ranked = ordered_counts(df, by, p)
    ranked = ranked.withColumn("__q", F.least(F.lit(1.0), F.col(p) * F.col("total") / F.col("cum")))
    tagged = with_buckets(ranked, by, p)
    span = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    later = tagged.groupBy(*by, "__b").agg(F.min("__q").alias("__m")).select(
        *by, "__b", F.min("__m").over(span.orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, -1)).alias("__m"))
    inner = W.partitionBy(*by, "__b").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    adj = tagged.join(later, [*by, "__b"]).select(*by, p, F.least(F.min("__q").over(inner), F.coalesce("__m", F.lit(1.0))).alias(name))
    return df.join(adj, [*by, p])


def two_prop(df: DataFrame, k1: str, n1: str, k2: str, n2: str, name: str = "p_value") -> DataFrame:
    """two-sided pooled z test."""
    return df.withColumn(name, two_proportion_p(k1, n1, k2, n2))


def _shares(a: DataFrame, b: DataFrame, bins: list[str], by: list[str]) -> DataFrame:
    both = a.select(*by, *bins, F.col("n").alias("a"), F.lit(0).cast("double").alias("b")).union(
        b.select(*by, *bins, F.lit(0).cast("double"), F.col("n"))).groupBy(*by, *bins).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = both.groupBy(*by).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    rows = both.join(totals, by) if by else both.crossJoin(F.broadcast(totals))
    return rows.select(*by, *bins, (F.col("a") / F.col("ta")).alias("pa"), (F.col("b") / F.col("tb")).alias("pb"))


def distances(a: DataFrame, b: DataFrame, bins: list[str], by: list[str] = ()) -> DataFrame:
    """total variation and Jensen-Shannon distance (bits) of two histograms with counts ``n``."""
    rows = _shares(a, b, list(bins), list(by))
    mid = (F.col("pa") + F.col("pb")) / 2
    kl = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / mid)).otherwise(0.0))
    return rows.groupBy(*by).agg((0.5 * F.sum(F.abs(F.col("pa") - F.col("pb")))).alias("total_variation"),
                                 (0.5 * (kl("pa") + kl("pb"))).alias("jensen_shannon_bits"))


def mean_distance(parts: dict[str, tuple[DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """total variation of several histograms and their mean."""
    out = None
    for name, (a, b, bins) in parts.items():
        d = distances(a, b, bins).select(F.lit(name).alias("histogram"), "total_variation")
        out = d if out is None else out.union(d)
    mean = out.agg(F.lit("mean").alias("histogram"), F.avg("total_variation").alias("total_variation"))
    return out.union(mean)


def split_audit(findings: DataFrame, categories: list[str], left: str = "val", right: str = "test", extra: str = "train") -> DataFrame:
    """category shares per split with intervals, tests and a shift flag.

    A shift is an absolute change of 0.02 or a ratio outside 2/3..3/2; with fewer than 5
    findings on a side a ratio shift is only a warning.
    """
    spark = findings.sparkSession
    splits = [extra, left, right]
    names = spark.createDataFrame([(c,) for c in categories], "category string")
    counts = findings.groupBy("category").agg(*[F.count_if(F.col("split") == s).alias(f"{s}_count") for s in splits])
    totals = findings.agg(*[F.count_if(F.col("split") == s).alias(f"{s}_total") for s in splits])
    rows = F.broadcast(names).join(counts, "category", "left").fillna(0).crossJoin(F.broadcast(totals))
    for s in splits:
        rows = rows.withColumn(f"{s}_ratio", F.col(f"{s}_count") / F.col(f"{s}_total"))
    for s in (left, right):
        rows = rows.withColumn(f"{s}_low", wilson_low(f"{s}_count", f"{s}_total")).withColumn(f"{s}_high", wilson_high(f"{s}_count", f"{s}_total"))
    rows = two_prop(rows, f"{left}_count", f"{left}_total", f"{right}_count", f"{right}_total")
    rows = benjamini_hochberg(rows, "p_value", [])
    lr, rr = F.col(f"{left}_ratio"), F.col(f"{right}_ratio")
    quotient = ratio(rr, lr)
    trigger = F.when(lr == 0, rr > 0).otherwise((quotient < 2 / 3) | (quotient > 3 / 2))
    few = F.least(F.col(f"{left}_count"), F.col(f"{right}_count")) < 5
    flag = (F.when(F.abs(rr - lr) >= 0.02, "VAL-TEST SHIFT").when(trigger & few, "LOW-COUNT SHIFT WARNING")
            .when(trigger, "VAL-TEST SHIFT").otherwise(""))
    return rows.select(
        "category", *[f"{s}_{c}" for s in splits for c in ("count", "ratio")], *[f"{s}_{c}" for s in (left, right) for c in ("low", "high")],
        (100 * (rr - lr)).alias("difference_points"), quotient.alias("ratio"), "p_value", "p_adjusted",
        (F.col("p_adjusted") < 0.05).alias("significant"), flag.alias("shift_flag"))


# ------------------------------------------------------------------ F8-F11 agreement

def midrank(df: DataFrame, value: str, by: list[str], digits: int = TIE_DIGITS) -> DataFrame:
    """F8: tie-aware percentile 100 (less + equal / 2) / n of every value inside its group."""
    rows = df.withColumn("__v", F.round(F.col(value), digits))
    ranked = ordered_counts(rows, by, "__v")
    at = ranked.select(*by, "__v", (F.col("cum") - F.col("cnt")).alias("less"), F.col("cnt").alias("equal"), (F.col("total") - F.col("cum")).alias("greater"),
                       (100.0 * (F.col("cum") - F.col("cnt") / 2) / F.col("total")).alias("percentile"))
    return rows.join(at, [*by, "__v"]).drop("__v")  # both sides may be large; a hot value is split by adaptive execution


def sign_agreement(df: DataFrame, by: list[str], first: str, second: str, tolerance: float = 1e-12) -> DataFrame:
    """F8: direction agreement and correlation of two aligned delta columns."""
    s = lambda c: F.when(F.col(c) > tolerance, 1).when(F.col(c) < -tolerance, -1).otherwise(0)
    both = s(first) * s(second)
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(both > 0).alias("same_nonzero_direction"), F.count_if(both < 0).alias("opposite_direction"),
        F.count_if(both == 0).alias("at_least_one_zero"), F.corr(first, second).alias("__r"))
    return out.withColumn("same_direction_fraction", F.col("same_nonzero_direction") / F.col("n")).withColumn(
        "pearson", F.when(~F.isnan("__r"), F.col("__r"))).drop("__r")


def rms(df: DataFrame, by: list[str], delta: str, weight: str) -> DataFrame:
    """F8: support-weighted and plain root mean square of deltas."""
    d2 = F.col(delta) * F.col(delta)
    return df.groupBy(*by).agg(F.sqrt(F.sum(F.col(weight) * d2) / F.sum(weight)).alias("weighted_rms"), F.sqrt(F.avg(d2)).alias("macro_rms"))


def model_pair_deltas(per: DataFrame, keep: list[str]) -> DataFrame:
    """Category deltas of every two candidates; ``per`` has one row per (candidate, category).

    Pairs come from the short candidate array of a category.
    """
    rows = per.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("candidate_id", *keep))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter(F.col("m"), lambda b: b["candidate_id"] > a["candidate_id"]),
                                                             lambda b: F.struct(a.alias("a"), b.alias("b")))))
    out = rows.select("category", F.explode(pairs).alias("p"))
    return out.select("category", F.col("p.a.candidate_id").alias("first"), F.col("p.b.candidate_id").alias("second"),
                      *[(F.col(f"p.b.{k}") - F.col(f"p.a.{k}")).alias(f"delta_{k}") for k in keep])


def _category_means(evals: DataFrame, extra: list[str] = ()) -> DataFrame:
    return evals.groupBy(*extra, "candidate_id", "category").agg(
        F.avg("dice").alias("dice"), F.avg(F.col("hit").cast("double")).alias("hit"), F.count(F.lit(1)).alias("n"))


def fidelity_of(means: DataFrame, full: DataFrame, groups: DataFrame, by: list[str] = ()) -> DataFrame:
    """error of subset category means against full ones, and of deltas inside model groups.

    ``groups`` maps each candidate to its group; both tables are (candidate, category) sized.
    """
    by = list(by)
    rows = means.select(*by, "candidate_id", "category", F.col("dice").alias("sd"), F.col("hit").alias("sh")).join(
        full.select("candidate_id", "category", F.col("dice").alias("fd"), F.col("hit").alias("fh")), ["candidate_id", "category"])
    rows = rows.join(F.broadcast(groups), "candidate_id")
    per_cat = rows.groupBy(*by, "category").agg(F.sqrt(F.avg(F.pow(F.col("sd") - F.col("fd"), F.lit(2.0)))).alias("rd"),
                                                F.sqrt(F.avg(F.pow(F.col("sh") - F.col("fh"), F.lit(2.0)))).alias("rh"))
    out = per_cat.groupBy(*by).agg(*[x for c, n in (("rd", "dice"), ("rh", "hit")) for x in (
        F.avg(c).alias(f"macro_{n}_rmse"), F.percentile(c, F.lit(0.9)).alias(f"p90_{n}_rmse"), F.max(c).alias(f"worst_{n}_rmse"))])
    arr = rows.groupBy(*by, "group", "category").agg(F.sort_array(F.collect_list(F.struct("candidate_id", "sd", "fd", "sh", "fh"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter(F.col("m"), lambda b: b["candidate_id"] > a["candidate_id"]),
                                                             lambda b: F.struct(a.alias("a"), b.alias("b")))))
    d = arr.select(*by, F.explode(pairs).alias("p"))
    gap = lambda c: F.round(F.col(f"p.a.{c}") - F.col(f"p.b.{c}"), TIE_DIGITS)
    aggs = []
    for s, f, n in (("sd", "fd", "dice"), ("sh", "fh", "hit")):
        aggs.append(F.sqrt(F.avg(F.pow(gap(s) - gap(f), F.lit(2.0)))).alias(f"{n}_delta_rmse"))
        aggs.append(F.avg(F.when(gap(f) != 0, (F.signum(gap(s)) == F.signum(gap(f))).cast("double"))).alias(f"{n}_sign_agreement"))
    deltas = d.groupBy(*by).agg(*aggs)
    out = out.join(deltas, by, "left") if by else out.crossJoin(F.broadcast(deltas))
    return out.fillna({"dice_delta_rmse": 0.0, "hit_delta_rmse": 0.0, "dice_sign_agreement": 1.0, "hit_sign_agreement": 1.0})


def subset_fidelity(evals: DataFrame, cases: DataFrame, groups: DataFrame) -> DataFrame:
    """:func:`fidelity_of` a subset of cases."""
    picked = evals.join(cases.select("case_id"), "case_id", "left_semi")
    return fidelity_of(_category_means(picked), _category_means(evals), groups)


def bias_decomposition(evals: DataFrame, cases: DataFrame) -> DataFrame:
    """subset minus full mean, split into composition and within-category effect.

    Averaged over candidates, for dice and hit rate.
    """
    tagged = evals.join(cases.select("case_id").distinct().withColumn("s", F.lit(True)), "case_id", "left")
    s = F.col("s").isNotNull()
    h = F.col("hit").cast("double")
    per = tagged.groupBy("candidate_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s).alias("m"), F.avg("dice").alias("dice"), F.avg(h).alias("hit"),
        F.sum(F.when(s, F.col("dice")).otherwise(0.0)).alias("dice_s"), F.sum(F.when(s, h).otherwise(0.0)).alias("hit_s"))
    one = per.groupBy("candidate_id").agg(*[x for v in ("dice", "hit") for x in (
        (F.sum(F.col(v) * F.col("n")) / F.sum("n")).alias(f"{v}_full"), (F.sum(F.col(v) * F.col("m")) / F.sum("m")).alias(f"{v}_mix"),
        (F.sum(f"{v}_s") / F.sum("m")).alias(f"{v}_raw"))])
    flat = one.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("metric"), (F.col(f"{v}_raw") - F.col(f"{v}_full")).alias("t"), (F.col(f"{v}_mix") - F.col(f"{v}_full")).alias("c"),
        (F.col(f"{v}_raw") - F.col(f"{v}_mix")).alias("w")) for v, n in (("dice", "dice"), ("hit", "hit_rate"))])).alias("x")).select("x.*")
    return flat.groupBy("metric").agg(F.avg("t").alias("total_bias"), F.avg("c").alias("composition_effect"), F.avg("w").alias("within_category_effect"))


def pareto(df: DataFrame, x: str, y: str) -> DataFrame:
    """rows not dominated in (x, y), lower is better.

    Only the best y per x can be on the frontier; its running minimum is taken over ordered
    buckets of x with bucket minima carried forward, so no theta join is needed.
    """
    best = df.groupBy(x).agg(F.min(y).alias("__y"))
    tagged = with_buckets(best, [], x)
    carry = tagged.groupBy("__b").agg(F.min("__y").alias("__m")).select(
        "__b", F.min("__m").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)).alias("__m"))
    before = F.min("__y").over(W.partitionBy("__b").orderBy(x).rowsBetween(W.unboundedPreceding, -1))
    front = tagged.join(carry, "__b").withColumn("__p", F.least(before, F.col("__m"))).where(
        F.col("__p").isNull() | (F.col("__y") < F.col("__p"))).select(x, F.col("__y").alias(y))
    return df.join(front, [x, y], "left_semi")


def knee(front: DataFrame, x: str, y: str, x_max: float, tie: list[str] = ()) -> DataFrame:
    """frontier point furthest above the falling diagonal of the scaled plane."""
    ends = front.agg(F.min(x).alias("__x0"), F.max(y).alias("__y1"))
    rows = front.crossJoin(F.broadcast(ends))
    dist = 1.0 - (F.col(x) - F.col("__x0")) / (F.lit(float(x_max)) - F.col("__x0")) - F.col(y) / F.when(F.col("__y1") > 0, F.col("__y1")).otherwise(1.0)
    rows = rows.withColumn("distance", dist)
    pick = F.max_by(F.struct(*front.columns, "distance"), F.struct(F.round("distance", TIE_DIGITS), -F.col(x), *[-F.col(t) for t in tie]))
    return rows.agg(pick.alias("k")).select("k.*")


def first_acceptable(front: DataFrame, x: str, y: str, limits: dict[str, float], at_least: float, at_most: float) -> DataFrame:
    """cheapest frontier point within all limits."""
    ok = front.where(F.col(x).between(at_least, at_most))
    for c, limit in limits.items():
        ok = ok.where(F.col(c) <= limit)
    return ok.agg(F.min_by(F.struct(*front.columns), F.struct(x, y)).alias("a")).where("a is not null").select("a.*")


# ------------------------------------------------------------------ F12-F14 populations

def size_bins(df: DataFrame, value: str, bins: list[tuple[str, float, float | None]], split: str, by: list[str]) -> DataFrame:
    """counts per half-open bin and group, per split and for all splits together.

    Every bin appears for every group that has findings.
    """
    v = F.col(value)
    label = F.lit(None).cast("string")
    for name, lo, hi in reversed(bins):
        label = F.when((v >= lo) & (v < hi) if hi is not None else v >= lo, name).otherwise(label)
    rows = df.select(*by, label.alias("bin"), F.explode(F.array(F.col(split), F.lit("all"))).alias("split"))
    counts = rows.groupBy(*by, "split", "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by, "split").agg(F.sum("n").alias("total"))
    grid = totals.withColumn("bin", F.explode(F.array(*[F.lit(b[0]) for b in bins])))
    return grid.join(counts, [*by, "split", "bin"], "left").fillna(0, ["n"]).select(
        *by, "split", "bin", "n", (F.col("n") / F.col("total")).alias("fraction"))


def ecdf(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """share of values at or below each distinct value."""
    return ordered_counts(df, by, value).select(*by, value, F.col("cnt").alias("n"), (F.col("cum") / F.col("total")).alias("ecdf"))


def difficulty_strata(evals: DataFrame) -> DataFrame:
    """findings of a category in 3, 2 or 1 difficulty bins by support (40, 12).

    Ordered by mean dice over candidates, mean hit, then key; the first bins take the
    remainder.
    """
    per = evals.groupBy(*KEY, "category").agg(F.round(F.avg("dice"), TIE_DIGITS).alias("d"), F.round(F.avg(F.col("hit").cast("double")), TIE_DIGITS).alias("h"))
    tagged = with_buckets(per, ["category"], "d")
    ranked = bucketed_row_number(tagged, ["category"], F.col("__b"), ["d", "h", *KEY], "rn", "size")
    bins = F.when(F.col("size") >= 40, 3).when(F.col("size") >= 12, 2).otherwise(1)
    quota, extra = F.floor(F.col("size") / bins), F.col("size") % bins
    edge = extra * (quota + 1)
    place = F.when(F.col("rn") <= edge, F.floor((F.col("rn") - 1) / (quota + 1))).otherwise(extra + F.floor((F.col("rn") - 1 - edge) / quota))
    return ranked.select(*KEY, "category", F.col("d").alias("mean_dice"), F.col("h").alias("mean_hit"), place.cast("int").alias("difficulty_bin"),
                         bins.alias("bins"))


def strata_summary(strata: DataFrame) -> DataFrame:
    """size and mean difficulty of each stratum."""
    return strata.groupBy("category", "difficulty_bin", "bins").agg(
        F.count(F.lit(1)).alias("findings"), F.avg("mean_dice").alias("mean_dice"), F.avg("mean_hit").alias("mean_hit_rate"))


def population_compare(findings: DataFrame, category: str, left: str = "train", right: str = "val") -> DataFrame:
    """rates of one category in two splits and their difference."""
    is_cat = F.col("category") == category
    per_case = findings.where(F.col("split").isin(left, right)).groupBy("split", "case_id").agg(
        F.count_if(is_cat).alias("f"), F.sum(F.when(is_cat, F.col("entities")).otherwise(0)).alias("e"))
    agg = per_case.groupBy("split").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("f") > 0).alias("positive_cases"),
                                        F.sum("f").alias("findings"), F.sum("e").alias("entities"))
    metrics = {"cases": F.col("cases"), "positive_cases": F.col("positive_cases"), "case_rate": ratio("positive_cases", "cases"),
               "findings": F.col("findings"), "findings_per_case": ratio("findings", "cases"),
               "findings_per_positive_case": ratio("findings", "positive_cases"), "entities": F.col("entities"),
               "entities_per_finding": ratio("entities", "findings"), "entities_per_case": ratio("entities", "cases"),
               "entities_per_positive_case": ratio("entities", "positive_cases")}
    flat = agg.select("split", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("v")) for n, v in metrics.items()])).alias("x"))
    pick = lambda s: F.max(F.when(F.col("split") == s, F.col("x.v")))
    return flat.groupBy(F.col("x.metric").alias("metric")).agg(pick(left).alias(f"{left}_value"), pick(right).alias(f"{right}_value"),
                                                               (pick(right) - pick(left)).alias("difference"))


def entity_distribution(findings: DataFrame, by: list[str]) -> DataFrame:
    """findings with 1, 2, 3 or 4+ entities per group; all four buckets are kept."""
    names = ["1", "2", "3", "4+"]
    bucket = F.when(F.col("entities") >= 4, "4+").otherwise(F.col("entities").cast("string"))
    counts = findings.groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("findings"))
    totals = counts.groupBy(*by).agg(F.sum("findings").alias("total")).withColumn("bucket", F.explode(F.array(*[F.lit(n) for n in names])))
    return totals.join(counts, [*by, "bucket"], "left").fillna(0, ["findings"]).select(
        *by, "bucket", "findings", (F.col("findings") / F.col("total")).alias("fraction"))


# ------------------------------------------------------------------ F15-F16

def rolling(df: DataFrame, by: list[str], index: str, value: str, window: int = 100, by_range: bool = False) -> DataFrame:
    """trailing mean of finite values over the last ``window`` rows or index values; null without any."""
    v = F.when(finite(value), F.col(value))
    return trailing_window(df.withColumn("__v", v), by, index, window, {
        "rolling_mean": lambda w: F.avg("__v").over(w), "rolling_n": lambda w: F.count("__v").over(w)}, by_range=by_range).drop("__v")


def curve_stats(df: DataFrame, by: list[str], index: str, value: str, window: int = 100) -> DataFrame:
    """first and last ``window`` finite values of a curve, overall mean and maximum."""
    ok = df.where(finite(value)).select(*by, index, value)
    ranked = bucketed_row_number(ok, by, F.floor(F.col(index) / 10_000), [index], "rn", "size")
    v = F.col(value)
    stats = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("finite_observations"), F.avg(F.when(F.col("rn") <= window, v)).alias("first_mean"),
        F.avg(F.when(F.col("rn") > F.col("size") - window, v)).alias("last_mean"), F.avg(v).alias("overall_mean"), F.max(v).alias("maximum"))
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("observations"))
    out = total.join(stats, by, "left").fillna(0, ["finite_observations"])
    return out.withColumn("nonfinite_observations", F.col("observations") - F.col("finite_observations")).withColumn(
        "relative_change", ratio(F.col("last_mean") - F.col("first_mean"), "first_mean"))


def poststratify(evals: DataFrame, weights: DataFrame) -> DataFrame:
    """F16: category means re-weighted by a target mix beside the raw mean.

    ``weights`` has ``category, weight``; a weighted category without rows makes the estimate
    null and is counted in ``uncovered``.
    """
    per = _category_means(evals)
    candidates = per.select("candidate_id").distinct()
    grid = candidates.crossJoin(F.broadcast(weights.where("weight > 0")))
    rows = grid.join(per, ["candidate_id", "category"], "left")
    raw = per.groupBy("candidate_id").agg((F.sum(F.col("dice") * F.col("n")) / F.sum("n")).alias("raw_dice"),
                                          (F.sum(F.col("hit") * F.col("n")) / F.sum("n")).alias("raw_hit_rate"), F.sum("n").alias("findings"))
    hole = F.count_if(F.col("n").isNull())
    full = lambda c: F.when(hole == 0, F.sum(F.col("weight") * F.col(c)) / F.sum("weight"))
    out = rows.groupBy("candidate_id").agg(full("dice").alias("weighted_dice"), full("hit").alias("weighted_hit_rate"), hole.alias("uncovered"))
    return raw.join(out, "candidate_id")
