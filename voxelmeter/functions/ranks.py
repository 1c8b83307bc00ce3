"""Exact ranks, running sums and quantiles that never put one group into one task.

A plain ``row_number() over (partition by g order by x)`` sorts a whole group in
one task, and ``percentile`` keeps every distinct value of a group in one buffer.
These helpers split each group into ordered buckets first: bucket totals are
small and give offsets, the rest of the work is per (group, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelmeter.functions.columns import sha_unit
from voxelmeter.session import checkpointed

__all__ = ["bucketed_row_number", "hash_rank", "hash_smallest", "with_buckets", "tied_row_number", "ordered_counts",
           "exact_quantiles", "quantiles_of_counts", "salted_join", "trailing_window"]


def bucketed_row_number(df: DataFrame, by: list[str], bucket: Column, order: list, name: str = "rn",
                        keep_size: str | None = None) -> DataFrame:
    """1-based row number inside ``by``; ``bucket`` must be monotone in ``order``.

    ``keep_size`` also adds the group size under that name.
    """
    df = df.withColumn("__b", bucket)
    span = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    totals = df.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    totals = totals.withColumn(
        "__off", F.coalesce(F.sum("__n").over(
            span.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    if keep_size:
        totals = totals.withColumn(keep_size, F.sum("__n").over(span))
    within = W.partitionBy(*by, "__b").orderBy(*order)
    out = df.join(totals.drop("__n"), [*by, "__b"]).withColumn(name, F.col("__off") + F.row_number().over(within))
    return out.drop("__b", "__off")


def hash_rank(df: DataFrame, by: list[str], seed, keys: list[str], name: str = "rn",
              buckets: int = 1024, keep_size: str | None = None) -> DataFrame:
    """Seeded random order inside ``by``: rank by ``sha_unit(seed, keys)``, ties by key."""
    df = df.withColumn("__u", sha_unit(seed, *keys))
    out = bucketed_row_number(df, by, F.floor(F.col("__u") * buckets), ["__u", *keys], name, keep_size)
    return out.drop("__u")


def hash_smallest(df: DataFrame, n: int, seed, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Seeded fixed-size subset without collecting ``n`` rows anywhere."""
    return hash_rank(df, by or [], seed, keys).where(F.col("rn") <= n).drop("rn")


def with_buckets(counted: DataFrame, by: list[str], value: str, buckets: int = 64) -> DataFrame:
    """Tag each (group, value) row with an ordered bucket: the number of approximate cut points below it.

    The cuts only balance the work; correctness needs nothing but their order, and that both sides of a later join see the same ones.
    They are written once, as approximate percentiles worked out again may differ.
    """
    cuts = [i / buckets for i in range(1, buckets)]
    edges = checkpointed(counted.groupBy(*by).agg(F.percentile_approx(value, cuts, 2000).alias("__edges")), shuffled=bool(by))
    joined = counted.join(edges, by) if by else counted.crossJoin(edges)

    below = F.size(F.filter("__edges", lambda e: e < F.col(value)))
    return joined.withColumn("__b", below).drop("__edges")


def tied_row_number(df: DataFrame, by: list[str], value: str, key: str, name: str = "rn") -> DataFrame:
    """1-based row number inside ``by`` in order of (value, key), where one value may hold most rows.

    Values are counted first and give offsets; rows of one value are ranked by ``key``, a number, in buckets of their own.
    """
    offsets = ordered_counts(df, by, value).select(*by, value, (F.col("cum") - F.col("cnt")).alias("__before"))
    inside = with_buckets(df, [*by, value], key, 256)
    ranked = bucketed_row_number(inside, [*by, value], F.col("__b"), [key], "__rank")
    return ranked.join(offsets, [*by, value]).withColumn(name, F.col("__before") + F.col("__rank")).drop("__before", "__rank")


def ordered_counts(df: DataFrame, by: list[str], value: str, weight: Column | None = None,
                   buckets: int = 64) -> DataFrame:
    """(by, value, cnt, cum, total): running counts over sorted distinct values, skew-safe.

    Equal values collapse in the map-side aggregate, so a hot value is one row.
    """
    w = F.lit(1) if weight is None else weight
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(w).alias("cnt"))
    tagged = with_buckets(counted, by, value, buckets)
    span = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    totals = tagged.groupBy(*by, "__b").agg(F.sum("cnt").alias("__n"))
    totals = totals.select(
        *by, "__b",
        F.coalesce(F.sum("__n").over(span.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("__off"),
        F.sum("__n").over(span).alias("total"))
    inner = W.partitionBy(*by, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return (tagged.join(totals, [*by, "__b"])
            .withColumn("cum", F.col("__off") + F.sum("cnt").over(inner))
            .drop("__b", "__off"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
                    buckets: int = 64, weight: Column | None = None) -> DataFrame:
    """Linear-interpolation (R-7) quantiles per group, one column per ``probs`` entry.

    ``weight`` is an integer multiplicity for rows that are already counted.
    """
    return quantiles_of_counts(ordered_counts(df, by, value, weight, buckets), by, value, probs)


def quantiles_of_counts(ranked: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """The same from :func:`ordered_counts` output."""
    aggs = []
    for name, p in probs.items():
        target = F.lit(float(p)) * (F.col("total") - 1)
        for side, rank in (("lo", F.floor(target)), ("hi", F.ceil(target))):
            covers = (F.col("cum") - F.col("cnt") <= rank) & (F.col("cum") > rank)
            aggs.append(F.max(F.when(covers, F.col(value))).alias(f"__{name}_{side}"))
    aggs.append(F.max("total").alias("__t"))
    flat = ranked.groupBy(*by).agg(*aggs)
    outs = []
    for name, p in probs.items():
        target = F.lit(float(p)) * (F.col("__t") - 1)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        outs.append((lo + (target - F.floor(target)) * (hi - lo)).cast("double").alias(name))
    return flat.select(*by, *outs)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner",
                salts: int = 16) -> DataFrame:
    """Equi-join where a few keys of ``left`` may hold a large share of its rows.

    ``right`` is small beside ``left`` (per case, group or finding) and is repeated ``salts`` times;
    ``left`` rows pick a salt from ``spread``. Left-preserving join types only. The repeats are shuffled, never broadcast: Spark's
    size estimate does not count them.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"salted_join cannot do {how}")
    left = left.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, "__salt"], how).drop("__salt")


def trailing_window(df: DataFrame, by: list[str], index: str, lookback: int,
                    exprs: dict[str, callable], chunk: int = 10_000, by_range: bool = False) -> DataFrame:
    """Window aggregates over the last ``lookback`` index values, bounded per task.

    ``index`` is an integer position unique inside ``by``. Each group is cut into
    chunks of ``chunk`` positions; a row is copied into the next chunk when it lies
    within reach of it, so each chunk can be computed alone and exactly. ``exprs``
    maps an output name to a function of the window spec. With ``by_range`` the
    frame is by index value; otherwise by rows, which needs a dense index.
    """
    own = F.floor(F.col(index) / F.lit(chunk))
    reach = F.floor((F.col(index) + F.lit(lookback - 1)) / F.lit(chunk))
    spread = (df.withColumn("__own", own)
              .withColumn("__chunk", F.explode(F.sequence(own, reach))))
    base = W.partitionBy(*by, "__chunk").orderBy(index)
    frame = base.rangeBetween(-(lookback - 1), 0) if by_range else base.rowsBetween(-(lookback - 1), 0)
    for name, build in exprs.items():
        spread = spread.withColumn(name, build(frame))
    return spread.where(F.col("__own") == F.col("__chunk")).drop("__own", "__chunk")
