"""Hash-seeded splits, subsets and sampling schedules.

Every draw is a hash of (seed, key), so results do not depend on row order, partitioning
or retries of lost tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelmeter.functions import (bucketed_row_number, exact_quantiles, hash_rank, hash_smallest, md5_int, sha_unit, tied_row_number, with_buckets)
from voxelmeter.operators import stats
from voxelmeter.operators.masks import KEY
from voxelmeter.session import checkpointed

TIE_DIGITS = 12


def stable_unit(df: DataFrame, seed: int | str, keys: list[str], name: str = "unit") -> DataFrame:
    """G1: uniform [0, 1) draw from the leading digits of sha256("seed:key")."""
    return df.withColumn(name, sha_unit(seed, *keys))


def fixed_subset(df: DataFrame, key: list[str], n: int, seed: int, order: list[str]) -> DataFrame:
    """N seeded rows with ``position`` in the original order of ``order``.

    Only the n picked rows, a size the caller fixes, are put in order.
    """
    return hash_smallest(df, n, seed, key).withColumn("position", F.row_number().over(W.orderBy(*order)) - 1)


def target_subset(findings: DataFrame, categories: list[str], base: DataFrame | None = None) -> DataFrame:
    """Cases that have a target category, with the cases of a base set; ``reason`` says why."""
    hits = findings.where(F.col("category").isin(categories)).select("case_id").distinct().withColumn("t", F.lit(True))
    rows = hits if base is None else hits.join(base.select("case_id").distinct().withColumn("b", F.lit(True)), "case_id", "full_outer")
    reason = F.lit("target") if base is None else F.when(F.col("t") & F.col("b"), "both").when(F.col("t"), "target").otherwise("base")
    return rows.select("case_id", reason.alias("reason"))


def complement(parent: DataFrame, subset: DataFrame, key: list[str]) -> DataFrame:
    """``subset``, ``complement`` or ``foreign`` (in the subset but not the parent) per key.

    The two parts are disjoint and exhaustive when no key is foreign.
    """
    both = parent.select(*key, F.lit(True).alias("p"), F.lit(False).alias("s")).union(subset.select(*key, F.lit(False), F.lit(True)))
    seen = both.groupBy(*key).agg(F.max("p").alias("p"), F.max("s").alias("s"))
    return seen.select(*key, F.when(F.col("p") & F.col("s"), "subset").when(F.col("p"), "complement").otherwise("foreign").alias("part"))


def grouped_kfold(findings: DataFrame, k: int, seed: int) -> DataFrame:
    """Cases to folds with even case, finding and category counts.

    Cases with the same number of findings of each category are interchangeable, so only their numbers matter: cases are put in order of
    rarity of their categories, then of that signature, then of a hash, and dealt to the folds in turn. Each
    signature, and the cases as a whole, then differ by at most one between folds.
    """
    if k < 2:
        raise ValueError("at least two folds are needed")
    tally = findings.groupBy("case_id", "category").agg(F.count(F.lit(1)).alias("c"))
    totals = tally.groupBy("category").agg(F.sum("c").alias("t"))
    per = tally.join(totals, "category").groupBy("case_id").agg(
        F.sum("c").alias("findings"), F.round(F.sum(F.col("c") / F.col("t")), TIE_DIGITS).alias("rarity"),
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "category", "c"))), ",").alias("signature"))
    keyed = checkpointed(per)
    signatures = keyed.groupBy("rarity", "signature").agg(F.count(F.lit(1)).alias("cases")).withColumn("neg", -F.col("rarity"))
    tagged = with_buckets(signatures, [], "neg")
    totals = tagged.groupBy("__b").agg(F.sum("cases").alias("n"))
    before = totals.select("__b", F.coalesce(F.sum("n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("off"))  # a row per bucket
    inner = W.partitionBy("__b").orderBy("neg", "signature").rowsBetween(W.unboundedPreceding, -1)
    starts = tagged.join(before, "__b").select("signature", (F.col("off") + F.coalesce(F.sum("cases").over(inner), F.lit(0))).alias("start"))
    ranked = hash_rank(keyed, ["signature"], seed, ["case_id"]).join(starts, "signature")
    return ranked.select("case_id", ((F.col("start") + F.col("rn") - 1) % k).cast("int").alias("fold"), "findings")


def shards(df: DataFrame, n: int, key: str, weight: str | None = None) -> DataFrame:
    """Round-robin over the key order; with a weight, longest first and there and back over the shards.

    The i-th block of ``n`` keys by falling weight (ties by key) goes to shards 0 to n - 1, or n - 1 to 0 in every
    other block, so loads differ by at most the largest weight.
    """
    if weight is None:
        tagged = with_buckets(df.select(key), [], key)
        return bucketed_row_number(tagged, [], F.col("__b"), [key], "pos").select(key, ((F.col("pos") - 1) % n).cast("int").alias("shard"))
    slim = df.select(key, F.col(weight).cast("bigint").alias(weight), (-F.col(weight)).cast("bigint").alias("neg"))
    ranked = tied_row_number(slim, [], "neg", key, "pos")
    place = (F.col("pos") - 1) % n
    back = F.floor((F.col("pos") - 1) / n) % 2 == 1
    return ranked.select(key, F.when(back, n - 1 - place).otherwise(place).cast("int").alias("shard"), weight)


def balanced_halves(findings: DataFrame, candidates: int, seed: int) -> DataFrame:
    """The best of many random halvings of patients.

    Compared by imbalance of findings, then cases, then size quartiles and entity bands, then
    candidate number. Quartiles are of the finding sizes.
    """
    cuts = exact_quantiles(findings, [], "pixels", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    rows = findings.crossJoin(F.broadcast(cuts))
    quart = sum(((F.col("pixels") >= F.col(q)).cast("int") for q in ("q1", "q2", "q3")), F.lit(0))
    band = F.when(F.col("entities") == 1, 0).when(F.col("entities") <= 3, 1).otherwise(2)
    feats = [F.count(F.lit(1)).alias("f0"), F.countDistinct("case_id").alias("f1"), *[F.count_if(quart == i).alias(f"f{2 + i}") for i in range(4)],
             *[F.count_if(band == i).alias(f"f{6 + i}") for i in range(3)]]
    per = checkpointed(rows.groupBy("patient").agg(*feats))
    names = [f"f{i}" for i in range(9)]
    total = per.agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    tries = per.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    ranked = hash_rank(tries, ["candidate"], seed, ["candidate", "patient"], "rn", 64, "size")
    half = ranked.where(F.col("rn") <= F.floor(F.col("size") / 2))
    sums = half.groupBy("candidate").agg(*[F.sum(c).alias(c) for c in names]).crossJoin(F.broadcast(total))
    gap = lambda c: F.abs(2 * F.col(c) - F.col(f"t_{c}"))
    best = sums.agg(F.min(F.struct(gap("f0").alias("findings_gap"), gap("f1").alias("cases_gap"),
                                   sum((gap(c) for c in names[2:]), F.lit(0)).alias("strata_gap"), F.col("candidate"))).alias("b")).select("b.*")
    chosen = ranked.join(F.broadcast(best), "candidate")
    return chosen.select("patient", F.when(F.col("rn") <= F.floor(F.col("size") / 2), "A").otherwise("B").alias("half"),
                         "candidate", "findings_gap", "cases_gap", "strata_gap")


def probe_candidates(strata: DataFrame, mandatory: DataFrame, budget: int, draws: int, seed: int) -> DataFrame:
    """Seeded case subsets of size ``budget`` that hold the mandatory cases and touch every stratum.

    A stratum without a mandatory case gets its lowest-hash case; the rest is filled by hash.
    Draws whose needs exceed the budget are left out.
    """
    cases = strata.select("case_id").distinct().join(mandatory.select("case_id").distinct().withColumn("m", F.lit(True)), "case_id", "left")
    open_ = strata.select("case_id", "stratum").distinct().join(mandatory.select("case_id").distinct(), "case_id", "left_semi").select("stratum").distinct()
    loose = strata.select("case_id", "stratum").distinct().join(open_, "stratum", "left_anti")
    number = F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    need = (loose.withColumn("draw", number).groupBy("draw", "stratum").agg(F.min_by("case_id", sha_unit(seed, "draw", "case_id")).alias("case_id"))
            .select("draw", "case_id").distinct().withColumn("need", F.lit(True)))
    rows = cases.withColumn("draw", number).join(need, ["draw", "case_id"], "left")
    tier = F.when(F.col("m"), 0).when(F.col("need"), 1).otherwise(2)
    rows = rows.withColumn("tier", tier).withColumn("u", sha_unit(seed, "draw", "case_id"))
    ranked = bucketed_row_number(rows, ["draw"], F.col("tier") * 64 + F.floor(F.col("u") * 64), ["tier", "u", "case_id"], "rn")
    forced = rows.where("tier < 2").groupBy("draw").agg(F.count(F.lit(1)).alias("forced"))
    ok = rows.select("draw").distinct().join(forced, "draw", "left").where(F.coalesce("forced", F.lit(0)) <= budget)
    return ranked.where(F.col("rn") <= budget).join(ok, "draw", "left_semi").select("draw", "case_id")


def probe_search(evals: DataFrame, strata: DataFrame, groups: DataFrame, budgets: list[int], cutoffs: list[int], draws: int, seed: int) -> DataFrame:
    """Per (budget, census cutoff) the candidate subset with the smallest error.

    All draws are scored in bulk against the full means by category error, delta error, sign
    penalty and distribution distance. ``held_error`` is the mean loss on each model group of
    the subset that the other groups would choose.
    """
    full = checkpointed(stats._category_means(evals))
    sizes = evals.select(*KEY, "category").distinct()
    population = sizes.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    names = sorted(r[0] for r in groups.select("group").distinct().collect())
    out = None
    for budget in budgets:
        for cutoff in cutoffs:
            rare = population.where(F.col("n") <= cutoff)
            must = sizes.join(F.broadcast(rare), "category", "left_semi").select("case_id").distinct()
            picks = checkpointed(probe_candidates(strata, must, budget, draws, seed + budget * 1009 + cutoff * 9176))
            means = checkpointed(stats._category_means(evals.join(picks, "case_id"), ["draw"]))
            tv = _draw_distance(picks, strata, sizes)
            scored = _draw_scores(means, full, groups, tv)
            best = scored.agg(F.min(F.struct("category_error", "delta_error", "sign_penalty", "distance", "draw", "loss")).alias("s")).select("s.*")
            if len(names) > 1:
                # Two or more model groups: choose without one, judge on it.
                total = None
                for g in names:
                    rest = _draw_scores(means, full, groups.where(F.col("group") != g), tv).agg(
                        F.min(F.struct("category_error", "delta_error", "sign_penalty", "distance", "draw")).alias("s")).select("s.draw")
                    held = _draw_scores(means.join(F.broadcast(rest), "draw"), full, groups.where(F.col("group") == g), tv).select(F.col("loss").alias("held"))
                    total = held if total is None else total.union(held)
                best = best.crossJoin(total.agg(F.avg("held").alias("held_error")))
            row = best.withColumn("budget", F.lit(budget)).withColumn("cutoff", F.lit(cutoff))
            out = row if out is None else out.unionByName(row)
    return out


def _draw_distance(picks: DataFrame, strata: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mean total variation of category, stratum and findings-per-case histograms of each draw."""
    per_case = sizes.groupBy("case_id").agg(F.count(F.lit(1)).cast("string").alias("bin"))
    kinds = (sizes.select("case_id", F.lit("c").alias("kind"), F.col("category").alias("bin"))
             .union(strata.select("case_id", F.lit("s"), F.col("stratum").cast("string")))
             .union(per_case.select("case_id", F.lit("f"), "bin")))
    whole = kinds.groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"))
    whole = whole.join(whole.groupBy("kind").agg(F.sum("n").alias("t")), "kind").select("kind", "bin", (F.col("n") / F.col("t")).alias("p"))
    part = kinds.join(picks, "case_id").groupBy("draw", "kind", "bin").agg(F.count(F.lit(1)).alias("n"))
    part = part.join(part.groupBy("draw", "kind").agg(F.sum("n").alias("t")), ["draw", "kind"]).select(
        "draw", "kind", "bin", (F.col("n") / F.col("t")).alias("q"))
    # Bins a draw lacks add their whole share: sum |p - q| = 1 + sum over its bins (|p - q| - p).
    both = part.join(whole, ["kind", "bin"]).withColumn("d", F.abs(F.col("p") - F.col("q")) - F.col("p"))
    return both.groupBy("draw", "kind").agg((0.5 * (1.0 + F.sum("d"))).alias("tv")).groupBy("draw").agg(
        F.round(F.avg("tv"), TIE_DIGITS).alias("distance"))


def _draw_scores(means: DataFrame, full: DataFrame, groups: DataFrame, tv: DataFrame) -> DataFrame:
    m = stats.fidelity_of(means, full, groups, ["draw"])
    err = sum((F.col(f"{w}_{n}_rmse") for w in ("macro", "p90", "worst") for n in ("dice", "hit")), F.lit(0.0))
    loss = sum((F.col(f"{w}_{n}_rmse") for w in ("macro", "p90") for n in ("dice", "hit")), F.lit(0.0)) / 4
    rnd = lambda c: F.round(c, TIE_DIGITS)
    return m.join(tv, "draw").select("draw", rnd(err).alias("category_error"), rnd(F.col("dice_delta_rmse") + F.col("hit_delta_rmse")).alias("delta_error"),
                                     rnd(2.0 - F.col("dice_sign_agreement") - F.col("hit_sign_agreement")).alias("sign_penalty"), "distance", rnd(loss).alias("loss"))


# ------------------------------------------------------------------ G7-G12 schedules

def allocate(weights: DataFrame, key: str, weight: str, total: int, how: str = "proportional") -> DataFrame:
    """Largest-remainder quotas of ``total``; equal remainders go to the larger key.

    ``how`` may be ``sqrt`` for square-root weights. Keys are categories or arms, so few.
    """
    w = F.sqrt(F.col(weight).cast("double")) if how == "sqrt" else F.col(weight).cast("double")
    rows = weights.select(key, w.alias("w"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.sum("w").alias("all")))).withColumn("raw", F.col("w") / F.col("all") * total)
    rows = rows.withColumn("base", F.floor("raw")).withColumn("frac", F.round(F.col("raw") - F.floor("raw"), TIE_DIGITS))
    left = rows.agg((F.lit(total) - F.sum("base")).alias("left"))
    ranked = rows.withColumn("rn", F.row_number().over(W.orderBy(F.desc("frac"), F.desc(key)))).crossJoin(F.broadcast(left))
    return ranked.select(key, "raw", (F.col("base") + (F.col("rn") <= F.col("left")).cast("bigint")).alias("quota"))


def _quota_of(rank: Column, quotas: dict[str, int]) -> Column:
    """Name whose cumulative quota first reaches the rank."""
    out, upto = None, 0
    steps = []
    for name, n in quotas.items():
        upto += n
        steps.append((upto, name))
    for upto, name in reversed(steps):
        out = F.lit(name) if out is None else F.when(rank <= upto, name).otherwise(out)
    return out


def block_schedule(pool: DataFrame, updates: int, sources: dict[str, int], modes: dict[str, int], seed: int, key: str = "key") -> DataFrame:
    """Per block exact quotas of sources and modes in hash-shuffled order, one pool row per update.

    ``pool`` has ``source``, the key and ``<mode>_n`` counts; a mode without rows for the picked
    key falls back to all of it. Quotas of sources and modes both sum to the block size.
    """
    block = sum(sources.values())
    if block != sum(modes.values()):
        raise ValueError("source and mode quotas must fill the same block")
    order = lambda tag: F.row_number().over(W.partitionBy("block").orderBy(md5_int(seed, F.lit(tag), "update"), "update"))
    # A partial last block draws from the shuffled full block, so shuffle positions, not rows.
    full = pool.sparkSession.range(-(-updates // block) * block).withColumnRenamed("id", "update").withColumn("block", F.floor(F.col("update") / block))
    steps = full.withColumn("source", _quota_of(order("source"), sources)).withColumn("mode", _quota_of(order("mode"), modes)).where(F.col("update") < updates)
    ranked = hash_rank(pool, ["source"], seed, [key], "pos", 64, "size")
    sizes = ranked.groupBy("source").agg(F.max("size").alias("size"))
    steps = steps.join(F.broadcast(sizes), "source", "left")
    steps = steps.withColumn("pos", F.when(F.col("size").isNull(), F.raise_error(F.concat(F.lit("empty source pool: "), F.col("source"))))
                             .otherwise(md5_int(seed, F.lit("pick"), "update") % F.col("size") + 1))
    rows = steps.drop("size").join(ranked.drop("size"), ["source", "pos"])
    have = F.lit(0)
    for m in modes:
        if f"{m}_n" in pool.columns:
            have = F.when(F.col("mode") == m, F.col(f"{m}_n")).otherwise(have)
        else:
            have = F.when(F.col("mode") == m, F.lit(1)).otherwise(have)
    return rows.select((F.col("update") + 1).alias("update"), "source", "mode", key, (have == 0).alias("fallback"),
                       md5_int(seed, F.lit("patch"), "update").alias("patch_seed"))


def start_range(lo: str, hi: str, dim: Column, patch: int) -> tuple[Column, Column]:
    """Crop starts on one axis that keep [lo, hi] inside a patch of the grid; empty when first > last."""
    first = F.when(dim <= patch, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col(hi) - patch + 1))
    last = F.when(dim <= patch, F.lit(0)).otherwise(F.least(F.col(lo), dim - patch))
    return first, last


def crop_options(points: DataFrame, headers: DataFrame, patch: tuple[int, int, int]) -> DataFrame:
    """Per case its findings, and pairs of them whose representative points fit one crop.

    ``points`` has one ``(case_id, finding_id, i, j, k)`` row per non-empty finding. A case has
    as many findings as its volume has channels, so the pair array stays short.
    """
    shape = headers.select("case_id", "shape")
    per = points.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("finding_id", "i", "j", "k"))).alias("fs")).join(shape, "case_id")

    def fits(a, b):
        ok = F.lit(True)
        for n, ax in enumerate("ijk"):
            lo, hi, dim = F.least(a[ax], b[ax]), F.greatest(a[ax], b[ax]), F.col("shape")[n]
            ok = ok & ((dim <= patch[n]) | (F.greatest(F.lit(0), hi - patch[n] + 1) <= F.least(lo, dim - patch[n])))
        return ok

    pairs = F.flatten(F.transform("fs", lambda a: F.transform(F.filter(F.col("fs"), lambda b: (b["finding_id"] > a["finding_id"]) & fits(a, b)),
                                                              lambda b: F.array(a, b))))
    singles = F.transform("fs", lambda a: F.array(a))
    options = F.when(F.size("fs") >= 2, pairs).otherwise(singles)
    return per.select("case_id", "shape", options.alias("options")).where(F.size("options") > 0)


def sample_events(options: DataFrame, prompts: DataFrame, headers: DataFrame, events: int, patch: tuple[int, int, int], seed: int) -> DataFrame:
    """Training events of three prompt slots with a crop that holds their positives.

    A multi-finding case gives a compatible positive pair and one negative prompt, a
    single-finding case one positive and two negatives. Negatives are distinct prompts of
    other cases: the walk along the shuffled prompt pool starts at a hash and skips the
    case's own prompts. Slots are shuffled by hash; the anchor is a positive slot.
    """
    spark = options.sparkSession
    own = prompts.groupBy("case_id").agg(F.collect_set(F.lower("prompt")).alias("own"),
                                         F.map_from_entries(F.collect_list(F.struct("finding_id", "prompt"))).alias("texts"))
    pool = checkpointed(hash_rank(prompts.select(F.lower("prompt").alias("negative")).distinct(), [], seed, ["negative"], "neg_pos", 64))
    cases = checkpointed(hash_rank(options.join(own, "case_id"), [], seed, ["case_id"], "case_pos", 64))
    n_cases, n_pool = cases.count(), pool.count()
    ev = spark.range(events).withColumnRenamed("id", "event_index").withColumn(
        "case_pos", md5_int(seed, F.lit("case"), "event_index") % F.lit(n_cases) + 1)
    ev = ev.join(cases, "case_pos")
    ev = ev.withColumn("pos", F.element_at("options", (md5_int(seed, F.lit("option"), "event_index") % F.size("options") + 1).cast("int")))
    ev = ev.withColumn("n_neg", F.lit(3) - F.size("pos"))
    reach = F.least(F.size("own") + F.col("n_neg"), F.lit(n_pool))
    walk = ev.select("event_index", "own", "n_neg", F.explode(F.sequence(F.lit(0), reach - 1)).alias("step"))
    walk = walk.withColumn("neg_pos", (md5_int(seed, F.lit("negative"), "event_index") + F.col("step")) % F.lit(n_pool) + 1)
    found = (walk.join(pool, "neg_pos").where(~F.array_contains("own", F.col("negative")))
             .groupBy("event_index", "n_neg").agg(F.sort_array(F.collect_list(F.struct("step", "negative"))).alias("c")))
    negs = found.select("event_index", F.transform(F.slice("c", F.lit(1), F.col("n_neg")), lambda x: x["negative"]).alias("negatives"))
    ev = ev.join(negs, "event_index", "left")
    slot = "struct<prompt:string,target_index:int,is_positive:boolean>"
    positive = F.transform("pos", lambda p: F.struct(F.col("texts")[p["finding_id"]].alias("prompt"), p["finding_id"].cast("int").alias("target_index"),
                                                     F.lit(True).alias("is_positive")))
    negative = F.transform(F.coalesce("negatives", F.array().cast("array<string>")), lambda t: F.struct(
        t.alias("prompt"), F.lit(None).cast("int").alias("target_index"), F.lit(False).alias("is_positive")))
    mixed = F.concat(positive.cast(f"array<{slot}>"), negative.cast(f"array<{slot}>"))
    keyed = F.array_sort(F.transform(mixed, lambda s, n: F.struct(
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("slot"), F.col("event_index").cast("string"), n.cast("string"))).alias("h"), s.alias("s"))))
    ev = ev.withColumn("slots", F.transform(keyed, lambda x: x["s"]))
    hot = F.filter(F.transform("slots", lambda s, n: F.when(s["is_positive"], n)), lambda n: n.isNotNull())
    ev = ev.withColumn("anchor", F.element_at(hot, (md5_int(seed, F.lit("anchor"), "event_index") % F.size(hot) + 1).cast("int")))
    starts = []
    for n, a in enumerate("ijk"):
        ev = ev.withColumn(f"lo_{a}", F.array_min(_axis("pos", a)))
        ev = ev.withColumn(f"hi_{a}", F.array_max(_axis("pos", a)))
        first, last = start_range(f"lo_{a}", f"hi_{a}", F.col("shape")[n], patch[n])
        starts.append((first + md5_int(seed, F.lit("start" + a), "event_index") % (last - first + 1)).cast("int"))
    return ev.select("event_index", "case_id", F.col("slots").alias("prompt_slots"), F.col("anchor").alias("anchor_slot_index"),
                     F.get("slots", F.col("anchor"))["target_index"].alias("anchor_target_index"), F.array(*starts).alias("patch_starts"),
                     F.transform("pos", lambda p: F.array(p["i"], p["j"], p["k"])).alias("positive_crop_points"),
                     md5_int(seed, F.lit("patch"), "event_index").alias("patch_seed"))


def _axis(column: str, axis: str) -> Column:
    return F.transform(column, lambda p: p[axis])


def event_check(events: DataFrame, prompts: DataFrame, headers: DataFrame, patch: tuple[int, int, int]) -> DataFrame:
    """How many events break a rule of :func:`sample_events`; all zero when sound."""
    own = prompts.groupBy("case_id").agg(F.collect_set(F.lower("prompt")).alias("own"), F.count(F.lit(1)).alias("n"))
    rows = events.join(own, "case_id").join(headers.select("case_id", "shape"), "case_id")
    neg = F.filter("prompt_slots", lambda s: ~s["is_positive"])
    inside = F.lit(True)
    for n in range(3):
        inside = inside & F.forall("positive_crop_points", _holds(n, patch[n]))
        inside = inside & (F.col("patch_starts")[n] >= 0) & ((F.col("shape")[n] <= patch[n]) | (F.col("patch_starts")[n] + patch[n] <= F.col("shape")[n]))
    return rows.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.size("prompt_slots") != 3).alias("bad_slot_count"),
        F.count_if(F.exists(neg, lambda s: F.array_contains("own", F.lower(s["prompt"])))).alias("own_prompt_as_negative"),
        F.count_if(F.size(F.array_distinct(F.transform(neg, lambda s: s["prompt"]))) != F.size(neg)).alias("repeated_negative"),
        F.count_if(~F.get("prompt_slots", F.col("anchor_slot_index"))["is_positive"]).alias("anchor_not_positive"),
        F.count_if(~inside).alias("point_outside_crop"))


def _holds(n: int, size: int):
    return lambda p: (p[n] >= F.col("patch_starts")[n]) & (p[n] < F.col("patch_starts")[n] + size)


def cycle(pool: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """N picks that use the whole pool once per cycle, each cycle newly shuffled."""
    size = pool.count()
    if not size:
        raise ValueError("cannot cycle an empty pool")
    cycles = -(-n // size)
    rows = pool.select(key).withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
    ranked = hash_rank(rows, ["cycle"], seed, ["cycle", key], "pos")
    index = F.col("cycle") * size + F.col("pos") - 1
    return ranked.select(index.alias("index"), "cycle", key).where(F.col("index") < n)


def mix_schedule(target: DataFrame, replay: DataFrame, index: str, per_epoch: int, share: float, epochs: int, seed: int) -> DataFrame:
    """Epochs with a fixed number of target rows and the rest from a replay schedule.

    Both sources are read in their own order; inside an epoch the order is a hash shuffle.
    """
    n_target = round(per_epoch * share)
    n_replay = per_epoch - n_target
    parts = []
    for name, rows, quota in (("targeted", target, n_target), ("replay", replay, n_replay)):
        if quota:
            parts.append(rows.where(F.col(index) < quota * epochs).select(
                F.lit(name).alias("source"), F.col(index).alias("source_index"), F.floor(F.col(index) / quota).alias("epoch"),
                *[c for c in rows.columns if c != index]))
    mixed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ranked = mixed.withColumn("u", md5_int(seed, "source", "source_index"))
    # One epoch holds per_epoch rows, so its window is bounded.
    rank = F.row_number().over(W.partitionBy("epoch").orderBy("u", "source", "source_index"))
    return ranked.withColumn(index, F.col("epoch") * per_epoch + rank - 1).drop("u")


def audit_schedule(schedule: DataFrame, index: str, per_epoch: int, share: float, category: str | None = None) -> DataFrame:
    """Rows per epoch and source (and category) against the expected quota."""
    by = ["epoch", "source"]
    quota = F.when(F.col("source") == "targeted", round(per_epoch * share)).otherwise(per_epoch - round(per_epoch * share))
    aggs = [F.count(F.lit(1)).alias("rows"), F.min(index).alias("first"), F.max(index).alias("last")]
    if category:
        aggs.append(F.countDistinct(category).alias("categories"))
    out = schedule.groupBy(*by).agg(*aggs)
    return out.withColumn("expected", quota.cast("bigint")).withColumn(
        "ok", (F.col("rows") == F.col("expected")) & (F.floor(F.col("first") / per_epoch) == F.col("epoch")) & (F.floor(F.col("last") / per_epoch) == F.col("epoch")))


def is_prefix(short: DataFrame, long: DataFrame, index: str, fields: list[str]) -> DataFrame:
    """Whether every row of ``short`` equals the row of ``long`` at the same index."""
    digest = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    rows = short.select(index, digest.alias("a")).join(long.select(index, digest.alias("b")), index, "left")
    out = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("b").isNull()).alias("absent"), F.count_if(F.col("a") != F.col("b")).alias("different"),
                   F.min(F.when(F.col("b").isNull() | (F.col("a") != F.col("b")), F.col(index))).alias("first_difference"))
    return out.withColumn("is_prefix", (F.col("absent") == 0) & (F.col("different") == 0))


def paired(a: DataFrame, b: DataFrame, index: str, same: list[str]) -> DataFrame:
    """Whether two schedules have the same indices and agree on the given fields."""
    rows = a.select(index, *[F.col(c).alias(f"a_{c}") for c in same], F.lit(True).alias("ha")).join(
        b.select(index, *[F.col(c).alias(f"b_{c}") for c in same], F.lit(True).alias("hb")), index, "full_outer")
    miss = F.col("ha").isNull() | F.col("hb").isNull()
    return rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (~miss & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias("bad"),
                                                    miss.alias("miss")) for c in same])).alias("x")).groupBy(F.col("x.field").alias("field")).agg(
        F.count(F.lit(1)).alias("indices"), F.count_if("x.miss").alias("unpaired"), F.count_if("x.bad").alias("different"))


def schedule_slice(schedule: DataFrame, index: str, start: int, n: int) -> DataFrame:
    """N rows from ``start``, re-indexed from 0, with the old index kept."""
    rows = schedule.where((F.col(index) >= start) & (F.col(index) < start + n))
    return rows.withColumn(f"source_{index}", F.col(index)).withColumn(index, F.col(index) - start)


# ------------------------------------------------------------------ G14 review

def review_sample(rows: DataFrame, exceptions: Column, n: int, seed: int, key: list[str]) -> DataFrame:
    """Every exception and the first n others by hash."""
    bad = rows.where(exceptions).withColumn("reason", F.lit("exception"))
    rest = hash_smallest(rows.where(~exceptions | exceptions.isNull()), n, seed, key).withColumn("reason", F.lit("sample"))
    return bad.unionByName(rest)


def review_extremes(rows: DataFrame) -> DataFrame:
    """Largest gain and harm per category, most harmful lost hit and full exclusion per finding.

    ``rows`` has ``case_id, finding_id, category, policy, delta, dice, base_hit, hit, excluded``.
    Reasons are merged per item.
    """
    item = F.struct(*KEY, "policy")
    tie = [F.col(c) for c in (*KEY, "policy")]
    gain = rows.groupBy("category").agg(F.min_by(item, F.struct(-F.col("delta"), *tie)).alias("x")).select("x.*", F.lit("category_largest_gain").alias("reason"))
    harm = rows.groupBy("category").agg(F.min_by(item, F.struct(F.col("delta"), *tie)).alias("x")).select("x.*", F.lit("category_largest_harm").alias("reason"))
    worst = lambda cond, name: rows.where(cond).groupBy(*KEY).agg(F.min_by("policy", F.struct("dice", "policy")).alias("policy")).select(
        *KEY, "policy", F.lit(name).alias("reason"))
    picks = gain.union(harm).union(worst(F.col("base_hit") & ~F.col("hit"), "lost_hit")).union(worst(F.col("excluded"), "completely_excluded"))
    return picks.groupBy(*KEY, "policy").agg(F.array_join(F.sort_array(F.collect_set("reason")), "|").alias("reasons"))
