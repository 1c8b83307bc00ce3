"""Statistics, sampling, ensembles and text rules on small data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmeter.functions import bucketed_row_number, erfc, exact_quantiles, hash_smallest, trailing_window
from voxelmeter.operators import ensembles as en
from voxelmeter.operators import sampling as sp
from voxelmeter.operators import stats
from voxelmeter.operators import sweeps as sw
from voxelmeter.operators import text as tx
from voxelmeter.operators.chunks import ensemble_chunks, stacked_chunks, with_truth


def test_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    values = {"a": np.concatenate([np.full(500, 2.0), rng.normal(size=700)]), "b": np.array([3.0]), "c": rng.integers(0, 5, 101).astype(float)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"q05": 0.05, "q50": 0.5, "q93": 0.93}).collect()}
    for g, vs in values.items():
        assert [got[g].q05, got[g].q50, got[g].q93] == pytest.approx(np.quantile(vs, [0.05, 0.5, 0.93]).tolist())


def test_erfc(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 2.99, 3.0, 4.0, 6.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(erfc("x")).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], rel=1e-9, abs=1e-13)


def test_trailing_window_across_chunks(spark):
    df = spark.range(1, 501).selectExpr("1 as g", "id as n", "cast(id * id % 37 as double) as v")
    got = {r.n: r.m for r in trailing_window(df, ["g"], "n", 7, {"m": lambda w: F.avg("v").over(w)}, chunk=16).collect()}
    v = [n * n % 37 for n in range(1, 501)]
    assert got == pytest.approx({n: float(np.mean(v[max(0, n - 7):n])) for n in range(1, 501)})


def test_row_number_and_subset_do_not_depend_on_order(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as g")
    rn = bucketed_row_number(df, ["g"], F.floor(F.col("id") / 100), ["id"])
    assert rn.where("rn <> id div 3 + 1").isEmpty()
    a = {r.id for r in hash_smallest(df, 50, 9, ["id"]).collect()}
    assert len(a) == 50 and a == {r.id for r in hash_smallest(df.repartition(7).orderBy(F.rand(1)), 50, 9, ["id"]).collect()}


def test_bootstrap_is_order_invariant(spark):
    rows = [(c, float(v)) for c in range(30) for v in (c % 5, c % 7)]
    df = spark.createDataFrame(rows, "case_id int, v double")
    a = stats.cluster_bootstrap(df, "case_id", ["v"], 100, 3).first().asDict()
    b = stats.cluster_bootstrap(df.repartition(5), "case_id", ["v"], 100, 3).first().asDict()
    assert all(a[k] == (pytest.approx(b[k]) if isinstance(b[k], float) else b[k]) for k in b)
    assert a["ci_low"] <= a["estimate"] <= a["ci_high"] and a["clusters"] == 30


def test_retention_keeps_ties(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 3, 3, 4, 5, 5, 5, 9]], "s double")
    got = sw.retention_threshold(df, [], "s", 0.8).first()
    assert got["cut"] == 5.0  # two may go, strictly above 5 is only one
    assert sw.retention_threshold(df, [], "s", 0.8, False).first()["cut"] == 3.0


def test_sweep_bins_match_direct_comparison(spark):
    cuts = [i / 200 for i in range(201)]
    xs = [0.0, 0.005, 0.0049999, 0.5, 0.50000001, 0.9999, 1.0, 0.3]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for inclusive in (True, False):
        got = [r[0] for r in df.select(sw.bin_of(F.col("x"), cuts, inclusive)).collect()]
        assert got == [sum(x >= c if inclusive else x > c for c in cuts) for x in xs]


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(11)
    z = {(c, f): rng.normal(size=(3, 4, 3, 2)) for c in range(6) for f in range(2)}
    gt = {k: rng.random((4, 3, 2)) < 0.4 for k in z}
    rows = [(f"m{m}", c, f, *map(int, p), bool(gt[(c, f)][tuple(p)]), float(z[(c, f)][(m, *p)])) for (c, f) in z for m in range(3) for p in np.ndindex(4, 3, 2)]
    scores = spark.createDataFrame(rows, "candidate_id string, case_id bigint, finding_id int, i int, j int, k int, is_gt boolean, z double")
    keys = spark.createDataFrame([(c, f, "1a" if c < 3 else "2a") for c, f in z], "case_id bigint, finding_id int, category string")
    truth = scores.where("candidate_id = 'm0' and is_gt").groupBy("case_id", "finding_id").agg(F.count(F.lit(1)).alias("n_gt"))
    return z, gt, en.stacked(scores, ["m0", "m1", "m2"]).cache(), keys, truth


def mean_dice(z, gt, weights, t, only=None):
    out = []
    for k, truth in gt.items():
        if only is not None and k not in only:
            continue
        p = sum(w * (1 / (1 + np.exp(-z[k][m]))) for m, w in weights.items())
        on = np.round(p, 12) >= t
        n = on.sum() + truth.sum()
        out.append(1.0 if n == 0 else (2 * (on & truth).sum() + 1e-6) / (n + 1e-6))
    return out


def test_greedy_and_refine_match_brute_force(spark, small):
    z, gt, stack, keys, truth = small
    ts, coarse = [0.3, 0.34, 0.4, 0.5, 0.54, 0.6], [0.3, 0.4, 0.5, 0.6]

    def best(weights):
        rows = {t: mean_dice(z, gt, weights, t) for t in ts}
        rank = lambda t: (-round(float(np.mean(rows[t])), 12), -sum(d >= 0.1 for d in rows[t]), t)
        c = min(coarse, key=rank)
        t = min((t for t in ts if abs(t - c) <= 0.0400001), key=rank)
        return round(float(np.mean(rows[t])), 12), sum(d >= 0.1 for d in rows[t]), t

    path = en.greedy_forward(stack, keys, truth, ["m0", "m1", "m2"], "probability", 3, ts, coarse)
    chosen = []
    for step in path:
        options = []
        for m in range(3):
            if m not in chosen:
                mem = [*chosen, m]
                d, h, t = best({x: 1 / len(mem) for x in mem})
                options.append((d, h, t, mem))
        top = max(o[0] for o in options)
        want = min((o for o in options if o[0] >= top - 0.001), key=lambda o: (-o[1], -o[0], o[3]))
        assert (step.dice, step.hits, step.threshold) == pytest.approx(want[:3])
        chosen = sorted(want[3])
        assert [c for c, _ in step.recipe.weights] == [f"m{x}" for x in chosen]
    refined = en.coordinate_refine(path[1], stack, keys, truth, ts, coarse, passes=1)
    assert refined.dice >= path[1].dice - 0.001 * 2 * len(path[1].recipe.weights)


def test_greedy_out_of_fold(spark, small):
    z, gt, stack, keys, truth = small
    folds = spark.createDataFrame([(c, c % 2) for c in range(6)], "case_id bigint, fold int")
    ts = [0.4, 0.5]
    rows = en.oof_greedy(stack, keys, truth, folds, ["m0", "m1", "m2"], "probability", 1, ts, ts).collect()
    for r in rows:
        held = {k for k in gt if k[0] % 2 == r.fold}
        fit = {k for k in gt if k[0] % 2 != r.fold}
        m = int(r.recipe[-1])
        assert r.fit_dice == pytest.approx(float(np.mean(mean_dice(z, gt, {m: 1.0}, r.threshold, fit))))
        assert r.held_dice == pytest.approx(float(np.mean(mean_dice(z, gt, {m: 1.0}, r.threshold, held)))) and r.findings == len(held)


def test_folds_search_as_if_alone(spark, small):
    _, _, stack, keys, truth = small
    folds = spark.createDataFrame([(c, c % 3) for c in range(6)], "case_id bigint, fold int")
    names, ts = ["m0", "m1", "m2"], [0.3, 0.4, 0.5]
    rows = {r.fold: r for r in en.oof_greedy(stack, keys, truth, folds, names, "logit", 3, ts, ts, refit=True).collect()}
    assert set(rows) == {0, 1, 2, None} and rows[None].held_dice is None and rows[None].findings is None
    for fold in (1, None):
        part = lambda df: df if fold is None else df.where(f"case_id % 3 <> {fold}")  # noqa: B023, E731
        alone = en.choose(en.greedy_forward(part(stack), part(keys), truth, names, "logit", 3, ts, ts))
        assert (rows[fold].recipe, rows[fold].threshold, rows[fold].fit_dice) == (alone.recipe.name, alone.threshold, pytest.approx(alone.dice))
    assert en.oof_summary(spark.createDataFrame(list(rows.values()), "strategy string, fold int, recipe string, threshold double, fit_dice double, models int, uniform boolean, "
                                                "held_dice double, hits bigint, findings bigint")).first()["findings"] == sum(r.findings for f, r in rows.items() if f is not None)
    none = en.oof_greedy(stack, keys, truth, folds.where("false"), names, "logit", 2, ts, ts)
    assert none.count() == 0


def test_seeds_by_scope(spark, small):
    z, gt, stack, keys, truth = small
    both = keys.withColumn("category", F.when(F.col("case_id") % 2 == 0, "even").otherwise("odd"))
    seeds = {"all": ("m0", "m1", "m1"), "odd": ("m2",), "nowhere": ("m0",)}
    got = {(r.scope, r.arm): r for r in en.seed_arms(stack, both, truth, ["m0", "m1", "m2"], seeds).collect()}
    assert set(got) == {(s, a) for s in ("all", "odd") for a in ("seed", "uniform")}
    odd = {k for k in gt if k[0] % 2 == 1}
    assert got["all", "seed"].dice == pytest.approx(float(np.mean(mean_dice(z, gt, {0: 1 / 3, 1: 2 / 3}, 0.5, set(gt)))))
    assert got["odd", "seed"].dice == pytest.approx(float(np.mean(mean_dice(z, gt, {2: 1.0}, 0.5, odd)))) and got["odd", "seed"].basket == "m2"
    assert got["odd", "uniform"].gain == 0 and got["odd", "seed"].gain == pytest.approx(got["odd", "seed"].dice - got["odd", "uniform"].dice)
    # From a basket of its own, a scope takes the member that a plain search over its findings takes.
    odd_only = both.where("category = 'odd'")
    plain = en.caruana(stack, odd_only, truth, ["m0", "m1", "m2"], 1, seed=("m2",), by_category=False).first()
    mixed = {r.scope: r for r in en.caruana(stack, both, truth, ["m0", "m1", "m2"], 1, seed=seeds).collect()}
    assert (mixed["odd"].basket, mixed["odd"].dice) == (plain.basket, plain.dice) and mixed["all"].k == 4 and mixed["even"].k == 1


def in_chunks(spark, z, gt, size=7):
    """The same scores as chunk arrays of uneven length, stacked."""
    rows = [(f"m{m}", c, f, n, [float(x) for x in z[(c, f)][m].ravel()[a:a + size]], np.flatnonzero(gt[(c, f)].ravel()[a:a + size]).tolist())
            for (c, f) in z for m in range(3) for n, a in enumerate(range(0, 24, size))]
    return spark.createDataFrame(rows, "candidate_id string, case_id bigint, finding_id int, chunk int, values array<float>, truth array<int>")


def test_chunk_arrays_give_the_same(spark, small):
    z, gt, stack, keys, truth = small
    z = {k: v.astype(np.float32).astype(float) for k, v in z.items()}
    voxels = [(f"m{m}", c, f, *map(int, p), bool(gt[(c, f)][tuple(p)]), float(z[(c, f)][(m, *p)])) for (c, f) in z for m in range(3) for p in np.ndindex(4, 3, 2)]
    scores = spark.createDataFrame(voxels, "candidate_id string, case_id bigint, finding_id int, i int, j int, k int, is_gt boolean, z double")
    chunks, stack = in_chunks(spark, z, gt), en.stacked(scores, ["m0", "m1", "m2"])
    both = stacked_chunks(chunks)
    trial = en.recipes([{"id": f"m{m}"} for m in range(3)], [], {"two": ["m0", "m2"]})
    ordered = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert ordered(en.score_recipes(both, keys, truth, trial, [0.3, 0.5])) == ordered(en.score_recipes(stack, keys, truth, trial, [0.3, 0.5]))
    assert ordered(en.caruana(both, keys, truth, ["m0", "m1", "m2"], 2)) == ordered(en.caruana(stack, keys, truth, ["m0", "m1", "m2"], 2))
    own = keys.withColumn("candidate_id", F.explode(F.array(*[F.lit(f"m{m}") for m in range(3)])))
    by = ["candidate_id", "case_id", "finding_id"]
    assert ordered(sw.sweep(chunks, own, truth, [0.3, 0.5, 0.7], key=by)) == ordered(sw.sweep(scores, own, truth, [0.3, 0.5, 0.7], key=by))
    assert ordered(sw.removal_sweep(chunks, own, truth, [0.1, 0.5], key=by)) == ordered(sw.removal_sweep(scores, own, truth, [0.1, 0.5], "z", "is_gt", key=by))
    mixed = {(r.case_id, r.finding_id, r.chunk): r["values"] for r in ensemble_chunks(both, "logit", (("m0", 0.5), ("m1", 0.5))).collect()}
    assert mixed[(1, 1, 2)] == pytest.approx((1 / (1 + np.exp(-z[(1, 1)][:2].mean(axis=0)))).ravel()[14:21])


def test_chunk_arrays_are_checked(spark, small):
    z, gt, _, keys, truth = small
    chunks = in_chunks(spark, z, gt)
    short = chunks.withColumn("values", F.when((F.col("candidate_id") == "m1") & (F.col("chunk") == 1), F.slice("values", 1, 3)).otherwise(F.col("values")))
    odd = chunks.withColumn("values", F.when(F.col("chunk") == 1, F.transform("values", lambda v: F.lit(float("nan")).cast("float"))).otherwise(F.col("values")))
    for bad, why in ((short, "shape"), (odd, "non-finite")):
        with pytest.raises(Exception, match=why):
            en.score_recipes(stacked_chunks(bad), keys, truth, [en.Recipe.of("a", "logit", {"m0": 1.0})], [0.5]).collect()
    labels = spark.createDataFrame([(0, 0, 1, [2])], "case_id bigint, finding_id int, chunk int, truth array<int>")
    got = {(r.case_id, r.finding_id, r.chunk): r.truth for r in with_truth(chunks.where("candidate_id = 'm0'").drop("truth"), labels).collect()}
    assert got[(0, 0, 1)] == [2] and got[(0, 0, 0)] == []
    # A chunk that lacks a member is not counted for the recipe.
    part = stacked_chunks(chunks.where("candidate_id <> 'm1' or case_id <> 0"))
    none = en.score_recipes(part, keys, truth, [en.Recipe.of("a", "logit", {"m1": 1.0})], [0.001]).where("case_id = 0").collect()
    assert [r.pred for r in none] == [0, 0]


def test_replacement_selection(spark, small):
    z, gt, stack, keys, truth = small
    rows = en.caruana(stack, keys, truth, ["m0", "m1", "m2"], 3).collect()
    for scope, only in (("all", None), ("1a", {k for k in gt if k[0] < 3}), ("2a", {k for k in gt if k[0] >= 3})):
        basket = []
        for r in sorted((r for r in rows if r["scope"] == scope), key=lambda r: r.k):
            options = []
            for m in range(3):
                mem = [*basket, m]
                ds = mean_dice(z, gt, {x: mem.count(x) for x in set(mem)}, 0.5 * len(mem), only)
                options.append((-round(float(np.mean(ds)), 12), -sum(d >= 0.1 for d in ds), m))
            want = min(options)
            assert r.added == f"m{want[2]}" and r.dice == pytest.approx(-want[0]) and r.in_sample
            basket.append(want[2])


def test_kfold_is_balanced_and_order_free(spark):
    rng = np.random.default_rng(2)
    rows = [(c, f, ["1a", "1b", "2a"][rng.integers(3)]) for c in range(60) for f in range(rng.integers(1, 5))]
    df = spark.createDataFrame(rows, "case_id bigint, finding_id int, category string")
    got = sp.grouped_kfold(df, 5, 1).collect()
    a = {r.case_id: r.fold for r in got}
    assert a == {r.case_id: r.fold for r in sp.grouped_kfold(df.repartition(3), 5, 1).collect()}
    cases, signatures = np.zeros(5), {}
    for c in a:
        cases[a[c]] += 1
        mark = tuple(sorted(x for k, _, x in rows if k == c))
        signatures.setdefault(mark, np.zeros(5))[a[c]] += 1
    assert len(a) == len(got) == 60 and cases.max() - cases.min() <= 1
    assert all(v.max() - v.min() <= 1 for v in signatures.values())


def test_longest_first_there_and_back(spark):
    loads = [(i, 50 if i % 2 else (i * 7919) % 50 + 1) for i in range(400)]  # one weight holds half of the rows
    df = spark.createDataFrame(loads, "case_id bigint, w bigint")
    got = {r.case_id: r.shard for r in sp.shards(df, 4, "case_id", "w").collect()}
    order = [i for i, _ in sorted(loads, key=lambda x: (-x[1], x[0]))]
    assert got == {i: (3 - p % 4 if p // 4 % 2 else p % 4) for p, i in enumerate(order)}
    sums = [sum(w for i, w in loads if got[i] == s) for s in range(4)]
    assert max(sums) - min(sums) <= 50


def test_allocate_ties_go_to_larger_key(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, w int")
    assert {r.k: r.quota for r in sp.allocate(df, "k", "w", 4).collect()} == {"a": 1, "b": 1, "c": 2}


def test_probe_candidates_cover_strata(spark):
    strata = spark.createDataFrame([(c, f"s{c % 6}") for c in range(40)] + [(c, f"t{c % 3}") for c in range(40)], "case_id bigint, stratum string")
    must = spark.createDataFrame([(0,), (17,)], "case_id bigint")
    rows = sp.probe_candidates(strata, must, 15, 6, 5)
    per = rows.join(strata, "case_id").groupBy("draw").agg(F.countDistinct("case_id").alias("n"), F.countDistinct("stratum").alias("s"), F.count_if(F.col("case_id").isin(0, 17)).alias("m"))
    got = per.collect()
    assert len(got) == 6 and all(r.n == 15 and r.s == 9 and r.m == 4 for r in got)


def test_normalise_is_unicode_aware(spark):
    df = spark.createDataFrame([("ＦＵＬＬ Width; ﬁne_Straße",)], "t string")
    assert tx.normalise_text(df, "t").first()["normalized"] == "full width fine strasse"


@pytest.mark.parametrize("text,group,reason", [
    ("no nodule in the right lung", "unknown", "negation_guard"),
    ("possible nodule", "unknown", "ambiguity_guard"),
    ("nodules in both lungs", "bilateral_or_multifocal", "bilateral_or_multifocal_guard"),
    ("widespread change", "diffuse", "diffuse_guard"),
    ("right upper lobe and left lung", "unknown", "conflicting_laterality"),
    ("rul nodule in the left lung", "unknown", "conflicting_laterality"),
    ("lingular opacity", "exact_lobe", "unambiguous_literal_match"),
    ("perihilar mass on the left", "hilar", "unambiguous_literal_match"),
    ("nodule", "unknown", "no_safe_literal_location"),
    ("", "unknown", "empty_prompt"),
])
def test_classification(spark, text, group, reason):
    r = tx.classify(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert r["group"] == group and r.reason_codes == [reason]


@pytest.mark.parametrize("text,policy,gated", [
    ("Pulmonary nodule in the right upper lobe", "strict_clean_lung", True),
    ("Subpleural nodule in the right lower lobe", "strict_clean_lung", False),
    ("Peripheral consolidation in the right lower lobe", "allow_peripheral", True),
    ("Pleural effusion in the right hemithorax", "broad_lung_prompt", False),
    ("Right pneumothorax", "broad_lung_prompt", False),
    ("Hilar lymph node", "broad_lung_prompt", False),
])
def test_routing(spark, text, policy, gated):
    assert tx.route(spark.createDataFrame([(text,)], "t string"), "t").first()[f"{policy}_gate"] is gated
