"""Mask, component, distance and proposal operators against NumPy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmeter.operators import components, distance, grids, masks

VOX = "case_id bigint, finding_id int, i int, j int, k int"


def frame(spark, grids_):
    rows = [(c, f, *map(int, p)) for (c, f), m in grids_.items() for p in np.argwhere(m)]
    return spark.createDataFrame(rows, VOX)


def headers(spark, cases, shape, spacing):
    affine = [spacing[0], 0, 0, 0, 0, spacing[1], 0, 0, 0, 0, spacing[2], 0, 0, 0, 0, 1.0]
    return spark.createDataFrame([(c, list(shape), [float(s) for s in spacing], [float(a) for a in affine]) for c in cases],
                                 "case_id bigint, shape array<int>, spacing array<double>, affine array<double>")


def label(mask):
    """Flood fill with 26 neighbours, ids in C order."""
    out, n = np.zeros(mask.shape, int), 0
    for seed in zip(*np.nonzero(mask)):
        if out[seed]:
            continue
        n += 1
        out[seed] = n
        todo = [seed]
        while todo:
            p = todo.pop()
            for d in np.ndindex(3, 3, 3):
                q = tuple(a + b - 1 for a, b in zip(p, d))
                if all(0 <= x < s for x, s in zip(q, mask.shape)) and mask[q] and not out[q]:
                    out[q] = n
                    todo.append(q)
    return out


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(5)
    return {(1, 0): rng.random((14, 11, 9)) < 0.13, (1, 1): rng.random((14, 11, 9)) < 0.04, (2, 0): np.ones((4, 5, 6), bool),
            (3, 0): np.indices((12, 3, 12)).sum(0) % 7 == 0}


def test_components_match_flood_fill(spark, blobs):
    got = {}
    for r in components.components(frame(spark, blobs)).collect():
        got[(r.case_id, r.finding_id, r.i, r.j, r.k)] = r.component
    want = {(c, f, *map(int, p)): int(label(m)[tuple(p)]) for (c, f), m in blobs.items() for p in np.argwhere(m)}
    assert got == want


def test_same_partition_sees_a_split(spark, blobs):
    a = components.components(frame(spark, blobs))
    b = a.withColumn("component", F.when((F.col("case_id") == 2) & (F.col("i") == 0), 99).otherwise(F.col("component")))
    got = {(r.case_id, r.finding_id): r.same_partition for r in components.same_partition(a, b).collect()}
    assert got[(2, 0)] is False and got[(1, 0)] is True


def test_empty_rules(spark):
    keys = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "case_id bigint, finding_id int")
    one = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 2, 2, 2)], VOX)
    gt = spark.createDataFrame([(1, 0, 0, 0, 0)], VOX)
    got = {r.finding_id: r for r in masks.mask_metrics(keys, one, gt).collect()}
    assert (got[0].dice, got[0].precision, got[0].recall) == (1.0, 1.0, 1.0)
    assert got[1].precision == 0.0 and got[1].recall == 1.0 and not got[1].hit
    assert got[2].dice == 1.0 and got[2].precision == 1.0
    strict = {r.finding_id: r for r in masks.mask_metrics(keys, one, gt, precision_empty="zero", recall_empty="null").collect()}
    assert strict[2].precision == 0.0 and strict[1].recall is None


@pytest.mark.parametrize("cap", [2.5, 20.0])
def test_distance_matches_brute_force(spark, cap):
    rng = np.random.default_rng(int(cap))
    spacing = np.array([0.7, 1.1, 2.0])
    support = {(1, 0): rng.random((9, 8, 7)) < 0.05, (2, 0): np.zeros((9, 8, 7), bool), (3, 0): np.pad(np.ones((4, 4, 4), bool), ((0, 5), (0, 4), (0, 3)))}
    query = {k: rng.random((9, 8, 7)) < 0.2 for k in support}
    out = distance.support_distance(frame(spark, query), frame(spark, support), headers(spark, [1, 2, 3], (9, 8, 7), spacing), cap).collect()
    assert len(out) == sum(int(m.sum()) for m in query.values())
    for r in out:
        pts = np.argwhere(support[(r.case_id, 0)])
        p = np.array([r.i, r.j, r.k])
        want = np.sqrt((((pts - p) * spacing) ** 2).sum(1)).min() if len(pts) else np.inf
        assert r.dist_mm == pytest.approx(want) if want <= cap else np.isinf(r.dist_mm)
        if len(pts):
            gap = np.maximum(np.maximum((pts.min(0) - p) * spacing, (p - pts.max(0)) * spacing), 0).max()
            assert r.box_mm == pytest.approx(gap)
        else:
            assert np.isinf(r.box_mm)


def test_envelope_on_long_lines():
    rng = np.random.default_rng(1)
    values = np.where(rng.random((40, 300)) < 0.1, np.round(rng.random((40, 300)) * 90, 1), np.inf)
    values[3] = np.inf
    values[4] = 0.0
    pace, start = rng.choice([0.5, 1.0, 2.5], 40), rng.integers(-30, 10, 40)
    at = start[:, None] + np.arange(350)
    want = (values[:, None, :] + ((at[:, :, None] - np.arange(300)) * pace[:, None, None]) ** 2).min(axis=2)
    assert np.allclose(distance.envelope(values, pace, at), want) and np.isinf(distance.envelope(values, pace, at)[3]).all()


def test_distance_in_many_blocks(spark, monkeypatch):
    """Blocks of one i-plane, negative positions, a support beside the query, repeated voxels and a second key."""
    monkeypatch.setattr(distance, "BLOCK_VOXELS", 1)
    monkeypatch.setattr(distance, "_STACK", 500)
    rng = np.random.default_rng(9)
    spacing = np.array([1.0, 0.6, 1.7])
    support = {(c, s): np.unique(rng.integers(-6, 9, (n, 3)), axis=0) for c, s, n in ((1, "a", 25), (1, "b", 3), (2, "a", 40))}
    query = {(c, s): np.unique(rng.integers(0, 14, (80, 3)), axis=0) for c, s in [*support, (2, "b"), (3, "a")]}
    make = lambda x: spark.createDataFrame([(c, s, *map(int, p)) for (c, s), m in x.items() for p in (*m, m[0])], "case_id bigint, scope string, i int, j int, k int")
    out = distance.support_distance(make(query), make(support), headers(spark, [1, 2, 3], (14, 14, 14), spacing), 6.0, ["case_id", "scope"]).collect()
    assert len(out) == sum(map(len, query.values()))
    for r in out:
        pts = support.get((r.case_id, r.scope))
        want = np.sqrt((((pts - np.array([r.i, r.j, r.k])) * spacing) ** 2).sum(1)).min() if pts is not None else np.inf
        assert r.dist_mm == pytest.approx(want) if want <= 6 else np.isinf(r.dist_mm)


def test_dilate_zero_is_identity(spark, blobs):
    m = frame(spark, blobs).where("finding_id = 0").select("case_id", "i", "j", "k")
    h = headers(spark, [1, 2, 3], (14, 11, 12), (1, 1, 1))
    assert distance.dilate(m, h, 0).exceptAll(m).isEmpty()


def test_topk_matches_greedy(spark):
    rng = np.random.default_rng(3)
    shape, patch, radius, k = (10, 9, 8), (4, 4, 4), 1, 4
    grid = {(c, 0): np.round(rng.random(shape), 1) for c in (1, 2)}
    rows = [(c, f, *map(int, p), float(g[tuple(p)])) for (c, f), g in grid.items() for p in np.ndindex(shape)]
    df = spark.createDataFrame(rows, VOX + ", score double")
    got = grids.topk_nms(df, headers(spark, [1, 2], shape, (1, 1, 1)), k, radius, patch).collect()
    for (c, _), g in grid.items():
        left, kept, seen = g.copy(), [], set()
        while len(kept) < k:
            p = np.unravel_index(left.argmax(), shape)
            if left[p] < 0:
                break
            start = tuple(max(0, min(int(a) - w // 2, max(0, n - w))) for a, w, n in zip(p, patch, shape))
            kept += [] if start in seen else [tuple(map(int, p))]
            seen.add(start)
            left[tuple(slice(max(0, a - radius), a + radius + 1) for a in p)] = -1
        mine = [(r.i, r.j, r.k) for r in sorted((r for r in got if r.case_id == c), key=lambda r: r["rank"])]
        assert mine == kept


def test_tile_starts_center_small_axes(spark):
    h = headers(spark, [1], (5, 17, 8), (1, 1, 1))
    got = {(r.ti, r.tj, r.tk) for r in grids.tiles(h, (8, 8, 8)).collect()}
    assert got == {(-2, j, 0) for j in (0, 3, 6, 9)} or {g[0] for g in got} == {-2}
    assert {g[2] for g in got} == {0}


def test_partition_violation(spark):
    pred = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 0, 1, 0, 0)], VOX)
    gt = spark.createDataFrame([(1, 0, 0, 0, 0)], VOX)
    regions = pred.withColumn("region", F.lit("contralateral"))
    got = {r.i: (r.part, r.violation) for r in masks.partition_fp(pred, gt, regions).collect()}
    assert got == {0: ("known_positive", True), 1: ("contralateral", False)}


def test_components_refuse_indices_that_do_not_fit(spark):
    for bad in (-1, 1 << 21):
        with pytest.raises(Exception, match="voxel index outside"):
            components.components(spark.createDataFrame([(1, 0, 0, 0, 0), (1, 0, 0, bad, 0)], VOX)).collect()


def test_peaks_never_come_back_short(spark):
    # All scores equal on one long axis: most peaks map to a start that is already there.
    rows = [(1, 0, i, 0, 0, 1.0) for i in range(12)]
    df, h = spark.createDataFrame(rows, VOX + ", score double"), headers(spark, [1], (12, 1, 1), (1, 1, 1))
    got = sorted((r["rank"], r.i, r.si) for r in grids.topk_nms(df, h, 2, 0, (10, 1, 1)).collect())
    assert got == [(1, 0, 0), (2, 6, 1)]
    with pytest.raises(RuntimeError):
        grids.topk_nms(df, h, 2, 0, (10, 1, 1), max_attempts=3)


def test_full_inclusion_of_an_empty_truth_is_an_option(spark):
    proposals = spark.createDataFrame([(1, 0, 1, 0, 0, 0)], "case_id bigint, finding_id int, rank int, si int, sj int, sk int")
    findings, none = spark.createDataFrame([(1, 0), (2, 0)], "case_id bigint, finding_id int"), spark.createDataFrame([], VOX)
    for option in (False, True):
        rows = {r.case_id: r for r in grids.proposal_metrics(proposals, none, findings, (2, 2, 2), (1,), empty_included=option).collect()}
        assert rows[1].full_inclusion_at_1 is option and rows[2].full_inclusion_at_1 is False and rows[1].hit_at_1 is False


@pytest.mark.parametrize("share", [0.05, 0.12, 0.3])
def test_components_over_slabs_and_words(spark, share):
    """Volumes of several slabs and words against a flood fill; repeated rows and string keys included."""
    rng = np.random.default_rng(int(share * 100))
    volumes = {("a", 0): rng.random((70, 5, 131)) < share, ("b", 1): rng.random((33, 3, 66)) < share, ("c", 0): np.ones((65, 2, 65), bool)}
    rows = [(c, f, *map(int, v)) for (c, f), mask in volumes.items() for v in np.argwhere(mask)]
    df = spark.createDataFrame(rows + rows[:50], "case_id string, finding_id int, i int, j int, k int")
    got = {tuple(r)[:5]: r.component for r in components.components(df).collect()}
    assert len(got) == len(rows)
    for (case, finding), mask in volumes.items():
        left, number = {tuple(map(int, v)) for v in np.argwhere(mask)}, 0
        for first in sorted(left):
            if first not in left:
                continue
            number += 1
            left.remove(first)
            todo = [first]
            while todo:
                at = todo.pop()
                assert got[(case, finding, *at)] == number
                near = {(at[0] + a, at[1] + b, at[2] + c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)} & left
                left -= near
                todo += near


def test_words_hold_any_index_and_repeated_rows(spark):
    rows = [(1, 0, 0, 0, k) for k in (-65, -64, -1, 0, 63, 64, 127, 128)]
    df = spark.createDataFrame(rows * 2, VOX)
    packed = masks.words(df)
    assert packed.count() == 5
    assert sorted(r.k for r in masks.voxels(packed).collect()) == [r[4] for r in rows]
    assert sorted(r.k for r in masks.flagged({"p": packed, "g": df}).where("p and g").collect()) == [r[4] for r in rows]
    keys = spark.createDataFrame([(1, 0)], "case_id bigint, finding_id int")
    one = masks.mask_metrics(keys, packed, df).first()
    assert (one.tp, one.fp, one.fn) == (8, 0, 0)


def test_masks_against_sets(spark):
    rng = np.random.default_rng(5)
    draw = lambda share: {tuple(map(int, v)) for v in np.argwhere(rng.random((3, 4, 140)) < share)}
    p, g, f, a, names = draw(0.4), draw(0.4), draw(0.4), draw(0.5), ["ipsilateral", "contralateral", "outside_lung", "other_certified", "elsewhere"]
    table = lambda s: spark.createDataFrame([(1, 0, *v) for v in s], VOX)
    keys = spark.createDataFrame([(1, 0)], "case_id bigint, finding_id int")
    sup = masks.supported_metrics(keys, table(p), table(g), table(a).drop("finding_id")).first()
    assert (sup.tp, sup.fp, sup.tp_removed, sup.fp_removed, sup.gt_voxels) == (len(p & g & a), len(p & a - g), len(p & g - a), len(p - g - a), len(g))
    edit = masks.edit_metrics(keys, table(p), table(f), table(g)).first()
    assert (edit.fp_removed, edit.fn_recovered, edit.tp_removed, edit.tn_added, edit.edited) == (
        len(p - f - g), len((f - p) & g), len((p - f) & g), len(f - p - g), len(p ^ f))
    out = masks.outside_support(keys, table(g), table(a).drop("finding_id")).first()
    assert (out.gt_voxels, out.outside_voxels) == (len(g), len(g - a))
    regions = {n: draw(0.2) for n in names}
    rows = spark.createDataFrame([(1, 0, *v, n) for n, s in regions.items() for v in s], VOX + ", region string")
    got = {(r.i, r.j, r.k): (r.part, r.violation) for r in masks.partition_fp(table(p), table(g), rows).collect()}
    assert set(got) == p
    for v, (part, violation) in got.items():
        held = sorted(n for n in names if v in regions[n])
        sure = [n for n in held if n != "elsewhere"]
        assert part == ("known_positive" if v in g else sure[0] if sure else "unknown")
        assert violation == (bool(held) and v in g or len(held) > 1)
