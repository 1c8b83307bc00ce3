"""What moves between tasks, and what a task holds, must grow no faster than the input."""

import numpy as np
import pyarrow as pa
import pytest

from voxelmeter.operators import chunks as ch
from voxelmeter.operators import ensembles as en
from voxelmeter.operators import sweeps as sw

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _chunk_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(c, case, 0, part, [float(x) for x in rng.random(40)], sorted(rng.choice(40, 9, False).tolist())) for c in ("m0", "m1") for case in range(3) for part in range(2)]
    frame = spark.createDataFrame(rows, "candidate_id string, case_id long, finding_id int, chunk int, values array<double>, truth array<int>")
    return rows, frame


def test_a_sweep_moves_a_row_per_key_and_carries_columns_and_baseline(spark):
    rows, frame = _chunk_rows(spark)
    keys = spark.createDataFrame([(c, case, 0, f"h{case}") for c in ("m0", "m1") for case in range(1, 5)], "candidate_id string, case_id long, finding_id int, half string")
    truth = spark.createDataFrame([(case, 0, 20 + case) for case in range(3)], "case_id long, finding_id int, n_gt long")
    swept = sw.sweep(frame, keys, truth, [0.3, 0.5, 0.7], kind="probability", key=["candidate_id", "case_id", "finding_id"], keep=["half"], baseline=0.5)
    assert "Window" not in _plan(swept)
    got = {(r.candidate_id, r.case_id, r.threshold): r for r in swept.collect()}
    assert len(got) == 2 * 4 * 3 and all(r.half == f"h{r.case_id}" for r in got.values())
    for (c, case, t), r in got.items():
        mine = [x for x in rows if x[0] == c and x[1] == case]
        on = [np.array(x[4]) >= t for x in mine]
        assert r.pred == sum(int(x.sum()) for x in on) and r.tp == sum(int(o[x[5]].sum()) for o, x in zip(on, mine))
        assert r.base_dice == got[c, case, 0.5].dice and r.base_hit == got[c, case, 0.5].hit
    by_join = sw.sweep_summary(swept.drop("base_dice", "base_hit"), "half", by=["candidate_id"])
    order = ["candidate_id", "threshold", "subset"]
    assert sw.sweep_summary(swept, "half", by=["candidate_id"]).orderBy(order).collect() == by_join.orderBy(order).collect()


@pytest.mark.parametrize("name", ["d3_sweep", "d5_sweep_summary", "d6_best_threshold", "e2_score_recipes"])
def test_sweeps_of_the_tables_sort_no_row_per_cut(spark, name):
    from voxelmeter.plans import registry
    registry.load()
    plan = _plan(registry.QUERIES[name](spark, SF))
    assert "Window" not in plan and "explode(sequence" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_voxels_become_stacks_over_the_ends_of_batches(spark, batch):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(5)
    rows = [(case, f, *(int(x) for x in rng.integers(0, 4, 3)), int(rng.random() < 0.3)) for case in range(6) for f in range(2) for _ in range(60 if case == 2 else 5)]
    rows += [(None, 0, 1, 1, 1, 1), (7, 0, 0, 0, 0, 0)]
    frame = spark.createDataFrame(rows, "case_id long, finding_id int, i int, j int, k int, is_gt int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        stack = ch.voxel_stacks(frame, {"b": F.col("i") * 16.0 + F.col("j") * 4 + F.col("k"), "a": F.col("is_gt") * 0.5})
        plan, got = _plan(stack), stack.collect()
        flat = ch.unstacked(stack).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for case, f, i, j, k, gt in rows:
        cell = want.setdefault((case, f), {})
        cell[i, j, k] = max(gt, cell.get((i, j, k), 0))
    assert "collect_list" not in plan and plan.count("Exchange") == 1
    assert len(got) == len(want) and {(r.case_id, r.finding_id) for r in got} == set(want)
    for r in got:
        cells = sorted(want[r.case_id, r.finding_id].items())
        assert (r.chunk, r.candidates) == (0, ["a", "b"]) and r.truth == [n for n, (_, gt) in enumerate(cells) if gt]
        assert r["values"] == [[0.5 * gt for _, gt in cells], [16.0 * i + 4 * j + k for (i, j, k), _ in cells]]
    assert len(flat) == 2 * len(want) and {(r.candidate_id, r.case_id, r.finding_id, tuple(r["values"])) for r in flat} == {
        (c, r.case_id, r.finding_id, tuple(v)) for r in got for c, v in zip(r.candidates, r["values"])}


@pytest.mark.parametrize("name", ["d3_sweep", "d5_sweep_summary", "d6_best_threshold", "e2_score_recipes"])
def test_scores_of_the_tables_are_gathered_in_arrow(spark, name):
    from voxelmeter.plans import registry
    registry.load()
    plan = _plan(registry.QUERIES[name](spark, SF))
    gathered = plan.split("MapInArrow")
    assert len(gathered) >= 3 and "collect_list" not in gathered[-1] and "sort_array" not in plan
    assert "arrays_zip(n" in plan  # counts are unrolled from two arrays of numbers


def test_a_batch_is_taken_in_pieces():
    values = pa.array([[[0.5] * n] * 2 for n in (300_000, 10, 200_000, 100_000, 5)], pa.list_(pa.list_(pa.float64())))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), values], ["id", "values"])
    parts = [p.column("id").to_pylist() for p in ch._pieces(iter([batch]))]
    assert parts == [[0], [1, 2], [3, 4]]
    assert [p.num_rows for p in ch._pieces(iter([batch.slice(1, 3)]))] == [2, 1]


def test_folds_of_an_out_of_fold_search_come_with_the_findings(spark):
    _, frame = _chunk_rows(spark)
    stack = ch.stacked_chunks(frame)
    keys = spark.createDataFrame([(case, 0, case % 2) for case in range(3)], "case_id long, finding_id int, fold int")
    truth = spark.createDataFrame([(case, 0, 20) for case in range(3)], "case_id long, finding_id int, n_gt long")
    trial = [en.Recipe.of(c, "probability", {c: 1.0}) for c in ("m0", "m1")]
    carried = en.score_recipes(stack, keys, truth, trial, [0.6, 0.7], ["fold"])
    joined = en.score_recipes(stack, keys, truth, trial, [0.6, 0.7])
    totals = [en.fold_totals(x, keys.select("case_id", "fold").distinct()) for x in (carried, joined)]
    assert _plan(totals[0]).count("Join") < _plan(totals[1]).count("Join")
    a, b = (sorted((r.recipe, r.threshold, r.fold, round(r.dice_sum, 9), r.hits, r.findings) for r in x.collect()) for x in totals)
    assert a == b


def test_a_basket_round_joins_no_row_per_candidate(spark):
    _, frame = _chunk_rows(spark)
    stack = ch.stacked_chunks(frame)
    findings = spark.createDataFrame([(case, 0, "1a" if case else "2b") for case in range(3)], "case_id long, finding_id int, category string")
    counts = ch.basket_counts(stack.join(findings, ["case_id", "finding_id"]), {"all": [], "1a": ["m0"], "2b": []}, ["m0", "m1"], 0.5)
    got = counts.collect()
    assert len(got) == 6 and all(len(r.pred) == len(r.tp) == 4 for r in got)  # a row per chunk, two scopes of two candidates
    for r in got:
        if r.case_id == 0:
            assert r.pred[:2] == r.pred[2:] and r.tp[:2] == r.tp[2:]  # both baskets are empty


def test_baskets_take_the_category_that_a_stack_carries(spark):
    from pyspark.sql import functions as F
    _, frame = _chunk_rows(spark)
    stack = ch.stacked_chunks(frame)
    findings = spark.createDataFrame([(case, 0, "1a" if case else "2b") for case in range(3)], "case_id long, finding_id int, category string")
    truth = spark.createDataFrame([(case, 0, 20) for case in range(3)], "case_id long, finding_id int, n_gt long")
    carried = stack.withColumn("category", F.when(F.col("case_id") > 0, "1a").otherwise("2b"))
    a, b = (sorted(tuple(r) for r in en.caruana(x, findings, truth, ["m0", "m1"], 2).collect()) for x in (carried, stack))
    assert a == b and len(a) == 6


def test_a_resampled_image_is_shuffled_by_plane_and_once_more(spark):
    from voxelmeter.plans import registry
    registry.load()
    plan = _plan(registry.QUERIES["c19_resample_image"](spark, SF))
    assert "SortMergeJoin" not in plan and "__salt" not in plan
    assert plan.count("Exchange hashpartitioning") <= 5  # two of them make the grids, two are of the join


def test_blocks_are_taken_in_parts():
    from voxelmeter.operators import distance as dist
    n = 2_000
    ranges = {name: pa.array([lo_hi] * n) for name, lo_hi in dict(lo0=0, hi0=11, lo1=0, hi1=9, lo2=0, hi2=7, block=0, wide=12).items()}
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), *ranges.values()], ["case_id", *ranges])
    parts = list(dist._parts(iter([batch]), None))
    assert sum((p.column("case_id").to_pylist() for p in parts), []) == list(range(n))
    assert len(parts) > 5 and all(p.num_rows * 960 <= dist._STACK for p in parts)


def test_dilation_over_many_parts_is_that_of_each_case(spark):
    """More cases in one partition than a part takes."""
    from voxelmeter.operators import distance as dist
    cases = spark.range(0, 700, 1, 1).selectExpr("id as case_id")
    mask = cases.selectExpr("case_id", "cast(case_id % 12 as int) as i", "cast(case_id % 10 as int) as j", "cast(case_id % 8 as int) as k")
    headers = cases.selectExpr("case_id", "array(12, 10, 8) as shape", "array(0.7D, 0.7D, 1.0D) as spacing")
    got = {}
    for r in dist.dilate(mask.coalesce(1), headers, 30.0).groupBy("case_id").count().collect():
        got[r.case_id] = r["count"]
    assert got == dict.fromkeys(range(700), 960)


def test_small_volumes_share_batches():
    import struct

    import pandas as pd

    from voxelmeter.sources import volumes
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 3, 2, 4, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 2, 8)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    files = pd.DataFrame({"path": [f"c{n}" for n in range(50)], "content": [bytes(head) + bytes((x + n) % 3 for x in range(24)) for n in range(50)]})
    out = list(volumes._voxels("first")(iter([files.iloc[:30], files.iloc[30:]])))
    assert len(out) == 1 and len(out[0]) == 50 * 16  # one batch, not one per plane
    row = out[0][out[0].path == "c4"]
    assert {(r.i, r.j, r.k): r.value for r in row.itertuples()} == {
        (x % 3, x // 3 % 2, x // 6): float((x + 4) % 3) for x in range(24) if (x + 4) % 3}


def test_small_arrays_share_batches(tmp_path):
    from voxelmeter.sources import score_arrays as sa
    folder = tmp_path / "m0" / "cases"
    folder.mkdir(parents=True)
    for n in range(20):
        np.save(folder / f"c{n}.npy", np.full((2, 3, 4), n, np.float32))
    reader = sa.ScoreArrayReader({"path": str(tmp_path), "chunk": "5"})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert len(batches) == 1 and batches[0].num_rows == 20 * 2 * 3
    rows = batches[0].to_pylist()
    assert {r["case_id"]: set(r["values"]) for r in rows} == {f"c{n}": {float(n)} for n in range(20)}
    assert sum(len(r["values"]) for r in rows) == 20 * 24 and all(r["shape"] == [3, 4] for r in rows)


def _small_stack(spark):
    """Stacks of whole findings with a group, beside the keys and truth that other forms ask for."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(11)
    rows = [(case, f, *(int(x) for x in rng.integers(0, 5, 3)), int(rng.random() < 0.3)) for case in range(9) for f in range(2) for _ in range(4 + case)]
    rows += [(20, 0, n, 0, 0, 0) for n in range(5)]  # a finding without truth
    voxels = spark.createDataFrame(rows, "case_id long, finding_id int, i int, j int, k int, is_gt int")
    stack = ch.voxel_stacks(voxels, {c: (F.col("i") * m + F.col("j") * 5 + F.col("k") + F.col("is_gt") * 20) / 200.0 for c, m in (("a", 25), ("b", 11), ("c", 7))})
    stack = stack.withColumn("fold", (F.col("case_id") % 3).cast("int")).withColumn("category", F.when(F.col("case_id") < 4, "x").otherwise("y"))
    truth = voxels.groupBy("case_id", "finding_id", "i", "j", "k").agg(F.max("is_gt").alias("g")).groupBy("case_id", "finding_id").agg(F.sum("g").alias("n_gt"))
    return stack, stack.select("case_id", "finding_id", "fold", "category"), truth


def _table(df, digits=9):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect())


def test_findings_become_stacks_by_one_sort(spark):
    stack, _, _ = _small_stack(spark)
    plan = _plan(stack)
    assert "Aggregate" not in plan
    assert plan.count("Sort ") == 1 and "Sort [__near" in plan


def test_a_sweep_of_whole_findings_moves_nothing(spark):
    from pyspark.sql import functions as F
    stack, keys, truth = _small_stack(spark)
    whole = sw.sweep(stack, None, None, [0.2, 0.3, 0.5], kind="probability", keep=["category"], baseline=0.3)
    per = keys.withColumn("candidate_id", F.explode(F.array(*[F.lit(c) for c in "abc"])))
    joined = sw.sweep(ch.unstacked(stack), per, truth, [0.2, 0.3, 0.5], kind="probability", key=["candidate_id", "case_id", "finding_id"], keep=["category"], baseline=0.3)
    assert _plan(whole).count("Exchange") == 1 and "Join" not in _plan(whole)
    assert _table(whole) == _table(joined) and len(_table(whole)) == 3 * 3 * 19


def test_totals_of_whole_findings_are_those_of_their_rows(spark):
    stack, keys, truth = _small_stack(spark)
    by_row = sw.threshold_sums(sw.sweep(stack, None, None, [0.2, 0.3, 0.5], kind="probability", keep=["category", "fold"]), ["candidate_id", "category", "fold"])
    assert _table(sw.threshold_totals(stack, [0.2, 0.3, 0.5], ["category", "fold"], "probability")) == _table(by_row)
    trial = [en.Recipe.of("ab", "probability", {"a": 1.0, "b": 1.0}), en.Recipe.of("c", "logit", {"c": 1.0})]
    a, b = (en.recipe_sums(stack, *x, trial, [0.5, 0.52, 0.6]) for x in ((None, None), (keys, truth)))
    assert _table(sw.per_threshold(a, ["recipe"])) == _table(sw.per_threshold(b, ["recipe"])) and len(_table(a)) == 6


@pytest.mark.parametrize("pieces", [1, 30])
def test_totals_do_not_depend_on_pieces(spark, monkeypatch, pieces):
    stack, _, _ = _small_stack(spark)
    batches = stack.toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(ch, "PIECE_VALUES", pieces)
    parts = [p.num_rows for p in ch._pieces(iter(batches))]
    assert sum(parts) == 19 and max(parts) <= 2


def test_searches_and_folds_take_stacks_without_keys(spark):
    stack, keys, truth = _small_stack(spark)
    folds, cuts = keys.select("case_id", "fold").distinct(), [0.5, 0.52, 0.6]
    paths = [en.greedy_forward(stack, *x, ["a", "b", "c"], "probability", 2, cuts, cuts) for x in ((None, None), (keys, truth))]
    assert paths[0] == paths[1]
    fine = [en.coordinate_refine(paths[0][-1], stack, *x, cuts, cuts, passes=1) for x in ((None, None), (keys, truth))]
    assert fine[0] == fine[1]
    records = [en.oof_greedy(stack, *x, ["a", "b", "c"], "probability", 2, cuts, cuts) for x in ((None, None, None), (keys, truth, folds))]
    assert _table(records[0]) == _table(records[1])
    trial = {"single": [en.Recipe.of(c, "probability", {c: 1.0}) for c in "abc"]}
    totals = en.recipe_sums(stack, None, None, trial["single"], cuts, ["fold", "category"])
    rows = en.score_recipes(stack, keys, truth, trial["single"], cuts)
    a, b = en.oof(totals, None, trial, cuts), en.oof(rows, folds, trial, cuts)
    assert _table(a) == _table(b)
    assert _table(en.oof_by_category(a, totals, None, None)) == _table(en.oof_by_category(b, rows, folds, keys))


@pytest.mark.parametrize("name", ["d7_category_oracle", "e5_coordinate_refine", "d3_sweep", "e3_greedy_forward", "e6_oof_categories", "d5_sweep_summary"])
def test_a_query_takes_findings_and_truth_from_its_stacks(spark, monkeypatch, name):
    from voxelmeter.plans import fixtures as fx
    from voxelmeter.plans import registry
    registry.load()

    def again(*_):
        raise AssertionError("the voxels are read a second time")
    monkeypatch.setattr(fx, "finding_keys", again)
    monkeypatch.setattr(fx, "gt", again)
    assert registry.QUERIES[name](spark, SF).count() > 0
