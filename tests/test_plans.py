"""Joins with grids, repeated rows and written tables are shuffled: Spark takes such tables for smaller than they are."""

import pytest
from pyspark.sql import functions as F

from voxelmeter.functions import salted_join, tied_row_number
from voxelmeter.operators import grids, masks
from voxelmeter.plans import fixtures as fx
from voxelmeter.plans import queries_masks as qm
from voxelmeter.session import checkpointed

SF = "/root/testdata/sf0.001"


def no_broadcast(df):
    return "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_label_overlap_shuffles_the_atlas(spark):
    assert no_broadcast(masks.label_overlap(fx.gt(spark, SF), fx.anatomy(spark, SF), {"left": [10]}))


def test_salted_join_shuffles_the_repeats(spark):
    assert no_broadcast(salted_join(fx.gt(spark, SF), fx.headers(spark, SF), ["case_id"], masks.VOXEL))


def test_value_profile_shuffles_the_image(spark):
    plan = grids.value_profile(fx.findings(spark, SF), fx.intensity(spark, SF), fx.gt(spark, SF), {"low": ("below", 0.0)})
    assert " k#" not in _broadcasts(plan)


def test_regions_shuffle_the_grid(spark):
    assert "label#" not in _broadcasts(qm._regions(spark, SF))


@pytest.mark.parametrize("build", [
    lambda s: masks.supported_metrics(fx.finding_keys(s, SF), fx.pred_rows(s, SF), fx.gt_rows(s, SF), qm._allowed(s, SF)),
    lambda s: masks.outside_support(fx.finding_keys(s, SF), fx.gt(s, SF), qm._lung_part(s, SF))])
def test_gates_shuffle_the_words_of_grids(spark, build):
    assert "w#" not in _broadcasts(build(spark))


def test_written_tables_are_shuffled(spark):
    table = checkpointed(spark.range(10).select("id", F.lit("x").alias("x")))
    assert no_broadcast(spark.range(10_000_000).join(table, "id"))


def _broadcasts(df):
    return "".join(x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in x)


def test_cuts_of_buckets_are_worked_out_once(spark):
    rows = tied_row_number(spark.range(1000).select("id", (F.col("id") % 7).alias("v")), [], "v", "id")
    assert "percentile_approx" not in rows._jdf.queryExecution().toString()
    assert [r.rn for r in rows.orderBy("v", "id").collect()] == list(range(1, 1001))
