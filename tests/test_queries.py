"""Registered queries against DuckDB on the smallest tables.

The default run takes one or two queries of each kind; VOXELMETER_ALL=1 runs all of them.
"""

import glob
import math
import os

import duckdb
import pytest

from voxelmeter.plans import registry

SF = "/root/testdata/sf0.001"
registry.load()
QUICK = ["a1_read_census", "a5_decode_typed_json", "a7_path_parts", "b1_align", "b3_fingerprint", "b6_validate_chain", "b7_journal_report",
         "c1_mask_metrics", "c5_partition_fp", "c8_component_relations", "c11_support_distance", "c19_resample_mask", "c22_positive_points",
         "c23_tile_coverage", "d3_sweep", "d6_best_threshold", "d8_retention_threshold", "e1_ensemble", "e2_score_recipes", "e7_pairwise",
         "e9_category_oracle", "f2_cluster_bootstrap", "f5_two_prop_bh", "f11_pareto", "f13_difficulty_strata", "f15_rolling", "g5_balanced_halves",
         "g8_block_schedule", "g9_event_check", "h2_classify", "h3_route_scope", "i2_rank_category", "i3_submitter_rank", "i8_select_milestone",
         "j4_heartbeat_stream"]
NAMES = sorted(registry.ORACLES) if os.environ.get("VOXELMETER_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    return str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    mine = df.collect()
    cur = duck.execute(registry.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    a = sorted(tuple(canon(r[c]) for c in order) for r in mine)
    b = sorted(tuple(canon(r[cols.index(c)]) for c in order) for r in cur.fetchall())
    assert a == b


def test_every_query_has_a_name_from_the_inventory():
    wanted = {f"{s}{n}" for s, k in dict(a=10, b=16, c=27, d=8, e=10, f=16, g=14, h=5, i=12, j=4).items() for n in range(1, k + 1)}
    assert wanted == {q.split("_")[0] for q in registry.QUERIES}
    assert set(registry.ORACLES) <= set(registry.QUERIES)
