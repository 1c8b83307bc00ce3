"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_QUERIES (comma list)
overrides the selection.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from voxelmeter.plans import registry  # noqa: E402
from voxelmeter.session import build_session  # noqa: E402

HEADLINE = ["c1_mask_metrics", "c2_supported_metrics", "c3_edit_metrics", "c5_partition_fp", "c6_components", "c11_support_distance",
            "d3_sweep", "d5_sweep_summary", "e2_score_recipes", "e4_caruana", "e7_pairwise", "f1_describe", "f2_cluster_bootstrap",
            "g8_block_schedule", "h2_classify", "i2_rank_category", "i11_error_atlas", "j4_heartbeat_stream"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    registry.load()
    spark = build_session("bench", cores, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
