"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

from loomgraph.plans import catalog  # noqa: E402
from loomgraph.runtime import session  # noqa: E402

NAMES = (
    "match_count_group", "match_two_patterns", "match_exists", "path_bounded_1_4", "reach_impact", "degree_god_nodes", "pagerank_fixed", "dsm_cells", "surprise_score",
    "cochange_pairs", "ownership_share", "flaky_tests", "asof_status", "inventory_pivot", "regex_search_lines", "tokens_idf", "bm25_topk", "passage_windows", "stale_claims", "session_debounce",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["latest_row"](spark, sf).write.format("noop").mode("overwrite").save()  # code and readers are warm
    took = {}
    for name in NAMES:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
