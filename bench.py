"""Times the headline queries on local[$BENCH_CPUS] and prints one JSON line."""
from __future__ import annotations

import json
import os
import time

from pricelens.registry import all_queries
from pricelens.session import local_session

HEADLINE = [
    "daily_structure_summary",    # peer medians and residuals from lineitem
    "rul_07_candidate_level",     # full daily screen
    "agg_08_quality",             # study preparation
    "win_20_event_clusters",      # study candidates and clustering
    "agg_07_distributions",       # exact quantiles of groups of any size
    "joi_06_peer_asof",           # as-of join of every frame with its peers
    "agg_06_fair_price",          # trailing medians and percentiles
    "rul_11_candidate_trigger",   # detector up to candidates
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    queries, seconds = all_queries(), {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
