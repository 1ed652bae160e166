"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

Each query is run once to warm up and then timed (median of three); the total of
the medians is the metric.
"""

import json
import os
import statistics
import time

from sparkwright.operators.profiling import force
from sparkwright.plans.catalogue import QUERIES
from sparkwright.session import session

HEADLINE = [
    "allocation", "pool_breakdown", "sentinel_ranking", "segment_mart", "flatten_star", "feature_rows", "duplicate_mark", "content_key", "rule_rejects", "quarantine_rows", "dim_members", "fact_surrogate",
    "aggregates", "medians", "anti_new", "semi_exists", "topk_segments", "cross_replicate", "split_balance", "scan_bytes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", int(cpus), spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        force(QUERIES[name](spark, folder))
        times = []
        for _ in range(3):
            t = time.perf_counter()
            force(QUERIES[name](spark, folder))
            times.append(time.perf_counter() - t)
        seconds[name] = round(statistics.median(times), 4)
    sf = folder.rstrip("/").rpartition("sf")[2]
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
