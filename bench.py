"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Each query is executed end to end into the ``noop`` sink (all work done, nothing shipped to the driver),
twice, with the cache cleared before each run; ``queries`` reports the faster run (this host's timing noise
is large) and ``first_run`` the first. A warm-up on sf0.001 and sf0.01 (not timed) loads the JVM classes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "label_posts", "active_authors", "article_lookup", "taxonomy_definitions",
    "extract_links", "label_sequence", "label_upsert", "distinct_categories",
    "stream_counters", "stall_gaps", "canonical_url", "slugify",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    from linkloom.plans.queries import QUERIES
    from linkloom.session import get_session
    spark = get_session(f"local[{cpus}]", app="linkloom-bench", shuffle_partitions=int(cpus) * 2)
    for warm in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):  # JIT warm-up, not timed
        if os.path.isdir(warm):
            QUERIES["label_posts"](spark, warm).write.format("noop").mode("overwrite").save()
    times, first = {}, {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            spark.catalog.clearCache()  # no run may reuse data another run persisted
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - t, 3))
        first[name] = runs[0]
        times[name] = min(runs)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds_best_of_runs", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "first_run": first,
                      "first_run_total": round(sum(first.values()), 3), "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
