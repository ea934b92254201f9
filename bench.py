"""Benchmark the headline contract queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is planned anew and fully materialised (a no-op write, so every row is produced
but nothing is collected). The survey table is derived from the driver tables and
checkpointed once, in the first warm-up; ``survey_frame`` and ``order_rules`` time the raw
tables, the rest start from that checkpoint. One warm-up pass, then the median of
``BENCH_REPEATS`` timed runs per query. Prints ONE JSON line.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "survey_frame", "kpis", "segment_profile", "vw_curves", "vw_points", "rules",
    "rules_by_segment", "order_rules", "cooccurrence", "assign_fixed_centroids",
    "silhouette_fixed", "binary_metrics", "roc_points", "auc", "compare_models",
    "evidence_facts", "kmeans_labels", "forest_scores", "tree_rules",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    os.environ.setdefault("SURVEYKIT_MASTER", f"local[{cpus}]")
    from surveykit.plans.contract import QUERIES
    from surveykit.session import get_session

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    times, failed = {}, {}
    for name in only or HEADLINE:
        fn = QUERIES[name]
        try:
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
            warm = time.perf_counter() - t0
            samples = []
            for _ in range(repeats):
                t = time.perf_counter()
                df = fn(spark, sf_dir)
                df.write.format("noop").mode("overwrite").save()
                samples.append(time.perf_counter() - t)
        except Exception as e:  # keep benchmarking the rest; report the failure
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            print(f"# {name}: FAILED {failed[name]}", file=sys.stderr, flush=True)
            continue
        times[name] = round(statistics.median(samples), 3)
        print(f"# {name}: warm-up {warm:.2f}s, median {times[name]:.3f}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus),
                      "repeats": repeats, **({"failed": failed} if failed else {})}))


if __name__ == "__main__":
    main()
