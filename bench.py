"""Bench: run the headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1)
with local[$BENCH_CPUS] and print one JSON line of wall-clock seconds.

Each query is executed in full through the no-op sink (no collect to the driver).
Before timing, the same queries run once on the smallest table set (not timed):
that warms the JVM's JIT and Spark's generated-code cache the way a long-running
service is warm; no data or result of the timed run is reused."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans import registry  # noqa: E402
from tessera.session import get_spark  # noqa: E402

HEADLINE = ["tokenize_counts", "tfidf_topk", "tfidf_topk_filtered", "course_pipeline", "integrated_topk",
            "dense_topk_l2", "dense_review_topk", "bm25_topk", "report_reviews", "input_verdict",
            "retry_loop", "rouge_n"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    # 4 shuffle partitions per core; AQE coalesces small ones at run time.
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=4 * int(cpus))
    qs = registry.queries()
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        for n in names:
            qs[n](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
