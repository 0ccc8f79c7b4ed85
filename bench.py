"""Benchmark of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: {"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is run to completion through the no-op sink (all rows produced,
nothing collected to the driver).  Before timing, every headline query runs
once on the smallest scale factor as a JVM warm-up (class loading, code
generation); the timed runs then read $BENCH_SF_DIR.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["issue_counts", "dedupe_reviews", "classify_keyword", "weekly_trend", "merge_reviews",
            "channel_metrics", "labeling_template", "model_channel_pivot"]


def main() -> None:
    from revlens.plans.queries import QUERIES
    from revlens.session import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2,
                      extra_conf={"spark.driver.memory": "16g", "spark.sql.files.maxPartitionBytes": str(32 << 20)})
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in names:  # warm-up, not timed
        QUERIES[name](spark, warm_dir if os.path.isdir(warm_dir) else sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
