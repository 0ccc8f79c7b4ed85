"""Condensed physical plans of every registered query (writes PLANS.md).

    python tools/plan_summary.py [sf_dir]

Per query: shuffles, broadcasts, aggregate kinds, windows, sorts, Python
nodes and the columns each parquet scan reads.  Plans are taken after
building the query (streaming and checkpointing queries have run by then).
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange RoundRobinPartitioning",
         "Exchange SinglePartition", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate", "SortAggregate", "ObjectHashAggregate",
         "Window", "Sort ", "Generate", "MapInArrow", "MapInPandas", "FlatMapGroupsInPandas", "ArrowEvalPython", "BatchEvalPython"]


def summarize(df) -> tuple[Counter, list]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    c = Counter()
    for line in plan.splitlines():
        for n in NODES:
            if n in line:
                c[n.strip()] += 1
    scans = sorted(set(re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\][^\n]*?/(\w+)\.parquet", plan)))
    return c, [(t, re.sub(r"#\d+L?", "", cols)) for cols, t in scans]


def main(argv):
    from revlens.plans.queries import QUERIES
    from revlens.session import get_spark

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8)
    out = ["# Physical plans (condensed)", "",
           f"Generated by `tools/plan_summary.py` on `{sf}` with AQE on (plans before adaptive re-planning).", "",
           "| query | shuffles | joins | aggregates | windows/sorts | python | scans (table: columns) |",
           "| --- | --- | --- | --- | --- | --- | --- |"]
    for name, fn in QUERIES.items():
        c, scans = summarize(fn(spark, sf))
        shuffles = ", ".join(f"{k.replace('Exchange ', '')}×{v}" for k, v in c.items() if k.startswith("Exchange")) or "–"
        joins = ", ".join(f"{k}×{v}" for k, v in c.items() if "Join" in k or k in ("CartesianProduct", "BroadcastExchange")) or "–"
        aggs = ", ".join(f"{k}×{v}" for k, v in c.items() if "Aggregate" in k) or "–"
        win = ", ".join(f"{k}×{v}" for k, v in c.items() if k in ("Window", "Sort", "Generate")) or "–"
        py = ", ".join(f"{k}×{v}" for k, v in c.items() if "Pandas" in k or "Arrow" in k or "EvalPython" in k) or "–"
        sc = "; ".join(f"{t}: {cols}" for t, cols in scans) or "(checkpoint / stream output)"
        out.append(f"| {name} | {shuffles} | {joins} | {aggs} | {win} | {py} | {sc} |")
        print(out[-1][:200], flush=True)
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out) + "\n")


if __name__ == "__main__":
    main(sys.argv[1:])
