"""List plan features of every registered query that would not scale.

usage: python tools/plans.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import fnmatch
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shoalmark.catalog import QUERIES  # noqa: E402
from shoalmark.session import local_session  # noqa: E402

NEVER = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
         "FlatMapGroupsInPandas", "MapInArrow")


def findings(plan: str) -> list[str]:
    out = [n for n in NEVER if n in plan]
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        # a window over one partition, unless it runs on per-partition offsets
        if re.search(r"\bWindow\b", line) and any("SinglePartition" in x for x in lines[i:i + 4]):
            out.append("single-partition window: " + line.strip()[:160])
    return out


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[-1]


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.001")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    for n, fn in QUERIES.items():
        if not a.names or any(fnmatch.fnmatch(n, p) for p in a.names):
            for f in findings(plan_of(fn(spark, a.sf))):
                print(f"{n}: {f}", flush=True)


if __name__ == "__main__":
    main()
