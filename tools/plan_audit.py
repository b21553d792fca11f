"""Summarise each registered query's physical plan: shuffles, join
strategies, single-partition exchanges, nested-loop joins, Python stages.

    python tools/plan_audit.py [--sf DIR] [names...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--show", action="store_true")
    ap.add_argument("--markdown", action="store_true")
    ap.add_argument("--no-broadcast", action="store_true",
                    help="plan as if every join side were too large to broadcast")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from quarry.plans import catalog  # noqa: F401  (registers every query)
    from quarry.plans.registry import QUERIES
    from quarry.session import build_session
    extra = {"spark.sql.adaptive.enabled": "false"}
    if a.no_broadcast:
        extra["spark.sql.autoBroadcastJoinThreshold"] = "-1"
    spark = build_session("local[8]", shuffle_partitions=16, extra=extra)
    pats = {"xchg": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin",
            "single": r"Exchange SinglePartition", "bhj": r"BroadcastHashJoin", "smj": r"SortMergeJoin",
            "shj": r"ShuffledHashJoin", "bnlj": r"BroadcastNestedLoopJoin", "cart": r"CartesianProduct",
            "py": r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas",
            "win": r"Window \["}
    if a.markdown:
        print("| query | " + " | ".join(pats) + " |")
        print("|" + " --- |" * (len(pats) + 1))
    for name, fn in QUERIES.items():
        if a.names and not any(name.startswith(n) for n in a.names):
            continue
        if name in ("q44_train_metrics", "q48_text_directory", "q49_click_train_score", "q53_diff_folder"):  # jobs
            continue
        plan = fn(spark, a.sf)._jdf.queryExecution().executedPlan().toString()
        # a subquery or a reused exchange is printed wherever it is read: count lines by their plan id
        lines = {re.search(r"\[plan_id=\d+\]|$", ln).group() or i: ln for i, ln in enumerate(plan.splitlines())}
        counts = {k: sum(bool(re.search(v, ln)) for ln in lines.values()) for k, v in pats.items()}
        flags = " ".join(f"{k}={v}" for k, v in counts.items() if v)
        if a.markdown:
            print("| " + " | ".join([name] + [str(counts[k]) for k in pats]) + " |")
        else:
            print(f"{name:32s} {flags}")
        if a.show:
            print(plan)
    spark.stop()


if __name__ == "__main__":
    main()
