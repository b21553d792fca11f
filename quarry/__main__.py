"""Command line for the two text jobs.

    python -m quarry split-diffs <diff_dir> <out_dir> [--budget 100000]
    python -m quarry review <src_dir> <out_dir> --model package.module:function [--fan-in 8]

The model is any importable ``function(prompt: str) -> str`` (no client is
shipped); ``quarry.operators.reviews:stub_reviewer`` style factories can be
named with a trailing ``()``.
"""

from __future__ import annotations

import argparse
import importlib
import sys


def _load(spec: str):
    mod, _, attr = spec.partition(":")
    call = attr.endswith("()")
    obj = getattr(importlib.import_module(mod), attr.rstrip("()"))
    return obj() if call else obj


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="quarry")
    sub = ap.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("split-diffs", help="split every *.diff file into token-budgeted chunks")
    s.add_argument("diff_dir")
    s.add_argument("out_dir")
    s.add_argument("--budget", type=int, default=100_000)
    r = sub.add_parser("review", help="review every .py/.sql file and consolidate the reviews")
    r.add_argument("src_dir")
    r.add_argument("out_dir")
    r.add_argument("--model", required=True, help="module:function taking a prompt, returning text")
    r.add_argument("--fan-in", type=int, default=8)
    r.add_argument("--master", default=None)
    s.add_argument("--master", default=None)
    a = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    from quarry.plans.jobs import review_job, split_diffs_job
    from quarry.session import build_session

    spark = build_session(a.master) if a.master else SparkSession.builder.getOrCreate()
    if a.cmd == "split-diffs":
        n = split_diffs_job(spark, a.diff_dir, a.out_dir, a.budget).count()
        print(f"{n} chunks written to {a.out_dir}")
    else:
        out = review_job(spark, a.src_dir, a.out_dir, _load(a.model), fan_in=a.fan_in)
        print(f"{out['reviews'].count()} reviews, {out['review_errors'].count()} errors, "
              f"summary in {a.out_dir}/summary")
    return 0


if __name__ == "__main__":
    sys.exit(main())
