"""Plan-shape guards: no nested-loop or cartesian joins anywhere, filters
pushed to the scans."""

import re

import pytest

from quarry.plans import catalog  # noqa: F401  (registers every query)
from quarry.plans.registry import QUERIES

from .conftest import SF001

# These train models or write files while being defined.
SKIP = {"q44_train_metrics", "q45_score", "q47_table_roundtrip", "q48_text_directory", "q49_click_train_score",
        "q53_diff_folder"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_quadratic_joins(spark, name):
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", plan), name


def test_renewals_filters_reach_the_scans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = QUERIES["q11_renewals"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln]
    assert scans and all("ReadSchema" in s for s in scans)
    assert any("GreaterThan(l_quantity,5.0)" in s for s in scans)
    # DATE(ts) < 2024-01-30 reaches the events scan as a timestamp bound
    assert any("LessThan(ts,2024-01-30" in s for s in scans)
    # column pruning: the lineitem scan reads 7 of its 11 columns
    li = [s for s in scans if "l_orderkey" in s][0]
    assert "l_extendedprice" not in li and "l_tax" not in li


def test_snapshot_day_is_a_pushed_range(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = QUERIES["q02_snapshot_scan"](spark, SF001)._jdf.queryExecution() \
            .executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(ts,2024-01-20T00:00)" in plan and "LessThan(ts,2024-01-21T00:00)" in plan
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name, bounds", [
    ("q30_year_month_filter", ["GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)", "LessThan(o_orderdate,1996-03-01T00:00)"]),
    ("q31_prior_year_day", ["GreaterThanOrEqual(o_orderdate,1998-03-31T00:00)", "LessThan(o_orderdate,1997-04-01T00:00)"])])
def test_month_and_day_choices_are_pushed_ranges(spark, name, bounds):
    spark.conf.set("spark.sql.maxMetadataStringLength", "3000")
    try:
        plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters", 1)[1]
    assert all(b in pushed for b in bounds), pushed[:1500]


def test_renewals_shuffle_the_large_side_no_more_than_needed(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["q11_renewals"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = set(re.findall(r"Exchange hashpartitioning\(.*?\[plan_id=(\d+)\]", plan))   # a subquery is printed often
    assert len(exchanges) <= 22 and "Broadcast" not in plan
    # lineitem is dealt once by part, once by order
    assert len(re.findall(r"Exchange hashpartitioning\(trans_id", plan)) == 1
