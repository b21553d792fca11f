"""Seeded property tests against plain-Python statements of the rules."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators.profile import null_profile
from quarry.operators.relational import not_in


def sql_not_in(x, sub):
    """Three-valued ``x NOT IN (sub)``: True / False / None (unknown)."""
    if not sub:
        return True
    if x is None:
        return None
    if x in sub:
        return False
    return None if any(s is None for s in sub) else True


keys = st.lists(st.one_of(st.none(), st.integers(0, 6)), max_size=12)


@settings(max_examples=12, deadline=None)
@given(keys, keys)
def test_not_in_matches_sql_rules(spark, left, sub):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(left)], "id int, k int")
    sq = spark.createDataFrame([(k,) for k in sub], "k int")
    want = sorted(i for i, k in enumerate(left) if sql_not_in(k, sub) is True)
    assert sorted(r.id for r in not_in(df, "k", sq, "k").collect()) == want


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10_000))
def test_null_profile_counts(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 60)
    rows = [tuple(None if rnd.random() < p else rnd.randint(0, 9) for p in (0.0, 0.3, 0.9, 1.0))
            for _ in range(n)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    got = {r.feature_name: (r.null_count, r.missing_pct) for r in null_profile(df).collect()}
    for j, name in enumerate("abcd"):
        nulls = sum(r[j] is None for r in rows)
        assert got[name] == (nulls, round(nulls * 100.0 / n, 4))
