"""Per-key feature tables and their assembly.

Each feature table is aggregated to one row per key before it is joined,
so the left joins never multiply rows, and map-side partial aggregation
collapses hot keys before the shuffle. All joins share the key: once the
base is hash-partitioned on it, Spark reuses that partitioning for every
join in the chain.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by_key(df: DataFrame, key: str, value: str | Column, alias: str,
                 out_key: str | None = None, where: Column | None = None) -> DataFrame:
    """Non-NULL count of ``value`` per key."""
    if where is not None:
        df = df.filter(where)
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(F.col(key).alias(out_key or key)).agg(F.count(v).alias(alias))


def count_in_window(df: DataFrame, key: str, value: str, ts_col: str,
                    start: dt.date, end: dt.date, alias: str,
                    out_key: str | None = None, end_inclusive: bool = True) -> DataFrame:
    """Count per key of rows whose day lies in ``[start, end]``
    (``[start, end)`` with ``end_inclusive=False``, D2)."""
    day = F.to_date(F.col(ts_col))
    cond = (day >= F.lit(start)) & ((day <= F.lit(end)) if end_inclusive else (day < F.lit(end)))
    return count_by_key(df, key, value, alias, out_key, where=cond)


def distinct_count_by(df: DataFrame, keys: Sequence[Column], value: str, alias: str) -> DataFrame:
    """``count(DISTINCT value)`` per key tuple."""
    return df.groupBy(*keys).agg(F.count_distinct(F.col(value)).alias(alias))


def sum_over_union(parts: Sequence[DataFrame], key: str, value: str, alias: str) -> DataFrame:
    """U1 + A8: ``UNION ALL`` of same-shaped parts (matched by name), then
    ``SUM(value)`` per key."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(key).agg(F.sum(value).alias(alias))


def assemble(base: DataFrame, key: str, features: Sequence[DataFrame]) -> DataFrame:
    """Left joins on ``key`` (``USING``); NULLs kept."""
    out = base
    for f in features:
        out = out.join(f, key, "left")
    return out
