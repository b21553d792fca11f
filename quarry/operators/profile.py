"""Null profiling and data-dependent column planning.

The profile is one aggregate job: the row count and one ``count_if(isNull)``
per column are computed in a single pass with map-side partial
aggregation, so the shuffle carries one partial row per task. The result
has one row per *column* (bounded by the schema width, not the data) and
is the only thing the driver collects to plan the next ``select``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROWS = "__rows__"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A1-A3 + P9: long-format ``(feature_name, null_count, row_count,
    missing_pct)``.

    ``missing_pct = null_count / rows * 100`` rounded to 4 decimals for
    display, NULL for an empty input; decisions use the counts.
    """
    cols = list(cols if cols is not None else df.columns)
    aggs = [F.count(F.lit(1)).alias(_ROWS)]
    aggs += [F.count_if(F.col(_q(c)).isNull()).alias(c) for c in cols]
    wide = df.agg(*aggs)
    long = wide.unpivot([_ROWS], [F.col(_q(c)) for c in cols],
                        "feature_name", "null_count")
    pct = F.try_divide(F.col("null_count").cast("double") * F.lit(100.0),
                       F.col(_ROWS).cast("double"))
    return long.select("feature_name", F.col("null_count").cast("bigint").alias("null_count"),
                       F.col(_ROWS).cast("bigint").alias("row_count"), F.round(pct, 4).alias("missing_pct"))


def top_missing(profile: DataFrame, n: int = 5) -> DataFrame:
    """O1/O2: highest missing share first, name as tie-break, first ``n``."""
    return profile.orderBy(F.col("null_count").desc(), F.col("feature_name").asc()).limit(n)


def sparse_columns(profile: DataFrame, threshold: float = 90.0) -> list[str]:
    """names whose missing share is strictly above ``threshold``."""
    above = F.col("null_count").cast("double") * 100.0 > F.lit(float(threshold)) * F.col("row_count").cast("double")
    rows = profile.filter(above).select("feature_name").collect()
    return sorted(r.feature_name for r in rows)


def complete_columns(profile: DataFrame) -> list[str]:
    """names with no missing value (of an empty input none is complete)."""
    rows = profile.filter((F.col("null_count") == 0) & (F.col("row_count") > 0)).select("feature_name").collect()
    return sorted(r.feature_name for r in rows)


def drop_sparse(df: DataFrame, threshold: float = 90.0, protect: Iterable[str] = (),
                stage: bool = False) -> tuple[DataFrame, list[str]]:
    """Profile, then drop columns above ``threshold`` % NULL in one select.

    With ``stage`` the input is first written once under the shared
    checkpoint folder (K3), so the profile pass and the final select read
    that table instead of recomputing the upstream plan twice.
    """
    if stage:
        from quarry.sinks.tables import materialize
        df = materialize(df, "profiled")
    keep_always = set(protect)
    dropped = [c for c in sparse_columns(null_profile(df), threshold) if c not in keep_always]
    return df.select(*[F.col(_q(c)) for c in df.columns if c not in set(dropped)]), dropped


def column_groups(df: DataFrame, flag_like: Iterable[str] = ()) -> dict[str, list[str]]:
    """Split columns by type.

    ``flag_like`` string columns are re-classed as boolean (so they escape
    the string fill). Numeric means a real numeric type (D3); timestamps
    are reported with dates; anything else lands in ``other``.
    """
    flags = set(flag_like)
    groups: dict[str, list[str]] = {"bool": [], "string": [], "date": [], "numeric": [], "other": []}
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, T.BooleanType) or f.name in flags:
            groups["bool"].append(f.name)
        elif isinstance(t, T.StringType):
            groups["string"].append(f.name)
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            groups["date"].append(f.name)
        elif isinstance(t, T.NumericType):
            groups["numeric"].append(f.name)
        else:
            groups["other"].append(f.name)
    return groups


def names_containing(names: Iterable[str], token: str) -> tuple[list[str], list[str]]:
    """Split names on a case-insensitive substring; (matching, rest)."""
    hit = [n for n in names if token.lower() in n.lower()]
    return hit, [n for n in names if n not in hit]
