"""Cleaning of a member snapshot.

All fills, derived columns and drops of one step are applied as a single
projection; nothing here shuffles.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.dates import days_between
from quarry.operators.profile import column_groups, drop_sparse, names_containing


@dataclass
class CleanSpec:
    """Parameters of the cleaning job (reference names in lower case)."""

    snapshot_day: dt.date
    last_login: str
    prior_login: str
    flag_like: Sequence[str] = ()
    fill_zero_named: Sequence[str] = ()
    drop_constant: Sequence[str] = ()
    drop_dates: Sequence[str] = ()
    drop_after: Sequence[str] = ()
    sparse_threshold: float = 90.0
    count_token: str = "count"
    string_fill: str = "Others"
    protect: Sequence[str] = field(default_factory=tuple)
    stage: bool = False      # write the input once before profiling it


def fill_values(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Fill NULLs per column. Like ``fillna``, a value is applied only
    to columns of a compatible type (0 into a string or date column is
    silently skipped). One ``na.fill`` per distinct value; Catalyst folds
    them into a single projection."""
    by_value: dict[tuple, list[str]] = {}
    for c, v in fills.items():
        by_value.setdefault((type(v).__name__, v), []).append(c)
    for (_, v), cols in by_value.items():
        df = df.na.fill(v, subset=cols)
    return df


def fill_by_group(df: DataFrame, spec: CleanSpec) -> tuple[DataFrame, dict[str, list[str]]]:
    """Drop sparse columns, then fill by type group in one projection:
    COUNT-named numeric columns -> 0, ``fill_zero_named`` -> 0, plain
    (non flag-like) strings -> ``string_fill``. Returns the frame and the
    column plan."""
    df, dropped = drop_sparse(df, spec.sparse_threshold, protect=spec.protect, stage=spec.stage)
    groups = column_groups(df, spec.flag_like)
    counts, _ = names_containing(groups["numeric"], spec.count_token)
    strings = [c for c in groups["string"] if c not in set(spec.flag_like)]
    fills: dict[str, object] = {c: 0 for c in counts}
    fills.update({c: 0 for c in spec.fill_zero_named if c in df.columns})
    fills.update({c: spec.string_fill for c in strings})
    plan = {"dropped_sparse": dropped, "count_filled": counts, "string_filled": strings, **groups}
    return fill_values(df, fills), plan


def clean_members(df: DataFrame, spec: CleanSpec) -> tuple[DataFrame, dict[str, list[str]]]:
    """Sparse drop and fills (``fill_by_group``), then drop near-constant
    and unused date columns, derive ``days_since_last_login`` /
    ``days_bw_last_two_logins`` (0 when unknown) and drop rows with any
    NULL -- the reference job's order."""
    df, plan = fill_by_group(df, spec)
    derived = {
        "days_since_last_login": days_between(spec.last_login, F.lit(spec.snapshot_day)),
        "days_bw_last_two_logins": days_between(spec.prior_login, spec.last_login),
    }
    gone = set(spec.drop_constant) | set(spec.drop_dates) | {spec.last_login, spec.prior_login} \
        | set(spec.drop_after)
    out = df.select(*[c for c in df.columns if c not in gone],
                    *[F.coalesce(e, F.lit(0)).cast("bigint").alias(n) for n, e in derived.items()])
    return out.na.drop(how="any"), plan


def drop_columns(df: DataFrame, cols: Iterable[str], strict: bool = False) -> DataFrame:
    """P1 (D18): drop a list; with ``strict`` a missing name is an error."""
    cols = list(cols)
    if strict:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)
