"""Semi / anti joins and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_subquery(df: DataFrame, key: str | Column, sub: DataFrame, sub_key: str) -> DataFrame:
    """``key IN (SELECT sub_key FROM sub)`` as a left semi join.

    Keys are de-duplicated (map-side first) before the shuffle, so a hot
    key in ``sub`` costs one row per task.
    """
    k = F.col(key) if isinstance(key, str) else key
    keys = sub.select(F.col(sub_key).alias("__in")).where(F.col("__in").isNotNull()).distinct()
    return df.join(keys, k == keys["__in"], "left_semi")


def not_in(df: DataFrame, key: str, sub: DataFrame, sub_key: str) -> DataFrame:
    """SQL ``key NOT IN (SELECT sub_key FROM sub)`` with its NULL rules.

    * empty subquery -> every row (NULL keys included);
    * any NULL in the subquery -> no row;
    * otherwise rows with a non-NULL key absent from the subquery.

    Spark plans ``NOT IN`` as a null-aware anti join that must broadcast
    the whole subquery, or else falls back to a nested-loop join. This is
    one lazy plan instead: the distinct keys (one shuffle, NULL among them)
    feed a plain ``left_anti`` join and a scalar subquery of one row that
    says whether the subquery is empty or holds a NULL; Spark reuses their
    common exchange.
    """
    keys = sub.select(F.col(sub_key).alias("__nin")).distinct()
    facts = keys.agg(F.struct(F.count(F.lit(1)).alias("n"),
                              F.count_if(F.col("__nin").isNull()).alias("nulls")).alias("f"))
    left = df.withColumn("__f", facts.scalar())
    left = left.filter((F.col("__f.n") == 0) | ((F.col("__f.nulls") == 0) & F.col(key).isNotNull())).drop("__f")
    return left.join(keys, F.col(key) == keys["__nin"], "left_anti")


def remove_keys(df: DataFrame, key: str, used: DataFrame, used_key: str | None = None) -> DataFrame:
    """J9 (D5): drop rows whose key appears in ``used`` (training ids)."""
    uk = used_key or key
    keys = used.select(F.col(uk).alias("__used")).distinct()
    return df.join(keys, F.col(key) == keys["__used"], "left_anti")


def row_difference(a: DataFrame, b: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """Rows of ``a`` not in ``b`` (``EXCEPT``; ``EXCEPT ALL`` when
    ``keep_duplicates``)."""
    return a.exceptAll(b) if keep_duplicates else a.subtract(b)


def lookup_label(df: DataFrame, code: str, dim: DataFrame, dim_key: str, dim_label: str,
                 out: str, default: str | None = None) -> DataFrame:
    """C8 when the code -> label map is a table: a left join on the code.

    A code has one label: of several the smallest counts, so rows never
    multiply. Spark's own threshold decides whether the dimension is
    broadcast.
    """
    d = dim.groupBy(F.col(dim_key).alias("__code")).agg(F.min(dim_label).alias("__label"))
    j = df.join(d, df[code] == d["__code"], "left")
    lab = F.col("__label") if default is None else F.coalesce(F.col("__label"), F.lit(default))
    return j.withColumn(out, lab).drop("__code", "__label")
