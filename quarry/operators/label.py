"""Click label."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_keys_since(events: DataFrame, key: str, ts_col: str, since: dt.date,
                        where=None) -> DataFrame:
    """A5: distinct keys with an event on or after ``since`` (``GROUP BY 1``).

    The de-duplication is aggregated map-side first, so a key holding a
    large share of the events reaches the shuffle as one row per task.
    """
    cond = F.to_date(F.col(ts_col)) >= F.lit(since)
    if where is not None:
        cond = cond & where
    return events.filter(cond).select(F.col(key).alias("__clicker")).distinct()


def add_existence_label(df: DataFrame, key: str, keys: DataFrame,
                        label: str = "clicked_or_not") -> DataFrame:
    """Left join to the distinct keys of ``keys``; ``'True'`` when
    matched, ``'False'`` otherwise. The keys are de-duplicated (map-side
    first; Catalyst drops the step when the input is already distinct), so
    rows never multiply."""
    ks = keys.select(F.col(keys.columns[0]).alias("__k")).distinct()
    j = df.join(ks, df[key] == ks["__k"], "left")
    return j.withColumn(label, F.when(F.col("__k").isNull(), F.lit("False"))
                        .otherwise(F.lit("True"))).drop("__k")


def label_counts(df: DataFrame, label: str = "clicked_or_not") -> DataFrame:
    """A4: rows per label value."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
