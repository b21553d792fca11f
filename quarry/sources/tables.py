"""Table scans."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")


def load_table(spark: SparkSession, root: str, name: str,
               spread: int | None = None) -> DataFrame:
    """Scan one parquet table ``<root>/<name>.parquet`` (all columns;
    Catalyst prunes to what the plan uses).

    ``spread``: deal the rows over so many partitions first. For CPU-heavy
    row-local work (regexes over long texts) on a small file stored as one
    row group; it shuffles the texts, so it is the caller's choice and off
    by default.
    """
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
    return df.repartition(spread) if spread else df


def register_tables(spark: SparkSession, root: str,
                    names: Iterable[str] = TEST_TABLES) -> None:
    """Expose tables as temp views so ``spark.sql`` can scan them."""
    for n in names:
        load_table(spark, root, n).createOrReplaceTempView(n)


def day_of(c: str | Column) -> Column:
    """Calendar day of a timestamp (``DATE(ts)``)."""
    return F.to_date(F.col(c) if isinstance(c, str) else c)


def snapshot_scan(df: DataFrame, ts_col: str, snapshot_day: dt.date,
                  where: Column | None = None,
                  drop: Iterable[str] = ()) -> DataFrame:
    """S3/F1: rows whose ``DATE(ts_col)`` equals ``snapshot_day``, an extra
    predicate, minus a column list.

    The day test is written as a half-open timestamp range on the raw
    column, so the parquet scan receives it as a pushed filter and can
    skip row groups by min/max statistics.
    """
    # Bounds are built from ISO text cast to the column's own type, so the
    # day boundaries do not depend on the Python process's time zone.
    lo, hi = snapshot_day.isoformat(), (snapshot_day + dt.timedelta(days=1)).isoformat()
    ts, typ = F.col(ts_col), df.schema[ts_col].dataType
    cond = (ts >= F.lit(lo).cast(typ)) & (ts < F.lit(hi).cast(typ))
    if where is not None:
        cond = cond & where
    return df.filter(cond).drop(*drop)


def part_filter(df: DataFrame, key: str, num_parts: int, part: int) -> DataFrame:
    """One of ``num_parts`` disjoint, stable parts of a table chosen
    by a hash of ``key``. A user-level option for scoring a table in
    separately committed pieces; one distributed pass over the whole table
    is the default everywhere in this library."""
    if not 0 <= part < num_parts:
        raise ValueError("part must be in [0, num_parts)")
    return df.filter(part_of(key, num_parts) == part)


def part_of(key: str, num_parts: int) -> Column:
    """The number of a row's part, for parts written by one pass."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(num_parts)).cast("int")


# The 8-column contact table definition from the reference DDL.
CONTACT_SCHEMA = T.StructType([
    T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()),
    T.StructField("phone_num", T.LongType()),
    T.StructField("address", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("zipcode", T.LongType()),
    T.StructField("country", T.StringType()),
    T.StructField("account_num", T.StringType()),
])


def create_table(spark: SparkSession, path: str,
                 schema: T.StructType = CONTACT_SCHEMA) -> DataFrame:
    """``CREATE OR REPLACE TABLE`` on a parquet path: overwrite with an
    empty frame of the fixed schema and return the (empty) table."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
