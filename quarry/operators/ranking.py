"""Exact position of each row inside its group in a given order, computed
without sending a whole group to one task.

``Window.partitionBy(group).orderBy(...)`` would place every row of a
group in a single task; a group holding a third of the data would then
serialise on one core. Here the rows are range-partitioned on
``(group, order…)`` (hot groups are split across many partitions by their
order keys), each partition counts its rows per group, and a small
prefix sum over those counts (one row per partition and group) gives every
partition its starting offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir
from quarry.sinks.tables import materialize

_ROW_BITS = (1 << 33) - 1   # monotonically_increasing_id keeps the row index in the low 33 bits


def ordered_rank(df: DataFrame, group: Sequence[str], order: Sequence[str],
                 out: str = "rank", num_partitions: int | None = None,
                 total: str | None = None) -> DataFrame:
    """Add ``out``: 0-based position of the row within ``group`` by ``order``,
    and with ``total`` the group's number of rows.

    The range-partitioned, sorted data is checkpointed to the shared
    checkpoint folder so partition ids and row positions are stable when a
    task is retried or the plan is evaluated twice.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A hash of the whole row breaks ties deterministically, so even a run of
    # identical (group, order) keys can be split across range partitions.
    df = df.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    keys = [*group, *order, "__tie"]
    s = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
    s = s.withColumns({"__pid": F.spark_partition_id(),
                       "__row": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))})
    stats = s.groupBy("__pid", *group).agg(F.count(F.lit(1)).alias("__cnt"),
                                           F.min("__row").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = stats.select(F.col("__pid").alias("__opid"), "__first",
                        F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off"),
                        F.sum("__cnt").over(Window.partitionBy(*group)).alias("__all"),
                        *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)])
    # Staged: the planner then sees the real size of these few rows (one per
    # partition and group) and needs no second shuffle of the ranked rows.
    offs = materialize(offs, "rank-offsets")
    same = F.col("__pid") == F.col("__opid")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))      # a NULL group is a group
    ranked = s.join(offs, same)
    added = [(F.col("__off") + F.col("__row") - F.col("__first")).cast("bigint").alias(out)]
    if total:
        added.append(F.col("__all").cast("bigint").alias(total))
    return ranked.select(*df.columns[:-1], *added)


def ordered_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], values: dict[str, str],
                 num_partitions: int | None = None) -> DataFrame:
    """Add, for each ``{value: out}``, the sum of ``value`` over the rows of
    the group that come before the row in ``order`` (which must tell the rows
    of a group apart). As ``ordered_rank``, without a task that holds a group:
    sums inside a range partition, and a prefix sum over the partitions' totals.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    s = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).checkpoint(eager=True) \
          .withColumn("__pid", F.spark_partition_id())
    totals = s.groupBy("__pid", *group).agg(*[F.sum(v).alias(f"__t{i}") for i, v in enumerate(values)])
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(F.col("__pid").alias("__opid"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)],
                         *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__o{i}") for i, _ in enumerate(values)])
    offs = materialize(offs, "sum-offsets")                      # one row per partition and group
    inside = Window.partitionBy("__pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = s.withColumns({f"__i{i}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for i, v in enumerate(values)})
    same = F.col("__pid") == F.col("__opid")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return summed.join(offs, same).select(
        *df.columns, *[(F.col(f"__i{i}") + F.col(f"__o{i}")).alias(out) for i, out in enumerate(values.values())])
