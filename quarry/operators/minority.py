"""Synthetic minority rows (M3, D15's alternative to class weights).

Each class below the largest one is filled up with rows between a member and
one of its ``k`` nearest members. Neighbours are exact: the rows of a class are
dealt into blocks, and blocks meet in a grid of groups of bounded size, each
of which returns ``k`` rows for a row at most. Which neighbour, and how far
towards it, follow from hashes of the row's key, so reruns give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ranking import ordered_rank
from quarry.sinks.tables import materialize

BLOCK_ROWS = 2048
NEIGHBOURS = 5


def _nearest(k: int):
    def run(table):
        import numpy as np
        import pyarrow as pa
        asks = table["asks"].to_numpy()
        q, c = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        out = [[], [], []]
        if q.num_rows and c.num_rows:
            c = c.take(pa.array(np.argsort(c["n"].to_numpy())))
            x, y = (np.array(t["x"].to_pylist(), np.float64).reshape(t.num_rows, -1) for t in (q, c))
            me, other = q["n"].to_numpy(), c["n"].to_numpy()
            for i in range(len(me)):
                d = ((y - x[i]) ** 2).sum(axis=1)
                d[other == me[i]] = np.inf
                best = np.argsort(d, kind="stable")[:k]                    # numbers ascend
                best = best[np.isfinite(d[best])]
                out[0].append(np.full(len(best), me[i]))
                out[1].append(other[best])
                out[2].append(d[best])
        columns = [np.concatenate(o) if o else np.empty(0) for o in out]
        return pa.table({"n": pa.array(columns[0].astype(np.int64)), "other": pa.array(columns[1].astype(np.int64)),
                         "distance": pa.array(columns[2].astype(np.float64))})

    return run


def nearest_of_class(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(n, other, distance, place): the ``k`` nearest other rows of the same
    class by squared distance, ties by ``n``. ``rows``: (cls, n, x) with
    numbers ``n`` that tell the rows apart."""
    sizes = materialize(rows.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks")), "class-blocks")
    dealt = rows.join(sizes.withColumnRenamed("cls", "__cls"), F.col("cls").eqNullSafe(F.col("__cls"))) \
        .withColumn("own", F.pmod(F.xxhash64("n"), "blocks").cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    grid = dealt.select("cls", F.col("own").alias("a"), others.alias("b"), "n", "x", F.lit(True).alias("asks")).unionByName(
        dealt.select("cls", others.alias("a"), F.col("own").alias("b"), "n", "x", F.lit(False).alias("asks")))
    found = grid.groupBy("cls", "a", "b").applyInArrow(_nearest(k), "n bigint, other bigint, distance double")
    order = Window.partitionBy("n").orderBy("distance", "other")            # k rows of each block
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _share(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0 ** -53)


def synthetic_minority(df: DataFrame, key: str, label: str, features: Sequence[str], k: int = NEIGHBOURS,
                       seed: int = 123) -> DataFrame:
    """M3: ``(label, …features, is_synthetic)`` of all labelled rows of ``df``
    and of as many synthetic rows as bring every class to the size of the
    largest. A missing feature is 0, as in the models. A class of a single row
    is filled with its copies. Rows are told apart by ``key``; rows with the same key
    and features are interchangeable."""
    values = [F.coalesce(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features]
    rows = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("cls"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
                                                      F.array(*values).alias("x"))
    hashed = rows.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), "key")))
    ranked = ordered_rank(hashed, ["cls"], ["h", "key", "x"], out="rank", total="size")
    ranked = materialize(ranked.withColumn("n", F.monotonically_increasing_id()).drop("h"), "minority-rows")
    largest = ranked.agg(F.max("size")).first()[0] or 0
    minority = ranked.filter(F.col("size") < largest)
    need = F.lit(largest) - F.col("size")
    copies = (F.floor(need / F.col("size")) + (F.col("rank") < F.pmod(need, F.col("size"))).cast("int")).cast("int")
    near = nearest_of_class(minority.select("cls", "n", "x"), k)
    near = near.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("place", "other"))).alias("near"))     # k at most
    asked = minority.select("cls", "key", "x", "rank", "n", copies.alias("copies")).filter("copies > 0") \
        .join(near.withColumnRenamed("n", "__n"), F.col("n") == F.col("__n"), "left") \
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    nth = F.floor(_share(F.col("key"), F.col("rank"), F.col("copy"), F.lit(seed)) * F.size("near")).cast("int")
    picked = asked.withColumn("to", F.when(F.size("near") > 0, F.get("near", nth)["other"]))
    target = minority.select(F.col("n").alias("__to"), F.col("x").alias("y"))
    gap = _share(F.col("key"), F.col("rank"), F.col("copy"), F.lit(seed + 1))
    between = F.when(F.col("y").isNull(), F.col("x")).otherwise(F.zip_with("x", "y", lambda a, b: a + F.col("gap") * (b - a)))
    made = picked.join(target, F.col("to") == F.col("__to"), "left").withColumn("gap", gap) \
        .select("cls", between.alias("x"), F.lit(True).alias("is_synthetic"))
    both = ranked.select("cls", "x", F.lit(False).alias("is_synthetic")).unionByName(made)
    return both.select(F.col("cls").alias(label), *[F.col("x")[i].alias(f) for i, f in enumerate(features)], "is_synthetic")
