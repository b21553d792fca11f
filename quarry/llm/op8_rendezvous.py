"""Sharding by rendezvous hashing over weighted shards.

Every record scores every shard from a hash of its stable key and the
shard's number alone, ``weight / -ln(u)`` with ``u`` uniform in (0, 1), and
goes to the highest score (ties to the smaller shard). Scores of old shards
do not change when one is added, so a record either stays or moves into the
new shard; shard sizes follow the weights.

Positions inside a shard are gapless and need no task that holds a shard:
records fall into hash buckets, rows are numbered inside (shard, bucket),
and the counts of the buckets before are added.

Cases: a null key is a key of its own (its rows share a shard, and spread over
its buckets by size and CRC); equal keys share a shard; rows equal in doc_id, size and
CRC have slots next to each other; a null or empty text has size 16 and CRC 0; an empty
table gives an empty result; extra columns are ignored by the query and kept
by ``assign``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import free_name, query, read

SHARDS = 40              # production parameters of the query
OVERHEAD = 16            # bytes of a record besides its text
BUCKETS = 1024           # hash buckets of a shard for numbering
RUN = 1 << 16            # equal rows put out by a task at once


def score(key: Column, shard: int, weight: float) -> Column:
    """The record's score for one shard."""
    h = F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), key.isNull(), F.lit(shard))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0 ** -53)
    return F.lit(-float(weight)) / F.log(u)


def pick(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a record: weights[i] is the weight of shard i, and 0
    takes a shard out of service."""
    scored = [F.struct(score(key, i, w).alias("s"), F.lit(-i).alias("i"))
              for i, w in enumerate(weights) if w > 0]
    if not scored:
        raise ValueError("no shard has a weight")
    best = scored[0] if len(scored) == 1 else F.greatest(*scored)
    return (-best["i"]).cast("int")


def assign(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """Add ``out``: the shard of each row."""
    return df.withColumn(out, pick(F.col(f"`{key}`"), weights))


def number_rows(df: DataFrame, group: str, order: Sequence[str], out: str, buckets: int = BUCKETS,
                run: int = RUN) -> DataFrame:
    """Add ``out``: a gapless 0-based number of the row inside its group, by
    hash bucket and then by ``order`` (values that tell different rows apart).

    Rows that are equal in all columns are counted before anything is
    shuffled, numbered as one row, and put out again in runs of ``run`` rows
    dealt over the tasks: no number of equal rows meets in one task."""
    names = [c for c in df.columns if c != out]
    b, base, n, g2, b2, at = (free_name([*df.columns, out], x) for x in ("bucket", "base", "n", "group", "part", "at"))
    numbered = df.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias(n)) \
        .withColumn(b, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = (numbered.groupBy(group, b).agg(F.sum(n).alias(n))
             .select(F.col(group).alias(g2), F.col(b).alias(b2),
                     F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base)))
    inside = Window.partitionBy(group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = numbered.withColumn(at, F.coalesce(F.sum(n).over(inside), F.lit(0)))
    placed = ranked.join(bases, F.col(group).eqNullSafe(F.col(g2)) & (F.col(b) == F.col(b2))) \
        .withColumn(at, F.col(at) + F.col(base))
    kept = [F.col(f"`{c}`") for c in names]
    single = placed.filter(F.col(n) == 1).select(*kept, F.col(at).cast("bigint").alias(out))
    last = F.floor((F.col(n) - 1) / F.lit(run)).cast("bigint")
    runs = placed.filter(F.col(n) > 1).select(*kept, n, at, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias(b))
    first = F.col(b) * run
    runs = runs.select(*kept, (F.col(at) + first).alias(at), F.least(F.lit(run), F.col(n) - first).alias(n)).repartition(at)
    several = runs.select(*kept, F.explode(F.sequence(F.col(at), F.col(at) + F.col(n) - 1)).alias(out)) \
        .withColumn(out, F.col(out).cast("bigint"))
    return single.unionByName(several)


def shard_documents(docs: DataFrame, shards: int, weights: Sequence[float] | None = None) -> DataFrame:
    """Per document its size, CRC, shard, slot, and its shard with one more
    shard of weight 1."""
    weights = list(weights or [1.0] * shards)
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    rows = rows.select("*", F.lit("key").alias("law"),
                       pick(F.col("doc_id"), weights).alias("shard"),
                       pick(F.col("doc_id"), [*weights, 1.0]).alias("grown_shard"))
    return number_rows(rows, "shard", ["doc_id", "size", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op8_rendezvous_sharding")
def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), SHARDS)
