"""Exact top-k search by distributed histogram selection.

Components become ``floor(scale * x)``; the score of a query and a candidate
is their integer inner product. Every round scores all candidates in blocks
and counts scores into bins of each query's current interval; the bins are
summed over all blocks and the one holding the k-th highest score becomes the
next interval, until it holds one value: the exact k-th score. A last pass
keeps the higher scores, and of the equal ones the smallest ids.

Nothing but bins and final rows leaves a block: a block leaves out the bins
below its own k-th score, which cannot hold the k-th score overall, so it
sends at most k bins a query and round. Queries and candidates meet in a grid
of blocks of bounded size, so no group grows with the tables.

Cases: vectors null or holding null or non-finite components, and rows with
a null id, take no part; vectors of unequal length are padded with zeros; a
query repeated under one id is searched once, by the smallest of its vectors;
rows with the query's id are no candidates, other repeated rows count each;
ties go to the smaller id; an empty table gives an empty result; extra columns
are ignored. Scores beyond 64 bits raise OverflowError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import query, read, stage
from quarry.llm.vectors import blocks_of, matrix, spread, usable, widen

BINS = 1024
CANDIDATE_ROWS = 8192     # candidates of a block
QUERY_ROWS = 2048         # queries of a block
STEP = 128                # queries scored at once


def _inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, exact."""
    width = max(q.shape[1], c.shape[1])
    q, c = widen(q, width), widen(c, width)
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * width
    if bound < 2.0 ** 53:
        return (q @ c.T).astype(np.int64)
    if bound < 2.0 ** 63:
        return q.astype(np.int64) @ c.astype(np.int64).T
    raise OverflowError("a score may exceed 64 bits")


def _sides(table: pa.Table):
    is_query = table["is_query"].to_numpy()
    c, q = table.filter(pa.array(~is_query)), table.filter(pa.array(is_query))
    return q, c


def _scored(table: pa.Table, k: int):
    """(query rows, their scores, candidate ids) block by block; the query's
    own rows get the lowest number."""
    q, c = _sides(table)
    if q.num_rows == 0 or c.num_rows == 0:
        return
    ids, cv = c["id"].to_numpy(), matrix(c["vec"])
    order = np.argsort(ids, kind="stable")
    ids, cv = ids[order], cv[order]
    qv, qid = matrix(q["vec"]), q["id"].to_numpy()
    lo, hi = q["lo"].to_numpy(), q["hi"].to_numpy()
    none = np.iinfo(np.int64).min
    for at in range(0, len(qid), STEP):
        part = slice(at, at + STEP)
        s = _inner(qv[part], cv)
        s[ids[None, :] == qid[part, None]] = none
        yield qid[part], lo[part], hi[part], s, ids, none


def _histogram(k: int):
    def run(table: pa.Table) -> pa.Table:
        out = []
        for qid, lo, hi, scores, _, none in _scored(table, k):
            for i in range(len(qid)):
                s = scores[i]
                s = s[(s >= lo[i]) & (s < hi[i]) & (s != none)]
                width = -(-(int(hi[i]) - int(lo[i])) // BINS)
                bins, n = np.unique((s - lo[i]) // width, return_counts=True)
                bins, n = bins[::-1], n[::-1]
                needed = int(np.searchsorted(np.cumsum(n), k)) + 1     # up to its own k-th score
                out.append((np.full(len(bins[:needed]), qid[i]), bins[:needed], n[:needed]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3
        return pa.table({"id": pa.array(cols[0], pa.int64()), "bin": pa.array(cols[1], pa.int64()),
                         "n": pa.array(cols[2], pa.int64())})
    return run


def _select(k: int):
    def run(table: pa.Table) -> pa.Table:
        out = []
        for qid, lo, _, scores, ids, none in _scored(table, k):
            for i in range(len(qid)):
                s = scores[i]
                above = np.flatnonzero((s > lo[i]) & (s != none))
                equal = np.flatnonzero((s == lo[i]) & (s != none))[:k]      # ids ascend
                at = np.concatenate([above, equal])
                if len(at) > k:
                    at = at[np.lexsort((ids[at], -s[at]))[:k]]
                out.append((np.full(len(at), qid[i]), ids[at], s[at]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.int64())})
    return run


def top_k(df: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 256.0) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, vec_id,
    score. ``is_query`` marks the rows of ``df`` that are queries."""
    rows = df.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.transform(F.col(vec_col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    candidates = stage(rows, "topk-rows")
    queries = candidates.filter("asks").groupBy("id").agg(F.min("vec").alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, longest = candidates.agg(F.count(F.lit(1)), F.max(square)).first()
    if not n:
        longest = 0.0
    n_queries = queries.count()
    span = int(longest) + 1                  # no inner product is longer than the longest square
    if span >= 2 ** 62:
        raise OverflowError("a score may exceed 64 bits")
    own, others = (-(-max(x, 1) // size) for x, size in ((n, CANDIDATE_ROWS), (n_queries, QUERY_ROWS)))
    blocks, query_blocks = F.lit(own), F.lit(others)
    state = queries.select("id", "vec", F.lit(-span).cast("bigint").alias("lo"),
                           F.lit(span + 1).cast("bigint").alias("hi"), F.lit(0).cast("bigint").alias("above"))

    def meet(state: DataFrame, work, schema: str) -> DataFrame:
        none = F.lit(None).cast("bigint")
        left = spread(candidates.select("id", "vec", none.alias("lo"), none.alias("hi"), F.lit(False).alias("is_query")),
                      "id", blocks, query_blocks, "block", "query_block")
        right = spread(state.select("id", "vec", "lo", "hi", F.lit(True).alias("is_query")),
                       "id", query_blocks, blocks, "query_block", "block")
        return left.unionByName(right).groupBy("block", "query_block").applyInArrow(work, schema)

    width = 2 * span + 1
    while width > 1:
        state = stage(state, "topk-state")
        bins = meet(state, _histogram(k), "id bigint, bin bigint, n bigint") \
            .groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        found = state.select("id", "above").join(bins, "id") \
            .withColumn("upto", F.col("above") + F.sum("n").over(down)) \
            .filter(F.col("upto") >= k).groupBy("id") \
            .agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above")), "bin").alias("hit"))
        step = F.ceil((F.col("hi") - F.col("lo")) / F.lit(BINS))
        lo = F.col("lo") + F.col("hit.bin") * step
        # fewer than k scores in all: the interval shrinks to the lowest value, and all stay
        state = state.select("id", "vec", "lo", "hi", F.col("above").alias("was")).join(found, "id", "left").select(
            "id", "vec", F.coalesce(lo, F.col("lo")).alias("lo"),
            F.coalesce(F.least(lo + step, F.col("hi")), F.col("lo") + step).alias("hi"),
            F.coalesce("hit.above", "was").alias("above"))
        width = -(-width // BINS)
    best = meet(stage(state, "topk-kth"), _select(k), "query_id bigint, vec_id bigint, score bigint")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k) \
               .select("query_id", "rank", "vec_id", "score")


@query("op5_histogram_topk", oracle="""
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)])),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(c.e) + 1)])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op5_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)
