"""Approximate nearest neighbours by cross-polytope hashing.

Each of several tables rotates unit vectors by fast Hadamard pseudo-rotations
(three rounds of random signs and a Walsh-Hadamard transform) and hashes a
vector to the nearest signed axis of each rotation. A table takes as many
rotations as leave about a quarter of a row for a bucket (``rotations_for``),
so buckets become finer as rows become more. Every candidate is stored in one
bucket of each table; a query probes, in each table, the buckets that lose
least: the margin of an axis is how far the query's coordinate there falls
short of its longest one, and combinations of axes are probed in order of the
sum of squared margins. All members of a probed bucket are candidates and are
reranked by the exact cosine.

Members and queries meet by table and first axis, in blocks of bounded size, so
a hot bucket is split over many tasks; a query brings the list of buckets it
probes there, and a block returns no more than k rows a query. The only thing
broadcast is the number of rows of each first axis, ``tables * 2 * dimension``
rows at most.

A query that finds fewer than k candidates is searched again in every bucket
of the first table, that is among all rows.

Cases: vectors that are null, zero (or empty) or hold null or non-finite
components, and rows with a null id, take no part; shorter vectors are padded
with zeros up to ``dim``, the length of the longest; a query repeated under one
id is searched once, by the smallest of its vectors; rows with the query's id
are no candidates, other repeated rows count each; ties go to the smaller id; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import query, read, stage
from quarry.llm.vectors import blocks_of, matrix, spread, usable, widen

TABLES = 8                # production parameters
PROBES = (20, 400, 4800)  # of a table with one, two and three rotations
ROWS_A_BUCKET = 0.25      # at least, on average
CANDIDATE_ROWS = 8192     # of a block
QUERY_ROWS = 2048
PAIRS = 50_000            # reranked at once
SEED = 20240311


def rotations_for(rows: int, width: int) -> int:
    """Rotations of a table: the most for which its ``(2 * width) ** r``
    buckets hold ``ROWS_A_BUCKET`` rows on average."""
    r = 1
    while r < len(PROBES) and (2 * width) ** (r + 1) * ROWS_A_BUCKET <= rows:
        r += 1
    return r


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    """The pseudo-rotation of that number; the rows' length is a power of 2."""
    rng = np.random.Generator(np.random.PCG64([SEED, number]))
    n = x.shape[1]
    for _ in range(3):
        x = x * rng.choice(np.array([-1.0, 1.0]), n)
        h = 1
        while h < n:
            p = x.reshape(-1, n // (2 * h), 2, h)
            x = np.stack([p[:, :, 0] + p[:, :, 1], p[:, :, 0] - p[:, :, 1]], axis=2).reshape(-1, n)
            h *= 2
        x = x / np.sqrt(n)
    return x


def signed_axes(unit: np.ndarray, number: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest signed axes of each row, nearest first (axis * 2, plus 1
    on the negative side), and their margins."""
    y = rotate(unit, number)
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    near = np.argsort(-both, axis=1, kind="stable")[:, :axes]
    along = np.take_along_axis(both, near, axis=1)
    return near, along[:, :1] - along


def probe_order(unit: np.ndarray, table: int, rotations: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(first axes, codes of the others) of the buckets of a table that each
    row probes, least loss first."""
    sides = 2 * unit.shape[1]
    found = [signed_axes(unit, table * rotations + r, min(sides, probes)) for r in range(rotations)]
    first, loss = found[0][0], found[0][1] ** 2
    rest = np.zeros_like(first)
    for axes, margins in found[1:]:
        # a combination of places i and j comes after i * j others at least
        i, j = np.nonzero(np.outer(np.arange(1, loss.shape[1] + 1), np.arange(1, axes.shape[1] + 1)) <= probes)
        loss = loss[:, i] + (margins ** 2)[:, j]
        first, rest = first[:, i], rest[:, i] * sides + axes[:, j]
        keep = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        loss, first, rest = (np.take_along_axis(a, keep, axis=1) for a in (loss, first, rest))
    return first[:, :probes], rest[:, :probes]


def _units(vec: pa.Array, width: int) -> np.ndarray:
    x = widen(matrix(vec), width)
    x = x / np.abs(x).max(axis=1, keepdims=True)      # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash(width: int, tables: int, rotations: int):
    """Candidates (id, row, vec) to rows (id, row, vec, table_no, axis, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _units(batch.column("vec"), width)
            for table in range(tables):
                axis, code = probe_order(unit, table, rotations, 1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(["id", "row", "vec"]).columns, pa.array(np.full(len(axis), table), pa.int32()),
                     pa.array(axis[:, 0], pa.int32()), pa.array(code[:, 0], pa.int32())],
                    names=["id", "row", "vec", "table_no", "axis", "code"])

    return run


def _probe(width: int, tables: int, rotations: int, probes: int):
    """Queries (id, vec) to a row for each table and first axis that they
    probe: (id, vec, table_no, axis, codes)."""

    step = max(1, (1 << 22) // (2 * width * probes))         # queries at once: their combinations fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                unit = _units(part.column("vec"), width)
                for table in range(tables):
                    axis, code = probe_order(unit, table, rotations, probes)
                    who = np.repeat(np.arange(len(unit)), axis.shape[1])
                    order = np.lexsort((code.ravel(), axis.ravel(), who))
                    who, axes, codes = who[order], axis.ravel()[order], code.ravel()[order]
                    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (axes[1:] != axes[:-1])]))
                    rows = part.take(pa.array(who[first]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(who)), pa.int32()), pa.array(codes, pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("id"), rows.column("vec"), pa.array(np.full(len(first), table), pa.int32()),
                         pa.array(axes[first], pa.int32()), lists], names=["id", "vec", "table_no", "axis", "codes"])

    return run


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of row pairs in double precision; equal vectors give equal results."""
    scale_q, scale_c = np.abs(q).max(axis=1, keepdims=True), np.abs(c).max(axis=1, keepdims=True)
    q, c = q / scale_q, c / scale_c
    return (q * c).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((c * c).sum(axis=1)))


def _rerank(k: int):
    """The k nearest members of the probed buckets for each query of the
    block, by exact cosine."""

    def run(table: pa.Table) -> pa.Table:
        is_query = table["is_query"].to_numpy()
        c, q = table.filter(pa.array(~is_query)), table.filter(pa.array(is_query))
        out = []
        if q.num_rows and c.num_rows:
            c = c.take(pa.array(np.argsort(c["code"].to_numpy(), kind="stable")))     # a bucket's members side by side
            ids, rows, code, qid = (t[x].to_numpy() for t, x in ((c, "id"), (c, "row"), (c, "code"), (q, "id")))
            width = max(matrix(c["vec"]).shape[1], matrix(q["vec"]).shape[1])
            cv, qv = widen(matrix(c["vec"]), width), widen(matrix(q["vec"]), width)
            probed = q["codes"].combine_chunks()
            starts, codes = probed.offsets.to_numpy(), probed.values.to_numpy()
            lo, hi = np.searchsorted(code, codes, "left"), np.searchsorted(code, codes, "right")
            unit = lambda a: (b := a / np.abs(a).max(axis=1, keepdims=True)) / np.linalg.norm(b, axis=1, keepdims=True)
            cu, qu = unit(cv), unit(qv)
            met = np.concatenate([[0], np.cumsum(hi - lo)])[starts]       # pairs before each query
            at = 0
            while at < len(qid):
                end = max(int(np.searchsorted(met, met[at] + PAIRS, "right")) - 1, at + 1)
                a, b = lo[starts[at]:starts[end]], hi[starts[at]:starts[end]]
                sizes = b - a
                which = np.repeat(a - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                who = np.repeat(np.arange(at, end), np.diff(met[at:end + 1]))
                other = ids[which] != qid[who]
                who, which = who[other], which[other]
                about = np.einsum("ij,ij->i", qu[who], cu[which])
                order = np.lexsort((-about, who))
                first = np.searchsorted(who[order], np.arange(at, end))
                kth = np.minimum(first + k, np.searchsorted(who[order], np.arange(at, end), "right")) - 1
                least = np.full(end - at, -9.0)
                some = kth >= first
                least[some] = about[order][kth[some]]
                near = about >= least[who - at] - 1e-9                     # the k nearest and near ties
                who, which = who[near], which[near]
                exact = cosines(qv[who], cv[which])
                order = np.lexsort((rows[which], ids[which], -exact, who))
                who, which, exact = who[order], which[order], exact[order]
                keep = np.arange(len(who)) - np.searchsorted(who, who) < k
                out.append((qid[who[keep]], rows[which[keep]], ids[which[keep]], exact[keep]))
                at = end
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0)] * 4
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "row": pa.array(cols[1].astype(np.int64)),
                         "vec_id": pa.array(cols[2].astype(np.int64)), "score": pa.array(cols[3], pa.float64())})

    return run


def _found(candidates: DataFrame, queries: DataFrame, width: int, tables: int, rotations: int, probes: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): each query's k nearest in the probed buckets."""
    key = ["table_no", "axis"]
    vec = candidates.schema["vec"].dataType.simpleString()
    members = candidates.mapInArrow(_hash(width, tables, rotations),
                                    f"id bigint, row bigint, vec {vec}, table_no int, axis int, code int")
    asked = queries.mapInArrow(_probe(width, tables, rotations, probes), f"id bigint, vec {vec}, table_no int, axis int, codes array<int>")
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).join(
        asked.groupBy(*key).agg(F.count(F.lit(1)).alias("asked")), key).select(
        *key, blocks_of(F.col("members"), CANDIDATE_ROWS).alias("blocks"),
        blocks_of(F.col("asked"), QUERY_ROWS).alias("query_blocks"))
    sizes = F.broadcast(stage(sizes, "ann-sizes"))          # tables * 2 * width rows at most
    none = F.lit(None)
    met = spread(members.join(sizes, key), "row", F.col("blocks"), F.col("query_blocks"), "block", "query_block").select(
        *key, "block", "query_block", "id", "row", "vec", "code", none.cast("array<int>").alias("codes"), F.lit(False).alias("is_query"))
    met = met.unionByName(
        spread(asked.join(sizes, key), "id", F.col("query_blocks"), F.col("blocks"), "query_block", "block").select(
            *key, "block", "query_block", "id", none.cast("bigint").alias("row"), "vec", none.cast("int").alias("code"), "codes",
            F.lit(True).alias("is_query")))
    best = met.groupBy(*key, "block", "query_block").applyInArrow(
        _rerank(k), "query_id bigint, row bigint, vec_id bigint, score double")
    # a row met in several tables counts once; rows repeated under one id count each
    best = best.groupBy("query_id", "row").agg(F.max("vec_id").alias("vec_id"), F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    return best.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def nearest(df: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
            tables: int = TABLES, probes: int | None = None, rotations: int | None = None) -> DataFrame:
    """Each query's k nearest rows by cosine: query_id, rank, vec_id, score.
    ``is_query`` marks the rows of ``df`` that are queries. The rotations of a
    table follow from the number of rows, the probes from the rotations."""
    vec = F.col(vec_col)
    # float components stay float on the way, half as long; all arithmetic is in double
    kind = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.filter(usable(vec) & F.col(id_col).isNotNull() & F.exists(vec, lambda x: x != 0)).select(
        F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), vec.cast(kind).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stage(rows, "ann-rows")
    candidates = rows.select("id", "row", "vec")
    queries = rows.filter("asks").groupBy("id").agg(F.min("vec").alias("vec"))
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    width = 1 << max((longest or 1) - 1, 0).bit_length()
    rotations = rotations or rotations_for(n, width)
    out = ["query_id", "rank", "vec_id", "score"]
    probes = min(probes or PROBES[rotations - 1], (2 * width) ** rotations)
    found = stage(_found(candidates, queries, width, tables, rotations, probes, k).select(out), "ann-found")
    short = queries.join(found.filter(F.col("rank") == k), F.col("id") == F.col("query_id"), "left_anti")
    if short.isEmpty():
        return found
    short = stage(short, "ann-short")
    rest = _found(candidates, short, width, 1, 1, 2 * width, k).select(out)
    return found.join(short, F.col("id") == F.col("query_id"), "left_anti").unionByName(rest)


@query("op2_cross_polytope_ann")
def op2_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)
