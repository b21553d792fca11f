"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Components become ``floor(scale * x)``; nearness is the integer inner product.
Candidates are sorted by label and, inside it, along a Hilbert curve over all
dimensions, and written as Parquet in that order, ``FILE_ROWS`` rows to a file
folder and ``BLOCK_ROWS`` to a block. A zone map keeps the least and the greatest
value of every dimension, and of the label, for each block. From these interval
arithmetic bounds the score of an anchor with any row of the block: a positive
component of the anchor takes the greatest value for the upper bound and the
least for the lower one, a negative component the other way round.

A search has windows of scores for each anchor: one without limits for its
positives (rows of its label), then one for each positive among the rows of
other labels. First the ``SEEDS`` blocks that promise most to a window are read;
the k-th score found there is a floor for the window. Then every block is
read that may hold the wanted labels and whose bounds meet the window above
that floor. No other block can change the result, so the search is exact. How
many blocks are left out depends on the data: clusters are told apart, while
vectors without any order need nearly all blocks.

Anchors and files meet in groups of bounded size (``FILE_ROWS`` rows,
``ANCHOR_ROWS`` anchors), and only file folders that an anchor asks for are joined. Bounds
are computed for groups of zones, and only those of chosen blocks leave them.

Cases: rows with a null id, label or vector, or with a null or non-finite
component take no part; vectors of unequal length are padded with zeros; an
anchor repeated under one id is searched once, by its smallest vector (then label); rows
with the anchor's id are no candidates, other repeated rows count each; ties
go to the smaller id; an anchor without positives, and a positive with an empty
window, has no rows; an empty table gives an empty result; extra columns are
ignored. Where scores could pass 62 bits OverflowError is raised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import query, read, stage
from quarry.llm.vectors import matrix, usable, widen
from quarry.operators.ranking import ordered_rank
from quarry.session import scratch_path
from quarry.sinks.tables import overwrite

POSITIVES, NEGATIVES = 5, 10          # production parameters
LOW, HIGH = 30, 90                    # percent of the positive's score
BLOCK_ROWS, FILE_ROWS = 512, 8192
ANCHOR_ROWS = 2048                    # anchors of a group
ZONE_FILES = 64                       # files whose zones meet anchors in one group
SEEDS = 2                             # blocks read first for each window
BITS = 2                              # of each dimension on the curve
STEP = 128                            # anchors scored at once
_LEAST, _MOST = -(1 << 62), 1 << 62


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place on the Hilbert curve of each row of cell numbers (below
    ``2**bits``), as bytes in sort order: the cells' coordinates are turned, bit
    plane by bit plane, into those of the curve's own frame (reflections and
    exchanges with the first axis), Gray-decoded and interleaved."""
    x = cells.astype(np.int64).copy()
    rows, dims = x.shape
    plane = 1 << (bits - 1)
    while plane > 1:
        below = plane - 1
        for d in range(dims):
            flip = (x[:, d] & plane) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, d]) & below)
            x[:, 0] ^= np.where(flip, below, swap)
            x[:, d] ^= swap
        plane >>= 1
    x = np.bitwise_xor.accumulate(x, axis=1)
    turn, plane = np.zeros(rows, np.int64), 1 << (bits - 1)
    while plane > 1:
        turn ^= np.where(x[:, -1] & plane, plane - 1, 0)
        plane >>= 1
    x ^= turn[:, None]
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)
    return [r.tobytes() for r in packed]


def _extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest value of each dimension of a batch (a missing
    component is 0)."""
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column("vec"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(x.shape[1]), pa.int32()), pa.array(x.min(0)), pa.array(x.max(0)),
                 pa.array(np.full(x.shape[1], batch.num_rows))], names=["dim", "lo", "hi", "n"])


def _keyed(lo: np.ndarray, hi: np.ndarray):
    span = np.where(hi > lo, hi - lo, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = widen(matrix(batch.column("vec")), len(lo))
            cells = np.clip(np.floor((x - lo) / span * (1 << BITS)), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("vec"),
                 pa.array(hilbert_keys(cells, BITS), pa.binary())], names=["id", "label", "vec", "key"])

    return run


def _zones(dims: int):
    """A row for each block of a batch: its labels' and dimensions' ranges. A
    block cut by a batch has a row for each part; either part may ask for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            x = widen(matrix(batch.column("vec")), dims)[order]
            label = batch.column("label").to_numpy()[order]
            block, file = block[order], batch.column("file").to_numpy()[order]
            at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(file[at].astype(np.int64)), pa.array(block[at]), pa.array(np.minimum.reduceat(label, at)),
                 pa.array(np.maximum.reduceat(label, at)), pa.array(list(np.minimum.reduceat(x, at))),
                 pa.array(list(np.maximum.reduceat(x, at)))],
                names=["file", "block", "label_lo", "label_hi", "lo", "hi"])

    return run


def score_bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of each anchor with any vector of each
    box. Sums above 2**53 are widened by more than their rounding."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    least, most = plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T
    largest = np.abs(anchors) @ np.maximum(np.abs(lo), np.abs(hi)).T
    slack = np.where(largest < 2.0 ** 53, 0.0, largest * 2.0 ** -52 * (anchors.shape[1] + 2))
    return least - slack, most + slack


def _choose(dims: int, same: bool, seeds: int | None):
    """Chosen (id, win, file, block, promise, least) of a group of zones and a
    group of anchors: with ``seeds`` the most promising blocks of each window,
    without it (win -1) all blocks that may change a window's result."""

    def run(table: pa.Table) -> pa.Table:
        is_anchor = table["is_anchor"].to_numpy()
        zones, asks = table.filter(pa.array(~is_anchor)), table.filter(pa.array(is_anchor))
        out = []
        if zones.num_rows and asks.num_rows:
            file, block = zones["file"].to_numpy(), zones["block"].to_numpy()
            first, last = zones["label_lo"].to_numpy(), zones["label_hi"].to_numpy()
            lo, hi = widen(matrix(zones["lo"]), dims), widen(matrix(zones["hi"]), dims)
            ids, label = asks["id"].to_numpy(), asks["label"].to_numpy()
            for at in range(0, len(ids), STEP):
                part = slice(at, at + STEP)
                mine = label[part, None]
                fits = (first <= mine) & (mine <= last) if same else (first != mine) | (last != mine)
                least, most = score_bounds(widen(matrix(asks["vec"].slice(at, STEP)), dims), lo, hi)
                lows, tops = asks["lows"].slice(at, STEP).to_pylist(), asks["tops"].slice(at, STEP).to_pylist()
                for i, (low, top) in enumerate(zip(lows, tops)):
                    wanted = np.zeros(len(block), bool)
                    for w, (a, b) in enumerate(zip(low, top)):
                        meets = fits[i] & (most[i] >= a) & (least[i] <= b)
                        if seeds is None:
                            wanted |= meets
                            continue
                        z = np.flatnonzero(meets)
                        promise = np.minimum(most[i, z], b)
                        best = np.lexsort((block[z], -least[i, z], -promise))[:seeds]
                        z, promise = z[best], promise[best]
                        out.append((np.full(len(z), ids[at + i]), np.full(len(z), w), file[z], block[z], promise, least[i, z]))
                    if seeds is None:
                        z = np.flatnonzero(wanted)
                        out.append((np.full(len(z), ids[at + i]), np.full(len(z), -1), file[z], block[z], most[i, z], least[i, z]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0)] * 6
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, types)],
                        names=["id", "win", "file", "block", "promise", "least"])

    return run


def _inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products (below 2**62, see ``prepare``)."""
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 2.0 ** 53:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def _score(dims: int, same: bool, k: int):
    """The first k rows of each window among the blocks that the anchor asks for."""

    def run(table: pa.Table) -> pa.Table:
        is_anchor = table["is_anchor"].to_numpy()
        rows, asks = table.filter(pa.array(~is_anchor)), table.filter(pa.array(is_anchor))
        out = []
        if rows.num_rows and asks.num_rows:
            order = np.argsort(rows["id"].to_numpy(), kind="stable")
            rows = rows.take(pa.array(order))
            ids, label, block = (rows[c].to_numpy() for c in ("id", "label", "block"))
            x = widen(matrix(rows["vec"]), dims)
            who, mine = asks["id"].to_numpy(), asks["label"].to_numpy()
            for at in range(0, len(who), STEP):
                wanted = asks["blocks"].slice(at, STEP).to_pylist()
                read_rows = np.flatnonzero(np.isin(block, np.unique(np.concatenate(wanted))))
                scores = _inner(widen(matrix(asks["vec"].slice(at, STEP)), dims), x[read_rows])
                lows, tops = asks["lows"].slice(at, STEP).to_pylist(), asks["tops"].slice(at, STEP).to_pylist()
                for i in range(len(wanted)):
                    own = (label[read_rows] == mine[at + i]) == same
                    own &= (ids[read_rows] != who[at + i]) & np.isin(block[read_rows], wanted[i])
                    pool = np.flatnonzero(own)
                    s = scores[i, pool]
                    for w, (a, b) in enumerate(zip(lows[i], tops[i])):
                        z = np.flatnonzero((s >= a) & (s <= b))
                        if len(z) > k:
                            z = z[s[z] >= np.partition(s[z], -k)[-k]]
                            z = z[np.argsort(-s[z], kind="stable")[:k]]        # ids ascend
                        out.append((np.full(len(z), who[at + i]), np.full(len(z), w), ids[read_rows[pool[z]]], s[z]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0)] * 4
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, types)],
                        names=["id", "win", "found", "score"])

    return run


class Blocks:
    """The candidates in Hilbert-ordered blocks, with their zone maps."""

    def __init__(self, rows: DataFrame):
        """``rows``: (id, label, vec), staged."""
        spark = rows.sparkSession
        found = rows.select("vec").mapInArrow(_extents, "dim int, lo double, hi double, n bigint") \
            .groupBy("dim").agg(F.min("lo"), F.max("hi"), F.sum("n")).orderBy("dim").collect()    # a row per dimension
        self.dims = max(len(found), 1)
        self.rows = found[0][3] if found else 0
        short = [r[3] < self.rows for r in found]          # padded with zeros somewhere
        lo = np.array([min(r[1], 0.0) if s else r[1] for r, s in zip(found, short)])
        hi = np.array([max(r[2], 0.0) if s else r[2] for r, s in zip(found, short)])
        if float((np.maximum(np.abs(lo), np.abs(hi)) ** 2).sum()) >= 2.0 ** 62:
            raise OverflowError("a score may exceed 62 bits")
        if not self.rows:
            return
        keyed = rows.select("id", "label", "vec").mapInArrow(
            _keyed(lo, hi), "id bigint, label bigint, vec array<double>, key binary")
        placed = ordered_rank(keyed, [], ["label", "key", "id"], out="place").select(
            "id", "label", "vec", F.floor(F.col("place") / BLOCK_ROWS).cast("bigint").alias("block"),
            F.floor(F.col("place") / FILE_ROWS).cast("bigint").alias("file"))
        path = scratch_path(spark, "hilbert-blocks")
        overwrite(placed, path, partition_by=["file"])
        self.table = spark.read.schema("id bigint, label bigint, vec array<double>, block bigint, file bigint").parquet(path)
        self.zones = stage(self.table.mapInArrow(
            _zones(self.dims), "file bigint, block bigint, label_lo bigint, label_hi bigint, lo array<double>, hi array<double>"),
            "zone-maps")
        self.zone_groups = -(-self.rows // (FILE_ROWS * ZONE_FILES))

    def choose(self, anchors: DataFrame, same: bool, seeds: int | None) -> DataFrame:
        """(id, chunk, file, blocks) that the anchors (id, label, vec, chunk,
        lows, tops) have to read."""
        none = F.lit(None)
        zones = self.zones.select(
            F.floor(F.col("file") / ZONE_FILES).cast("int").alias("zone_group"),
            F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1))).alias("chunk"), "file", "block", "label_lo", "label_hi",
            "lo", "hi", none.cast("bigint").alias("id"), none.cast("bigint").alias("label"),
            none.cast("array<double>").alias("vec"), none.cast("array<bigint>").alias("lows"),
            none.cast("array<bigint>").alias("tops"), F.lit(False).alias("is_anchor"))
        asks = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(self.zone_groups - 1))).alias("zone_group"), "chunk",
                              "id", "label", "vec", "lows", "tops", F.lit(True).alias("is_anchor"))
        chosen = zones.unionByName(asks, allowMissingColumns=True).groupBy("zone_group", "chunk").applyInArrow(
            _choose(self.dims, same, seeds), "id bigint, win int, file bigint, block bigint, promise double, least double")
        if seeds is not None:
            first = Window.partitionBy("id", "win").orderBy(F.desc("promise"), F.desc("least"), "block")
            chosen = chosen.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= seeds)
        return chosen.groupBy("id", "file").agg(F.collect_set("block").alias("blocks")) \
            .withColumn("chunk", self.chunk_of(F.col("id")))         # a file has FILE_ROWS / BLOCK_ROWS blocks

    def chunk_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.chunks)).cast("int")

    def read(self, anchors: DataFrame, chosen: DataFrame, same: bool, k: int) -> DataFrame:
        """(id, win, found, score): the first k of each window in the chosen
        blocks, and some later ones."""
        none = F.lit(None)
        asked = chosen.select("file", "chunk").distinct()
        rows = self.table.join(asked, "file").select(
            "file", "chunk", "id", "label", "vec", "block", none.cast("array<bigint>").alias("blocks"),
            none.cast("array<bigint>").alias("lows"), none.cast("array<bigint>").alias("tops"), F.lit(False).alias("is_anchor"))
        asks = chosen.join(anchors.drop("chunk"), "id").select(
            "file", "chunk", "id", "label", "vec", none.cast("bigint").alias("block"), "blocks", "lows", "tops",
            F.lit(True).alias("is_anchor"))
        return rows.unionByName(asks).groupBy("file", "chunk").applyInArrow(
            _score(self.dims, same, k), "id bigint, win int, found bigint, score bigint")

    def search(self, anchors: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """(id, win, rank, found, score): the first k rows of each window of
        ``anchors`` (id, label, vec, lows, tops), of the anchor's label or not."""
        self.chunks = -(-max(anchors.count(), 1) // ANCHOR_ROWS)
        anchors = stage(anchors.withColumn("chunk", self.chunk_of(F.col("id"))), f"{name}-anchors")
        seeds = stage(self.choose(anchors, same, SEEDS), f"{name}-seeds")
        # the k-th score met so far is a floor for what is still to be found
        order = Window.partitionBy("id", "win").orderBy(F.desc("score"))
        floors = self.read(anchors, seeds, same, k).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") == k)
        floors = floors.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("win", "score"))).alias("floor"))
        low = F.transform("lows", lambda a, w: F.greatest(a, F.coalesce(F.try_element_at("floor", w), a)))
        raised = stage(anchors.join(floors, "id", "left").withColumn("lows", low).drop("floor"), f"{name}-floors")
        chosen = stage(self.choose(raised, same, None), f"{name}-blocks")
        found = self.read(raised, chosen, same, k)
        rank = Window.partitionBy("id", "win").orderBy(F.desc("score"), "found")
        return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def _share(percent: int, up: bool) -> Column:
    """``percent`` % of the score, rounded up or down."""
    x = F.expr(f"CAST({percent} AS DECIMAL(4, 0)) * CAST(score AS DECIMAL(20, 0))")
    x = -x if up else x
    part = ((x - F.pmod(x, F.lit(100))) / 100).cast("bigint")
    return -part if up else part


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         scale: float = 256.0) -> DataFrame:
    """Hard negatives of each anchor and positive, see ``RESULT``. ``label``
    (default: the column of that name) must be an integer."""
    label = F.col("label") if label is None else label
    rows = df.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull() & label.isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
        F.transform(F.col(vec_col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = stage(rows, "mining-rows")
    blocks = Blocks(rows)
    if not blocks.rows:
        return df.sparkSession.createDataFrame([], RESULT)
    anchors = rows.filter("asks").groupBy("id").agg(F.min(F.struct("vec", "label")).alias("a")).select("id", "a.label", "a.vec")
    # stands for no limit: scores are below 2**62
    limits = lambda x: F.array(F.lit(x).cast("bigint"))
    near = blocks.search(anchors.withColumns({"lows": limits(_LEAST), "tops": limits(_MOST)}), True, positives, "positives")
    near = stage(near.select("id", (F.col("rank") - 1).alias("win"), F.col("found").alias("positive_id"),
                             F.col("score").alias("positive_score"),
                             _share(low, True).alias("low"), _share(high, False).alias("top")), "positives")
    windows = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("win", "low", "top"))).alias("w"))
    asking = anchors.join(windows, "id").select("id", "label", "vec", F.col("w.low").alias("lows"), F.col("w.top").alias("tops"))
    hard = blocks.search(asking, False, negatives, "negatives")
    return hard.join(near, ["id", "win"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


@query("op11_zone_mapped_negatives", oracle=f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(embedding) = len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)])),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
             list_sum([a.e[i] * c.e[i] FOR i IN range(1, len(c.e) + 1)])::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= {NEGATIVES}
""")
def op11_zone_mapped_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)
