"""Near-duplicate documents by a MinHash LSH forest.

A document's set holds the hashes of its distinct word shingles. Documents
with equal sets form one class, so copies are never paired. Each tree of the
forest sorts the classes by its own run of the MinHash signature. Classes
that share a tree's first values form a region; a region of more than
``REGION`` classes is cut deeper, by the next values, as long as the order
has values (adaptive depth). Inside a region all classes are candidates of each
other; across the cuts, and in the deepest regions if they are still large,
each class and its next ``NEIGHBOURS`` in the order, those of the longest
common prefixes, are. Candidate pairs so grow with the number of classes,
never with the square of a group.

A large region can still hide a link: a class on the fringe of many near
copies may be similar to few of them, none of them next to it in any order.
So large regions that share classes are joined to clusters, and in each
cluster every class outside the largest component is compared with all
classes of other components, on full sets, in blocks of bounded size that
send back confirmed links only. (A block counts the shared shingles of one
class with all of its members at once.)

Candidates are confirmed on the full sets. In each of ``CONTRACTIONS`` rounds every
class confirms its best candidate (met in most trees) in another component, and
confirmed links are contracted; pairs inside one component are settled. The
last round confirms all other pairs, so every candidate pair is either
confirmed, rejected on full sets, or inside one component.

Two sets at the limit (similarity 0.85) share a tree's region with
probability 0.52; one of the 24 trees brings them together but for one pair
in 10**7.

Cases: null text and text without words have an empty set and are linked with
nothing (component: itself); fewer words than a shingle count as one shingle;
a null doc_id takes part and can name no component; rows repeated under one
doc_id are judged each by its own text; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import free_name, query, read, stage, text_buffers
from quarry.llm.components import components
from quarry.llm.vectors import blocks_of, spread
from quarry.llm.words import distinct_per_doc, doc_chunks, hash_words, mix, shingle_hashes

TREES = 24               # production parameters
BASE = 4                 # values that the classes of a region share at least
LEVELS = 3               # deeper cuts, by two values each
STEP = 7                 # a tree's order starts so many values after the tree's before
REGION = 8               # a larger region is cut deeper
NEIGHBOURS = 3
CONTRACTIONS = 1
SIMILAR = (85, 100)      # linked if 100 * intersection >= 85 * union
VALUES = TREES * STEP
CHUNK = 2 << 20          # bytes of text hashed at once
BLOCK = 1024             # classes of a block
FILTER_BITS = 1 << 25    # of the bitmap that spares other texts the shuffle

_rng = np.random.Generator(np.random.PCG64(606))
_XOR = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
_MUL = (_rng.integers(0, 1 << 32, VALUES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def shingle_sets(texts: pa.Array, n: int):
    """(first row, sorted distinct shingle hashes, their number per text) for
    runs of texts."""
    data, offsets = text_buffers(texts)
    for i, j in doc_chunks(offsets, CHUNK):
        part = offsets[i:j + 1]
        words, _ = hash_words(data[part[0]:part[-1]], part - part[0])
        yield i, *distinct_per_doc(*shingle_hashes(words, n))


def minhash(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Signatures (texts, VALUES) as uint32; zeros for empty sets."""
    out = np.zeros((len(sizes), VALUES), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        starts = (np.cumsum(sizes) - sizes)[full]
        for k in range(VALUES):
            out[full, k] = np.minimum.reduceat((low ^ _XOR[k]) * _MUL[k], starts)
    return out


def _fingerprint(hashes: np.ndarray, sizes: np.ndarray):
    """Two 64-bit sums over each set, that do not depend on its order."""
    ends = np.cumsum(sizes)
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(mix((sums[ends] - sums[ends - sizes]) ^ mix(sizes.astype(np.uint64))).view(np.int64))
    return out


def _sign(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, hashes, sizes in shingle_sets(batch.column("text"), shingle):
                n = len(sizes)
                c0, c1 = _fingerprint(hashes, sizes)
                values = minhash(hashes, sizes)
                empty = sizes == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), batch.column("digest").slice(i, n),
                     pa.array(sizes, pa.int64()), pa.array(c0), pa.array(c1),
                     pa.array([None if e else v.tobytes() for e, v in zip(empty, values)], pa.binary())],
                    names=["doc_id", "digest", "n", "c0", "c1", "signature"])
    return run


ORDER = ["region", *(f"k{i}" for i in range(LEVELS))]


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, deeper keys, class, size): a class's place in each tree. A
    class met before in the batch is left out."""
    for batch in batches:
        c0 = batch.column("c0").to_numpy(zero_copy_only=False)
        c1 = batch.column("c1").to_numpy(zero_copy_only=False)
        _, first = np.unique(np.stack([c0, c1], axis=1), axis=0, return_index=True)
        rows = batch.take(pa.array(np.sort(first)))
        if rows.num_rows == 0:
            continue
        sig = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(-1, VALUES)
        c0, c1, n = (rows.column(x).to_numpy(zero_copy_only=False) for x in ("c0", "c1", "n"))
        for t in range(TREES):
            run = sig[:, (t * STEP + np.arange(BASE + 2 * LEVELS)) % VALUES].astype(np.uint64)
            h = np.full(len(run), mix(np.array([t + 1], np.uint64))[0])
            for k in range(BASE):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + run[:, k])
            keys = [h.view(np.int64)] + [
                ((run[:, BASE + 2 * i] << np.uint64(32)) | run[:, BASE + 2 * i + 1]).view(np.int64)
                for i in range(LEVELS)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, c0, c1, n)],
                                             names=[*ORDER, "c0", "c1", "n"])


def _pairs_of(cols: dict[str, np.ndarray], similar, cut_region) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate rows (i, j) of sorted rows of whole regions, and the rows of
    large regions. ``cut_region`` is the region that the rows before ended in
    the midst of, which is a large one."""
    n_rows = len(cols["region"])
    same = np.ones(n_rows, bool)               # as the row before, so far down the order
    cells, cell_size = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    cut = np.ones(n_rows, bool)                # rows whose region is still to be cut
    for level, name in enumerate(ORDER):
        same[1:] &= cols[name][1:] == cols[name][:-1]
        same[0] = False
        ids = np.cumsum(~same) - 1
        size = np.bincount(ids)[ids]
        if level == 0 and cut_region is not None:
            size = np.where(cols["region"] == cut_region, np.maximum(size, REGION + 1), size)
        cells = np.where(cut, ids + level * n_rows, cells)
        cell_size = np.where(cut, size, cell_size)
        cut = cut & (size > REGION)
        if level == 0:
            regions, large = ids, np.flatnonzero(cut)
        if not cut.any():
            break
    out = []
    for d in range(1, REGION):
        if d >= n_rows:
            break
        i = np.arange(n_rows - d)
        near = cells[:-d] == cells[d:]
        take = near & (cell_size[:-d] <= REGION)
        if d <= NEIGHBOURS:
            take |= regions[:-d] == regions[d:]
        i = i[take]
        fewer, more = np.minimum(cols["n"][i], cols["n"][i + d]), np.maximum(cols["n"][i], cols["n"][i + d])
        fits = similar[1] * fewer >= similar[0] * more
        out.append((i[fits], i[fits] + d))
    i, j = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2
    return i, j, large


def _candidates(similar, most: int = 1 << 18):
    """Sorted tree rows to candidate pairs (a, b) and, with their region, the
    classes (a) of large regions. A region larger than ``most`` rows passes in
    pieces that overlap by the neighbours."""
    names = [*ORDER, "c0", "c1", "n"]

    def emit(cols, cut_region):
        fresh = np.ones(len(cols["n"]), bool)          # a class once per place
        fresh[1:] = np.any([cols[x][1:] != cols[x][:-1] for x in names], axis=0)
        cols = {k: v[fresh] for k, v in cols.items()}
        if not len(cols["n"]):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 5, names=["a0", "a1", "b0", "b1", "region"])
        i, j, large = _pairs_of(cols, similar, cut_region)
        a0, a1, b0, b1 = cols["c0"][i], cols["c1"][i], cols["c0"][j], cols["c1"][j]
        swap = (a0 > b0) | ((a0 == b0) & (a1 > b1))
        a0, b0 = np.where(swap, b0, a0), np.where(swap, a0, b0)
        a1, b1 = np.where(swap, b1, a1), np.where(swap, a1, b1)
        differ = (a0 != b0) | (a1 != b1)
        pairs, none = [x[differ] for x in (a0, a1, b0, b1)], np.zeros(len(large), np.int64)
        sides = [np.concatenate(x) for x in zip(pairs, (cols["c0"][large], cols["c1"][large], none, none))]
        region = pa.array(np.concatenate([np.zeros(len(pairs[0]), np.int64), cols["region"][large]]),
                          mask=np.arange(len(sides[0])) < len(pairs[0]))
        return pa.RecordBatch.from_arrays([*map(pa.array, sides), region], names=["a0", "a1", "b0", "b1", "region"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cut = {x: np.empty(0, np.int64) for x in names}, None
        for batch in batches:
            held = {x: np.concatenate([held[x], batch.column(x).to_numpy(zero_copy_only=False)]) for x in names}
            region = held["region"]
            if not len(region):
                continue
            whole = int(np.searchsorted(region, region[-1]))        # the last region may go on
            if whole:
                yield emit({x: v[:whole] for x, v in held.items()}, cut)
                held, cut = {x: v[whole:] for x, v in held.items()}, None
            if len(held["n"]) > most:
                yield emit(held, cut)
                held, cut = {x: v[-NEIGHBOURS:] for x, v in held.items()}, region[-1]
        if len(held["n"]):
            yield emit(held, cut)

    return run


def _confirm(similar, shingle: int):
    """(u, v, text_a, text_b) to (u, v, linked), on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            both = pa.concat_arrays([batch.column(c).cast(pa.large_string()) for c in ("text_a", "text_b")])
            order = np.arange(2 * n).reshape(2, n).T.ravel()           # a pair's texts side by side
            linked = np.zeros(n, bool)
            left = None
            for i, hashes, sizes in shingle_sets(both.take(pa.array(order)), shingle):
                at = np.cumsum(sizes) - sizes
                for k, size in enumerate(sizes):
                    own = hashes[at[k]:at[k] + size]
                    if (i + k) % 2 == 0:
                        left = own
                    else:
                        common = len(np.intersect1d(left, own, assume_unique=True))
                        linked[(i + k) // 2] = similar[1] * common >= similar[0] * (len(left) + len(own) - common)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(linked)],
                                             names=["u", "v", "linked"])

    return run


def _candidate_bits(nodes: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits, set where a candidate class hashes
    to. Its size does not depend on the documents."""
    at = F.pmod("c0", F.lit(FILTER_BITS)) + 1          # Spark's bitmaps count from 1
    parts = nodes.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:                                    # FILTER_BITS / 32768 rows at most
        first = (r["part"] - 1) * 4096
        out[first:first + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _class_texts(shingle: int, bits: np.ndarray):
    """(c0, c1, text) of documents that may belong to a candidate class (all
    that do, and some others); a class once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c0, c1 = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for i, hashes, sizes in shingle_sets(batch.column("text"), shingle):
                c0[i:i + len(sizes)], c1[i:i + len(sizes)] = _fingerprint(hashes, sizes)
            _, first = np.unique(np.stack([c0, c1], axis=1), axis=0, return_index=True)
            first = np.sort(first)
            at = c0[first] % FILTER_BITS
            first = first[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c0[first]), pa.array(c1[first]), batch.column("text").take(pa.array(first))],
                names=["c0", "c1", "text"])

    return run


def _settle(pairs: DataFrame, texts: DataFrame, similar, shingle: int) -> DataFrame:
    """(node, component) of the classes that confirmed links join.
    ``pairs``: (u, v, hits) with u < v; ``texts``: (node, text)."""
    links, parts = None, None
    for last in [False] * CONTRACTIONS + [True]:
        chosen = pairs.select("u", "v") if last else pairs.groupBy("v").agg(
            F.max_by("u", F.struct("hits", F.xxhash64("u"), "u")).alias("u"))       # each class's best
        with_a = chosen.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_a")), "u")
        with_b = with_a.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_b")), "v")
        judged = stage(with_b.select("u", "v", "text_a", "text_b").mapInArrow(
            _confirm(similar, shingle), "u bigint, v bigint, linked boolean"), "near-judged")
        new = judged.filter("linked").select("u", "v")
        # what earlier rounds joined enters as a star, one link a node
        links = new if parts is None else new.unionByName(
            parts.filter("node != component").select(F.col("component").alias("u"), F.col("node").alias("v")))
        parts = components(links)
        if last:
            return parts
        rest = pairs.join(judged.select("u", "v"), ["u", "v"], "left_anti")
        for side in ("u", "v"):
            rest = rest.join(parts.select(F.col("node").alias(side), F.col("component").alias(f"{side}_part")), side, "left")
        pairs = stage(rest.filter(F.coalesce("u_part", "u") != F.coalesce("v_part", "v")).select("u", "v", "hits"),
                      "near-pairs")
    return parts


def _shared(similar, shingle: int):
    """Confirmed links (u, v) between the asking classes of a block and its
    members in other components, one for each asking class and component."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table["asks"].to_numpy()
        node, part = table["node"].to_numpy(), table["part"].to_numpy()
        found = [None] * len(node)
        for i, hashes, sizes in shingle_sets(table["text"].combine_chunks(), shingle):
            ends = np.cumsum(sizes)
            for k in range(len(sizes)):
                found[i + k] = hashes[ends[k] - sizes[k]:ends[k]]
        members = np.flatnonzero(~asks)
        out = []
        if len(members) and asks.any():
            size = np.array([len(found[m]) for m in members])
            flat = np.concatenate([found[m] for m in members])
            owner = np.repeat(np.arange(len(members)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for q in np.flatnonzero(asks):
                own = found[q]
                lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                width = hi - lo
                hit = np.repeat(lo - (np.cumsum(width) - width), width) + np.arange(width.sum())
                common = np.bincount(owner[hit], minlength=len(members))
                linked = (similar[1] * common >= similar[0] * (len(own) + size - common)) & (part[members] != part[q])
                _, first = np.unique(part[members[linked]], return_index=True)
                out += [(node[q], v) for v in node[members[linked]][first]]
        u, v = (np.array(x, np.int64) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2
        return pa.table({"u": u, "v": v})

    return run


def _fringe(dense: DataFrame, parts: DataFrame, texts: DataFrame, similar, shingle: int) -> DataFrame:
    """Confirmed links (u, v) that large regions still hide. ``dense``:
    (region, node); ``parts``: (node, component) so far."""
    least = dense.groupBy("region").agg(F.min("node").alias("v"))
    clusters = components(dense.join(least, "region").select(F.col("node").alias("u"), "v")) \
        .select("node", F.col("component").alias("cluster"))
    members = stage(clusters.join(parts, "node", "left").select(
        "cluster", "node", F.coalesce("component", "node").alias("part")), "near-members")
    sizes = members.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(
        F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("part", F.struct("n", "part")).alias("largest"))
    sizes = stage(sizes.filter(F.col("all") > F.col("most")).select(
        "cluster", "largest", blocks_of(F.col("all"), BLOCK).alias("blocks"),
        blocks_of(F.col("all") - F.col("most"), BLOCK).alias("ask_blocks")), "near-clusters")
    known = members.join(sizes, "cluster").join(texts, "node")
    sides = []
    for asks in (False, True):
        rows = known.filter(F.col("part") != F.col("largest")) if asks else known
        own, other = ("ask_blocks", "blocks") if asks else ("blocks", "ask_blocks")
        names = ("ask_block", "block") if asks else ("block", "ask_block")
        sides.append(spread(rows, "node", F.col(own), F.col(other), *names).select(
            "cluster", "block", "ask_block", "node", "part", "text", F.lit(asks).alias("asks")))
    return sides[0].unionByName(sides[1]).groupBy("cluster", "block", "ask_block").applyInArrow(
        _shared(similar, shingle), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, similar: tuple[int, int] = SIMILAR,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, digest (of
    the text, to tell rows of one doc_id apart) and chosen: whether its doc_id
    and digest are the first of its component, null ids last. ``similar`` is
    the limit as (numerator, denominator)."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("digest"),
                       text.alias("text"))
    signed = stage(rows.mapInArrow(_sign(shingle), "doc_id bigint, digest bigint, n bigint, c0 bigint, c1 bigint, signature binary"),
                   "near-signed")
    cls = ["c0", "c1"]
    tree = signed.filter("n > 0").select("c0", "c1", "n", "signature").mapInArrow(
        _tree_rows, ", ".join(f"{x} bigint" for x in [*ORDER, "c0", "c1", "n"]))
    pairs = (tree.repartition("region").sortWithinPartitions(*ORDER, "c0", "c1")
             .mapInArrow(_candidates(similar), "a0 bigint, a1 bigint, b0 bigint, b1 bigint, region bigint"))
    found = stage(pairs, "near-found")
    pairs = stage(found.filter("region IS NULL").groupBy("a0", "a1", "b0", "b1").agg(F.count(F.lit(1)).alias("hits")),
                  "near-candidates")
    dense = found.filter("region IS NOT NULL").select("region", F.col("a0").alias("c0"), F.col("a1").alias("c1"))
    # candidate classes get numbers of their own: their links are long pairs
    nodes = pairs.select(F.col("a0").alias("c0"), F.col("a1").alias("c1")).unionByName(
        pairs.select(F.col("b0").alias("c0"), F.col("b1").alias("c1"))).unionByName(dense.select("c0", "c1")).distinct()
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    a = nodes.select(F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("node").alias("a"))
    b = nodes.select(F.col("c0").alias("b0"), F.col("c1").alias("b1"), F.col("node").alias("b"))
    pairs = stage(pairs.join(a, ["a0", "a1"]).join(b, ["b0", "b1"]).select(
        F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "hits"), "near-pairs")
    texts = rows.select("text").mapInArrow(_class_texts(shingle, _candidate_bits(nodes)), "c0 bigint, c1 bigint, text string").join(nodes, cls) \
        .groupBy("node").agg(F.min("text").alias("text"))
    parts = None
    if not nodes.isEmpty():
        texts = stage(texts, "near-texts")
        parts = stage(_settle(pairs, texts, similar, shingle), "near-parts")
        hidden = stage(_fringe(stage(dense.join(nodes, cls).select("region", "node"), "near-dense"), parts, texts,
                               similar, shingle), "near-hidden")
        if not hidden.isEmpty():
            parts = components(hidden.unionByName(parts.filter("node != component").select(
                F.col("component").alias("u"), F.col("node").alias("v"))))

    classes = signed.filter("n > 0").groupBy(*cls).agg(
        F.min("doc_id").alias("least"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first"))
    if parts is not None:
        joined = nodes.join(parts, "node").join(classes, cls)
        least = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.min("first").alias("of_all"))
        named = joined.join(least, "component").select(*cls, "component_id", "of_all")
        classes = classes.join(named, cls, "left").select(
            *cls, F.coalesce("component_id", "least").alias("component_id"), F.coalesce("of_all", "first").alias("first"))
    else:
        classes = classes.withColumnRenamed("least", "component_id")
    alone = signed.filter("n = 0").select("doc_id", "digest", "n", F.col("doc_id").alias("component_id"),
                                           F.lit(True).alias("chosen"))
    joined = signed.filter("n > 0").select("doc_id", "digest", "n", *cls).join(classes, cls) \
        .select("doc_id", "digest", "n", "component_id",
                (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))).alias("chosen"))
    return joined.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "digest", "chosen")


def one_of_each(docs: DataFrame, shingle: int = 3, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The documents that stay: of each group one row, with the smallest
    doc_id (null ids last) and of its texts the one of the smallest digest;
    of documents without words, one of rows repeated in doc_id and text. The texts
    are not shuffled while the rejected ids stay below the broadcast threshold."""
    judged = stage(near_duplicates(docs, shingle, similar), "near-result")
    key, digest = (free_name(docs.columns, x) for x in ("key", "digest"))
    keyed = docs.withColumn(digest, F.xxhash64("text")).withColumn(
        key, F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.col(digest)))
    row_key = F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.col("digest")).alias(key)
    rejected = stage(judged.filter(~F.col("chosen")).select(row_key).distinct(), "near-rejected")
    repeated = stage(judged.filter("chosen").groupBy(row_key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key),
                     "near-repeated")
    stays = keyed.join(rejected, key, "left_anti")
    single = stays.join(repeated, key, "left_anti")
    return single.unionByName(stays.join(repeated, key, "left_semi").dropDuplicates([key])).drop(key, digest)


@query("op6_lsh_forest_dedup")
def op6_lsh_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("digest", "chosen")
