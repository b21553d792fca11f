"""Phrase collocation mining over sorted count streams.

Phrases of one to ``most`` words are counted in several readings of the texts.
A count reaches the threshold only if the counts of both shorter parts do, so
only phrases whose two parts of one word less may be frequent are counted: a
bitmap of ``FILTER_BITS`` bits, the same size for any input, says which may. It
keeps rare phrases out of the shuffle and never drops a frequent one; when it
fills up (more frequent phrases than bits) it only spares less.

The frequent phrases of all orders then form one stream, kept in two layouts:
sorted by words from the first (prefix order) and from the last (suffix
order). In prefix order a phrase comes right after its first words and right
before its extensions, so one lockstep walk of all orders attaches to each
phrase the counts of its first 1, 2, ... words and the highest count of its
extensions by one word. The walk of the suffix layout gives the counts of the
last words and the extensions to the left. Nothing is hashed or looked up in
these walks, and a walk holds one phrase of each order.

The streams are range-partitioned on the whole phrase, so a hot first word is
spread over many partitions. A partition that starts among the extensions of
earlier phrases gets the counts of these (``most - 1`` rows a partition at most),
and what it finds for them is combined at the end.

A phrase inside a longer one is inside an extension by one word at least as
frequent as the longer one, so the extensions decide containment.

Cases: null and empty texts and texts without words have no phrases; a null
group is ``und`` (and shares its counts with a group of that name); very long texts are counted whole; repeated rows count each; ties
go by count and then by phrase; an empty table gives an empty result; extra
columns are ignored. Counts are exact: hashes decide only what may be left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import query, read, stage, text_buffers
from quarry.llm.words import doc_chunks, hash_words, mix
from quarry.session import ensure_checkpoint_dir

MIN_COUNT, MOST_WORDS, TOP = 30, 4, 2000      # production parameters
CONTAINED = (80, 100)       # dropped if an extension has this share of the count
SCALE = 2_000_000
FILTER_BITS = 1 << 26
CHUNK = 2 << 20             # bytes of texts counted at once
HASHED = 3                  # lengths that are counted by hash first
HASH_BITS = 40              # of the hashes that are counted
_STEP = np.uint64(0xD6E8FEB86659FD93)

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_SOLID = ~_BREAK
_SOLID[[0x20, 9]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lower-cased words of the texts, the text of each, and whether the
    next word is in the same piece."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = _SOLID[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    start = np.flatnonzero(first)
    kept = np.zeros(n + 1, np.int32)
    np.cumsum(solid, out=kept[1:])
    bounds = np.append(kept[start], kept[-1]).astype(np.int32)
    text = np.searchsorted(offsets, start, side="right") - 1
    breaks = np.cumsum(_BREAK[data], dtype=np.int32)[start]
    joined = np.zeros(len(start), bool)
    joined[:-1] = (text[1:] == text[:-1]) & (breaks[1:] == breaks[:-1])
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(_LOWER[data[solid]]))
    return words, text, joined


def _group_hashes(groups: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(str(g).encode(), digest_size=8).digest(), "little")
                     for g in groups.to_pylist()], np.uint64)


def _phrase_hashes(group: np.ndarray, word_columns: list[np.ndarray]) -> np.ndarray:
    """Hashes (``HASH_BITS`` bits) of phrases given by their group's and their words' hashes."""
    h = group
    for w in word_columns:
        h = mix(h * _STEP + w)
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)


class Chunk:
    """The words of some texts as numbers, and their hashes."""

    def __init__(self, texts: pa.Array, groups: pa.Array):
        words, text, self.joined = split_words(*text_buffers(texts))
        coded, names = words.dictionary_encode(), groups.dictionary_encode()
        self.words, self.groups = coded.dictionary, names.dictionary
        self.code, self.size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        self.group = names.indices.to_numpy().astype(np.int64)[text]
        self.hashes = hash_words(*text_buffers(self.words))[0].hash[self.code]
        self.group_hashes = _group_hashes(self.groups)[self.group]

    def places(self, n: int) -> np.ndarray:
        """Where phrases of ``n`` words start."""
        at = np.arange(max(len(self.code) - n + 1, 0))
        for k in range(n - 1):
            at = at[self.joined[at + k]]
        return at

    def phrase_hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        return _phrase_hashes(self.group_hashes[at], [self.hashes[at + k] for k in range(n)])

    def marked(self, at: np.ndarray, n: int, bits: np.ndarray) -> np.ndarray:
        """Whether the phrase of ``n`` words at each place may be frequent."""
        slot = self.phrase_hashes(at, n) & (8 * len(bits) - 1)
        return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1

    def both_parts_marked(self, at: np.ndarray, n: int, bits: np.ndarray | None) -> np.ndarray:
        for shift in (0, 1) if n > 1 else ():
            at = at[self.marked(at + shift, n - 1, bits)]
        return at

    def counted(self, at: np.ndarray, n: int) -> pa.RecordBatch:
        """Phrases and their counts. The numbers of equal (group, words) are
        exact, and never above the number of words squared."""
        key = self.group[at] * self.size + self.code[at]
        for k in range(1, n):
            _, key = np.unique(key, return_inverse=True)
            key = key * self.size + self.code[at + k]
        _, one, counts = np.unique(key, return_index=True, return_counts=True)
        at = at[one]
        parts = [self.words.take(pa.array(self.code[at + k])) for k in range(n)]
        phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
        return pa.RecordBatch.from_arrays(
            [self.groups.take(pa.array(self.group[at])), phrase, pa.array(np.full(len(at), n, np.int32)),
             pa.array(counts.astype(np.int64))], names=["grp", "phrase", "n", "f"])


def _chunks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[Chunk]:
    for batch in batches:
        texts, groups = batch.column("text"), batch.column("grp")
        _, offsets = text_buffers(texts)
        for i, j in doc_chunks(offsets, most_bytes):
            chunk = Chunk(texts.slice(i, j - i), groups.slice(i, j - i))
            if len(chunk.code):
                yield chunk


def _count_hashes(n: int, bits: np.ndarray | None, most_bytes: int):
    """(h, f): hashes of the phrases of ``n`` words with their counts; and,
    for words, (grp, f): the number of words of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, most_bytes):
            at = chunk.both_parts_marked(chunk.places(n), n, bits)
            h, f = np.unique(chunk.phrase_hashes(at, n), return_counts=True)
            groups = pa.nulls(len(h), pa.string())
            if n == 1:
                group, words = np.unique(chunk.group, return_counts=True)
                groups = pa.concat_arrays([groups, chunk.groups.take(pa.array(group))])
                h, f = np.concatenate([h, np.zeros(len(group), np.int64)]), np.concatenate([f, words])
            yield pa.RecordBatch.from_arrays([groups, pa.array(h), pa.array(f.astype(np.int64))],
                                             names=["grp", "h", "f"])

    return run


def _count_phrases(lengths: range, bits: dict[int, np.ndarray], most_bytes: int):
    """Phrases and their counts: those in the bitmap of their length where
    there is one, else those whose two parts are in theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, most_bytes):
            for n in lengths:
                at = chunk.places(n)
                at = at[chunk.marked(at, n, bits[n])] if n in bits else chunk.both_parts_marked(at, n, bits[n - 1])
                if len(at):
                    yield chunk.counted(at, n)

    return run


def _hash_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of phrases of one length."""
    for batch in batches:
        groups = batch.column("grp").dictionary_encode()
        words, _ = hash_words(*text_buffers(batch.column("phrase")))
        each = words.hash.reshape(batch.num_rows, -1)
        group = _group_hashes(groups.dictionary)[groups.indices.to_numpy()]
        yield pa.RecordBatch.from_arrays([pa.array(_phrase_hashes(group, list(each.T)))], names=["h"])


def _bitmap(hashes: DataFrame) -> np.ndarray:
    at = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1          # Spark's bitmaps count from 1
    parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("part")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:                                    # FILTER_BITS / 32768 rows at most
        first = (r["part"] - 1) * 4096
        out[first:first + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def phrase_counts(docs: DataFrame, min_count: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(grp, words, f) of the frequent phrases of 1 to ``most`` words, and
    (grp, n), the number of words of each group. ``docs``: (grp, text).

    Short phrases, nearly all of them rare, are counted by hash first: the
    sum of a hash is never below the count of a phrase, so the phrases that are
    then counted themselves include all frequent ones."""
    bits: dict[int, np.ndarray] = {}
    totals = None
    for n in range(1, min(most, HASHED) + 1):
        counts = docs.mapInArrow(_count_hashes(n, bits.get(n - 1), CHUNK), "grp string, h bigint, f bigint") \
            .groupBy("grp", "h").agg(F.sum("f").alias("f"))
        if n == 1:
            counts = stage(counts.filter(F.col("grp").isNotNull() | (F.col("f") >= min_count)), "phrase-words")
            totals = counts.filter(F.col("grp").isNotNull()).select("grp", F.col("f").alias("n"))
        bits[n] = _bitmap(counts.filter(F.col("grp").isNull() & (F.col("f") >= min_count)).select("h"))
    frequent, first = None, 1
    while first <= most:
        last = min(max(first, HASHED + 1), most)
        counts = docs.mapInArrow(_count_phrases(range(first, last + 1), bits, CHUNK), "grp string, phrase string, n int, f bigint") \
            .groupBy("grp", "phrase", "n").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)
        counts = stage(counts, f"phrase-counts-{last}")
        rows = counts.select("grp", F.split("phrase", " ").alias("words"), "f")
        frequent = rows if frequent is None else frequent.unionByName(rows)
        if last < most:
            longest = counts.filter(F.col("n") == last).select("grp", "phrase")
            bits = {last: _bitmap(longest.mapInArrow(_hash_phrases, "h bigint"))}
        first = last + 1
    return frequent, totals


WALKED = "grp string, key array<string>, f bigint, parts array<bigint>, longer bigint"


def _walk(context: dict[int, list]):
    """The lockstep walk of one partition of a sorted stream: each phrase with
    the counts of its first words and its most frequent extension. Of the
    phrases before the partition (``context``) only the extension is told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # open phrases, each the first words of the next: [group, words, count, highest extension, is its own]
        chain, seen = [], None
        done: list[tuple] = []

        def close():
            group, key, f, longer, own = chain.pop()
            if own:
                done.append((group, key, f, [c[2] for c in chain], longer))
            elif longer:
                done.append((group, key, None, None, longer))

        def flush():
            columns = list(zip(*done)) if done else [()] * 5
            types = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                               names=["grp", "key", "f", "parts", "longer"])
            done.clear()
            return batch

        for batch in batches:
            for pid, group, key, f in zip(*(batch.column(c).to_pylist() for c in ("pid", "grp", "key", "f"))):
                if pid != seen:
                    while chain:
                        close()
                    seen = pid
                    chain.extend([g, k, c, 0, False] for g, k, c in context.get(pid, ()))
                while chain and (chain[-1][0] != group or key[:len(chain[-1][1])] != chain[-1][1]):
                    close()
                if chain:
                    chain[-1][3] = max(chain[-1][3], f)
                chain.append([group, key, f, 0, True])
            yield flush()
        while chain:
            close()
        yield flush()

    return run


def _layout(frequent: DataFrame, key) -> DataFrame:
    """``WALKED`` rows of the stream sorted by ``key``."""
    spark = frequent.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # in the shared folder: partition numbers hold when a task runs again
    stream = frequent.select("grp", key.alias("key"), "f").repartitionByRange(n, "grp", "key") \
        .sortWithinPartitions("grp", "key").checkpoint(eager=True).withColumn("pid", F.spark_partition_id())
    starts = stream.groupBy("pid").agg(F.min(F.struct("grp", "key")).alias("s")) \
        .filter(F.size("s.key") > 1) \
        .select("pid", F.col("s.grp").alias("grp"), F.col("s.key").alias("whole"),
                F.explode(F.sequence(F.lit(1), F.size("s.key") - 1)).alias("k")) \
        .select("pid", "grp", F.slice("whole", F.lit(1), F.col("k")).alias("key"))
    context: dict[int, list] = {}
    # a row for each partition and shorter order at most
    for r in starts.join(stream.drop("pid"), ["grp", "key"]).orderBy("pid", F.size("key")).collect():
        context.setdefault(r["pid"], []).append((r["grp"], r["key"], r["f"]))
    return stream.mapInArrow(_walk(context), WALKED)


def score_sql(a: str, parts: str) -> str:
    """The floored score, in decimals: the product may pass 64 bits."""
    return f"CAST({SCALE} AS DECIMAL(8, 0)) * CAST({a} AS DECIMAL(20, 0)) div CAST({parts} AS DECIMAL(20, 0))"


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", min_count: int = MIN_COUNT,
                 most: int = MOST_WORDS, contained: tuple[int, int] = CONTAINED, top: int | None = TOP) -> DataFrame:
    """Each group's phrases by score, the first ``top`` (None: all): lang,
    rank, phrase, a, l, r, n, score."""
    rows = docs.select(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("und")).alias("grp"),
                       F.col(f"`{text}`").alias("text"))
    frequent, totals = phrase_counts(rows, min_count, most)
    forward = _layout(frequent, F.col("words")).select(
        "grp", F.col("key").alias("words"), "f", F.col("parts").alias("heads"),
        F.lit(None).cast("array<bigint>").alias("tails"), "longer")
    backward = _layout(frequent, F.reverse("words")).select(
        "grp", F.reverse("key").alias("words"), "f", F.lit(None).cast("array<bigint>").alias("heads"),
        F.reverse("parts").alias("tails"), "longer")
    found = forward.unionByName(backward).groupBy("grp", "words").agg(
        F.max("f").alias("a"), F.max("heads").alias("heads"), F.max("tails").alias("tails"), F.max("longer").alias("longer"))
    found = found.filter((F.size("words") > 1)
                         & ~(F.lit(contained[1]) * F.col("longer") >= F.lit(contained[0]) * F.col("a")))
    cut = F.expr(f"""array_min(transform(arrays_zip(heads, tails), (x, i) -> struct(
        {score_sql("a", "x.heads + x.tails")} AS score, i AS k, x.heads AS l, x.tails AS r)))""")
    scored = found.withColumn("cut", cut).select(
        "grp", F.array_join("words", " ").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("cut.score").alias("score"))
    # with a limit, Spark keeps the first rows of each task before it sends them to the group's
    rank = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(rank))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "grp").select(F.col("grp").alias("lang"), F.col("rank").cast("bigint").alias("rank"),
                                             "phrase", "a", "l", "r", "n", "score")


@query("op13_collocations", oracle=rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws[i:i + k - 1] AS ws FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
      FROM (SELECT lang, ws, unnest(range(1, {MOST_WORDS + 1})) AS k FROM w))),
c AS (SELECT lang, ws, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
e AS (SELECT lang, ws, max(f) AS longer FROM (SELECT lang, ws[1:len(ws) - 1] AS ws, f FROM c WHERE len(ws) > 1
      UNION ALL SELECT lang, ws[2:len(ws)], f FROM c WHERE len(ws) > 1) GROUP BY ALL),
k AS (SELECT c.lang, c.ws, c.f AS a, unnest(range(1, len(c.ws))) AS k FROM c LEFT JOIN e USING (lang, ws)
      WHERE len(c.ws) > 1 AND NOT coalesce(100 * longer >= 80 * c.f, false)),
s AS (SELECT k.lang, k.ws, a, k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * a // (x.f + y.f))::BIGINT AS score
      FROM k JOIN c x ON x.lang = k.lang AND x.ws = k.ws[1:k] JOIN c y ON y.lang = k.lang AND y.ws = k.ws[k + 1:len(k.ws)]),
b AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM s
      QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN t USING (lang) QUALIFY rank <= {TOP}
""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))
