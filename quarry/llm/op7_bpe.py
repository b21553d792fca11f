"""Byte-level BPE encoding and decoding.

Every whole text is cut at the vocabulary's added tokens, then by its
pre-token pattern; each pre-token's byte symbols form a doubly linked list
whose neighbouring pairs wait in a priority queue ordered by merge rank and
position. The best pair is merged, its two new neighbour pairs are queued,
and queue entries whose symbols have changed meanwhile are skipped as stale.
Decoding concatenates the vocabulary strings of the ids, maps their
characters back to bytes and reads them as UTF-8 (malformed sequences become
U+FFFD).

Cases: a null or empty text has no ids and decodes to the empty string; very
long texts are encoded whole (a merge step costs the logarithm of the
pre-token's length); equal texts have equal ids; extra columns are kept, and
the result columns replace columns of the same name.

A worker remembers the ids of short pre-tokens, in a table of bounded size
that only saves time.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import query, read

# Fixed value: the pre-token pattern of byte-level BPE vocabularies of this family.
PRETOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
REMEMBERED = 250_000     # pre-tokens a worker remembers, twice: newer and older ones
SHORT = 48               # of at most so many characters
ROWS = 256               # texts whose ids are held at once


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary:
    itself where Latin-1 has a visible one, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def merge_symbols(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the merges to one pre-token's symbols, lowest rank first, the
    leftmost pair first among equals."""
    n = len(symbols)
    if n < 2:
        return symbols
    sym = list(symbols)
    nxt = list(range(1, n)) + [-1]
    prv = list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        found = ranks.get((sym[i], sym[i + 1]))
        if found:
            queue.append((found[0], i, sym[i], sym[i + 1], found[1]))
    heapq.heapify(queue)
    while queue:
        _, i, left, right, merged = heapq.heappop(queue)
        j = nxt[i]
        if sym[i] != left or j < 0 or sym[j] != right:
            continue                                   # stale
        sym[i], sym[j] = merged, -1
        k = nxt[i] = nxt[j]
        if k >= 0:
            prv[k] = i
            found = ranks.get((merged, sym[k]))
            if found:
                heapq.heappush(queue, (found[0], i, merged, sym[k], found[1]))
        h = prv[i]
        if h >= 0:
            found = ranks.get((sym[h], merged))
            if found:
                heapq.heappush(queue, (found[0], h, sym[h], merged, found[1]))
    return [s for s in sym if s >= 0]


class Codec:
    """One vocabulary file, read once per worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" \
                or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        chars = byte_characters()
        back = {c: b for b, c in chars.items()}
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.byte_id = [vocab[chars[b]] for b in range(256)]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.strings = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") \
            if self.added else None
        self.pieces = regex.compile(PRETOKEN).findall
        codec = self

        class Memory(dict):
            older: dict = {}

            def __missing__(self, piece: str) -> bytes:
                ids = self.older.get(piece)
                if ids is None:
                    merged = merge_symbols([codec.byte_id[b] for b in piece.encode()], codec.ranks)
                    ids = array("i", merged).tobytes()
                if len(piece) <= SHORT:
                    if len(self) >= REMEMBERED:
                        self.older = dict(self)
                        self.clear()
                    self[piece] = ids
                return ids

        self.ids_of = Memory().__getitem__

    def encode(self, text: str) -> np.ndarray:
        if self.cut is None or not self.cut.search(text):
            return np.frombuffer(b"".join(map(self.ids_of, self.pieces(text))), np.int32)
        out = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(array("i", [self.added[part]]).tobytes())
            elif part:
                out.extend(map(self.ids_of, self.pieces(part)))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _id_lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the ids of ``text`` (array of int). ``path`` names the
    vocabulary file, which every worker can read."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for batch in _slices(batches):
            yield _id_lists([c.encode(v.as_py() or "") for v in batch])

    return df.withColumn(out, run(F.col(f"`{text}`")))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of the ids."""

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for batch in _slices(batches):
            yield pa.array([c.decode(v.values.to_numpy().tolist()) if v.is_valid else "" for v in batch], pa.string())

    return df.withColumn(out, run(F.col(f"`{ids}`")))


def round_trip(df: DataFrame, path: str, text: str = "text", out: str = "coded") -> DataFrame:
    """Add ``out``: struct (ids, decoded), encoded and decoded again from the
    ids in one worker."""

    @F.arrow_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for batch in _slices(batches):
            ids = [c.encode(v.as_py() or "") for v in batch]
            decoded = pa.array([c.decode(i.tolist()) for i in ids], pa.string())
            yield pa.StructArray.from_arrays([_id_lists(ids), decoded], ["ids", "decoded"])

    return df.withColumn(out, run(F.col(f"`{text}`")))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document its number of ids and the digests of ids and decoded text."""
    return round_trip(docs.select("doc_id", "text"), path).select(
        "doc_id", F.size("coded.ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("coded.ids", ","), 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"))


@query("op7_bpe_codec")
def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), default_vocabulary())
