"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation (one good class and a bad class for each labeller, votes
independent given the class) estimates each labeller's accuracy and the share of good documents from the
counts of the vote patterns over all documents; a document's posterior is
that of its pattern. A hashed linear scorer is then fitted to the posteriors of
a bounded sample and scores every document on its whole text, so that texts
near to no heuristic are judged too.

The vote patterns are counted in Spark; with L labellers there are 3**L of
them at most, which is all that the driver sees of the votes. The sample for the
scorer holds about ``SAMPLE`` documents with the smallest text hashes, fewer
where these would be more than ``SAMPLE_BYTES``, and no text longer than ``LONGEST``
bytes (such texts vote and are scored whole like all others); the
weights (``2**18`` floats) are all that goes to the scoring tasks.

The scorer's features are word shapes (letters folded to classes), pairs of
shapes and repeats of the word before. A document's score is the mean over its
words, as junk fills a document.

Cases: null, empty and wordless texts get no votes, score 0 and are rejected;
very long texts are judged whole; equal texts get equal results; without any
document the model is neutral; extra columns are ignored by the query and kept
by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import linear
from quarry.llm.common import query, read, stage, text_buffers
from quarry.llm.words import distinct_per_doc, doc_chunks, hash_words, shingle_hashes

SAMPLE = 4000            # production parameters
SAMPLE_BYTES = 64 << 20  # of the sample's texts, about
LONGEST = 1 << 20        # bytes of a text that the scorer is fitted on
LIMIT = 0.5              # documents below are rejected
FLOOR = 0.007
FEW = 8

# Labellers: a measure of the text, up to where they vote good, and from where
# bad (the other way round where the first number is the larger one).
LABELLERS = {
    "capitals": (0.10, 0.30),        # share of letters that are A-Z
    "symbols": (0.010, 0.03),        # share of bytes that are neither letter, digit, blank nor plain punctuation
    "bare_words": (0.05, 0.15),      # share of words without letter or digit
    "exclaiming": (0.05, 0.30),      # exclamation marks per word
    "repeats": (0.05, 0.20),         # share of words equal to the word before
    "shingles": (0.30, 0.60),        # share of 3-word shingles met before in the text
    "letters": (0.72, 0.60),         # share of bytes that are letters
    "word_length": (7.5, 12.0),      # mean bytes per word
}
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0x20
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("a"):ord("z") + 1] = 2
_CLASS[128:] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b".,;:!?'\"()-")] = True
SHAPE_PAIR, REPEAT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def measures(data: np.ndarray, offsets: np.ndarray):
    """(texts, labellers) measures, the words' hashes and the shapes' hashes."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    words, _ = hash_words(data, offsets)
    per = words.per_doc
    kind = _CLASS[data] if len(data) else np.empty(0, np.uint8)
    letter, blank = (kind == 1) | (kind == 2), kind == 0x20
    odd = ~letter & ~blank & (kind != 3) & ~_PLAIN[data] if len(data) else letter
    share = lambda flags, of: linear.segment_sum(flags.astype(float), size) / np.maximum(of, 1)
    letters = linear.segment_sum(letter.astype(float), size)
    solid = np.concatenate([[0], np.cumsum(letter | (kind == 3))])
    bare = solid[words.end] == solid[words.start]
    same = np.zeros(len(words.hash), bool)
    same[1:] = words.hash[1:] == words.hash[:-1]
    first = (np.cumsum(per) - per)[per > 0]
    same[first] = False
    by_word = lambda flags: linear.segment_sum(flags.astype(float), per) / np.maximum(per, 1)
    shingles, counts = shingle_hashes(words, 3)
    _, distinct = distinct_per_doc(shingles, counts)
    out = {
        "capitals": share(kind == 1, letters), "symbols": share(odd, size), "bare_words": by_word(bare),
        "exclaiming": share(data == ord("!"), per), "repeats": by_word(same),
        "shingles": 1 - distinct / np.maximum(counts, 1), "letters": letters / np.maximum(size, 1),
        "word_length": by_word(words.end - words.start),
    }
    # shapes: runs of one class fold to one byte, so words keep their places
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    keep = np.ones(len(data), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | edge[1:len(data)]
    folded = np.concatenate([[0], np.cumsum(keep)])
    shapes, _ = hash_words(kind[keep], folded[offsets])
    return np.stack([out[k] for k in LABELLERS], axis=1).reshape(n, -1), words, shapes, same


def votes(measured: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """(texts, labellers): 1 good, 0 bad, 2 no vote."""
    out = np.full(measured.shape, 2, np.int64)
    for k, (good, bad) in enumerate(LABELLERS.values()):
        sign = 1 if good < bad else -1
        out[sign * measured[:, k] <= sign * good, k] = 1
        out[sign * measured[:, k] >= sign * bad, k] = 0
    out[per_doc == 0] = 2
    return out


def _slots(words, shapes, same) -> np.ndarray:
    before = np.empty_like(shapes.hash)
    before[1:], before[:1] = shapes.hash[:-1], 0
    first = np.cumsum(words.per_doc) - words.per_doc
    before[first[words.per_doc > 0]] = 0
    pair = shapes.hash * SHAPE_PAIR + before
    repeat = np.where(same, REPEAT, np.uint64(1)) * np.uint64(3)
    mask = np.uint64((1 << linear.BITS) - 1)
    return (np.stack([shapes.hash, pair ^ (pair >> np.uint64(29)), repeat], axis=1) & mask).astype(np.int32)


def judged(texts: pa.Array):
    """(vote pattern, slots, words of each text) for runs of texts; a pattern is a number in base 3."""
    data, offsets = text_buffers(texts)
    base = 3 ** np.arange(len(LABELLERS))
    for i, j in doc_chunks(offsets):
        part = offsets[i:j + 1]
        measured, words, shapes, same = measures(data[part[0]:part[-1]], part - part[0])
        yield votes(measured, words.per_doc) @ base, _slots(words, shapes, same), words.per_doc


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
    """(posterior of good per pattern, share of good, accuracy of each
    labeller where it votes).

    Labellers know different kinds of junk, so their votes on junk are not
    independent; besides the good class there is one bad class for each
    labeller, that starts with the documents it calls bad. No vote counts as
    less likely than ``FLOOR`` in any class, so a single odd vote does not
    make junk."""
    n = len(LABELLERS)
    vote = (patterns[:, None] // 3 ** np.arange(n)) % 3
    one_hot = np.stack([vote == v for v in range(3)], axis=2).astype(float)      # pattern, labeller, vote
    calls = (vote == 0).astype(float)
    held = np.concatenate([np.where(calls.any(1, keepdims=True), 0.05, 0.99), calls + 0.01 / n], axis=1)
    held = (held / held.sum(axis=1, keepdims=True)).T                            # class, pattern
    for _ in range(rounds):
        weight = held * counts
        prior = (weight.sum(axis=1) + 0.1) / (counts.sum() + 0.1 * (n + 1))
        table = np.einsum("cp,pjv->cjv", weight, one_hot) + 0.1
        table = FLOOR + (1 - 3 * FLOOR) * table / table.sum(axis=2, keepdims=True)
        log = np.einsum("cjv,pjv->cp", np.log(table), one_hot) + np.log(prior)[:, None]
        new = np.exp(log - log.max(axis=0))
        new /= new.sum(axis=0)
        change = np.abs(new - held).max(initial=0)
        held = new
        if change < 1e-10:
            break
    good, n_votes = held[0] * counts, lambda v: ((vote == v) * counts[:, None]).sum(0)
    right = (good[:, None] * (vote == 1) + (counts - good)[:, None] * (vote == 0)).sum(0)
    return held[0], float(good.sum() / counts.sum()), right / np.maximum(n_votes(0) + n_votes(1), 1)


@dataclass
class Model:
    posterior: dict[int, float]
    share_good: float
    accuracy: dict[str, float]
    weights: np.ndarray
    bias: float


def _mean_score(model: Model, slots, per_doc):
    """The mean over a text's words, at the scale of a whole window. A few
    words are little evidence: they are held against ``FEW`` words that say
    what the share of good documents says."""
    mean = linear.segment_sum(model.weights[slots].sum(axis=1, dtype=np.float64), per_doc) / np.maximum(per_doc, 1)
    z = model.bias + mean * np.sqrt(linear.WINDOW / slots.shape[1])
    prior = np.log(model.share_good / (1 - model.share_good)) if 0 < model.share_good < 1 else 0.0
    return linear.sigmoid((per_doc * z + FEW * prior) / (per_doc + FEW))


def _fit_scorer(posterior: dict[int, float]):
    """One task fits the scorer to the sample's posteriors. Windows of 64
    words teach it, each weighted alike."""

    def run(table: pa.Table) -> pa.Table:
        texts = table.sort_by("digest")["text"].combine_chunks()      # digests differ
        slots, words, targets = [], [], []
        for pattern, s, per in judged(texts):
            full = per > 0
            post = np.array([posterior.get(int(p), 0.5) for p in pattern])
            n_words, n_windows = linear.windows(per[full])
            slots.append(s)
            words.append(n_words)
            targets.append(np.repeat(post[full], n_windows))
        if not any(map(len, words)):
            return pa.table({"weights": pa.array([], pa.binary()), "bias": pa.array([], pa.float64())})
        weights, bias, _ = linear.fit(np.concatenate(slots), np.concatenate(words), np.concatenate(targets))
        return pa.table({"weights": pa.array([weights.tobytes()], pa.binary()), "bias": pa.array([bias])})

    return run


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on the vote patterns of all documents and a sample's texts."""

    def pattern_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [(p, per > 0) for p, _, per in judged(batch.column(0))]
            full = np.concatenate([np.empty(0, bool), *(f for _, f in some)])
            values = np.concatenate([np.empty(0, np.int64), *(p[f] for p, f in some)])
            yield pa.RecordBatch.from_arrays([pa.array(values), *(batch.column(i).filter(pa.array(full)) for i in (1, 2))],
                                             names=["pattern", "digest", "size"])

    texts = docs.select(F.col(f"`{text}`").alias("text"))
    digest = F.xxhash64("text")
    votes = stage(texts.select("text", digest.alias("digest"), F.octet_length("text").cast("bigint").alias("size"))
                  .mapInArrow(pattern_of, "pattern bigint, digest bigint, size bigint"), "quality-votes")
    found = votes.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()   # 3 ** labellers rows at most
    patterns, counts = np.array([r["pattern"] for r in found], np.int64), np.array([r["n"] for r in found], float)
    total = counts.sum()
    if not total:
        return Model({}, 0.5, dict.fromkeys(LABELLERS, 0.5), np.zeros(1 << linear.BITS, np.float32), 0.0)
    post, prior, accuracy = expectation_maximisation(patterns, counts)
    posterior = dict(zip(patterns.tolist(), post.tolist()))
    # distinct texts under a share of the hash range, by their number: copies neither crowd nor shrink the sample
    short = votes.filter(F.col("size") <= LONGEST).select("digest", "size").distinct()
    n, size = short.agg(F.count(F.lit(1)), F.sum("size")).first()
    share = min(1.0, sample / n, SAMPLE_BYTES / size) if n else 1.0
    while True:
        few = texts.select("text", digest.alias("digest")).filter(
            (F.octet_length("text") <= LONGEST) & (F.pmod("digest", F.lit(1 << 40)) <= F.lit(int(share * (1 << 40)))))
        row = few.dropDuplicates(["digest"]).groupBy(F.lit(0).alias("g")).applyInArrow(
            lambda t: _fit_scorer(posterior)(t), "weights binary, bias double").first()
        if row or share == 1:
            break
        share = min(1.0, 8 * share)             # no text with words among them
    weights, bias = (np.frombuffer(row["weights"], np.float32), row["bias"]) if row else \
        (np.zeros(1 << linear.BITS, np.float32), 0.0)
    return Model(posterior, prior, dict(zip(LABELLERS, accuracy.tolist())), weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "quality") -> DataFrame:
    """Add ``out``: struct (posterior of the votes, score, kept)."""

    @F.arrow_udf("posterior double, score double, kept boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            cols = [[np.empty(0)], [np.empty(0)]]
            for pattern, slots, per in judged(batch):
                values, at = np.unique(pattern, return_inverse=True)
                post = np.array([model.posterior.get(int(v), model.share_good) for v in values])[at]
                cols[0].append(np.where(per > 0, post, 0.0))
                cols[1].append(np.where(per > 0, _mean_score(model, slots, per), 0.0))
            post, s = (np.concatenate(c) for c in cols)
            yield pa.StructArray.from_arrays([pa.array(post), pa.array(s), pa.array(s >= LIMIT)],
                                             ["posterior", "score", "kept"])

    return docs.withColumn(out, run(F.col(f"`{text}`")))


@query("op10_weak_quality")
def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs)).select(
        "doc_id", F.round("quality.posterior", 6).alias("posterior"), F.round("quality.score", 6).alias("score"),
        F.col("quality.kept").alias("kept"))
