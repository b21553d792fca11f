"""Toxicity by a classifier chain.

The categories are predicted one after the other. Each link is a hashed linear
model over windows of a text (words and their first bytes, see ``linear``)
that also sees the probabilities of all earlier categories. For fitting, those
are out-of-fold: every labelled text gets them from models fitted without
it, so a later link learns from predictions as good as those it will see. The
link used on all documents is fitted on the whole labelled sample.

At most ``SAMPLE`` labelled documents are used, those with the smallest hash
of their id; this bound is a parameter. Texts longer than ``LONGEST`` bytes
teach nothing (they are scored whole), so a fit task is bounded in bytes too.
Of several texts under one doc_id the one of the smallest hash counts, so a rerun
fits the same model. The folds of a link are fitted in
parallel Spark groups of at most that size; the weights (``2**18`` floats
a category) are all that goes to the scoring tasks. Every document is scored
on its whole text. The limit of the last category is set on out-of-fold
predictions, midway between the texts that it separates best, within ``LIMITS``.

The table ``labels`` has one toxicity label; the chain of the query is low
quality, then toxic. ``fit`` takes any list of 0/1 columns.

Cases: a document without label is scored only; null labels are left out of
their category's fit; labels repeated for a document count as their maximum; a
category without both classes predicts its share; null, empty and wordless
texts score as the bias alone decides and are never flagged; equal texts get equal
results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import linear
from quarry.llm.common import query, read, stage, text_buffers
from quarry.llm.words import doc_chunks, hash_words

SAMPLE = 2500            # production parameters
LONGEST = 1 << 18        # bytes of a text that the links are fitted on
FOLDS = 3
PREFIXES = (4, 5)
LIMITS = (0.4, 0.6)
CHAIN = ("low_quality", "toxic")


@dataclass
class Chain:
    categories: tuple[str, ...]
    weights: list[np.ndarray]
    bias: list[float]
    earlier: list[np.ndarray]        # a link's weights of the earlier probabilities
    limit: float                     # of the last category

    def predict(self, slots, words, per_doc) -> np.ndarray:
        """(texts, categories): probabilities, link by link."""
        p = np.zeros((len(per_doc), len(self.categories)))
        for c in range(len(self.categories)):
            m = linear.margins(self.weights[c], self.bias[c], slots, words)
            p[:, c] = linear.sigmoid(linear.segment_max(m, per_doc) + p[:, :c] @ self.earlier[c])
        return p


def features(texts: pa.Array):
    """(first row, slots of each word, words of each window, windows of each text) for runs of texts."""
    data, offsets = text_buffers(texts)
    mask = np.uint64((1 << linear.BITS) - 1)
    for i, j in doc_chunks(offsets):
        part = offsets[i:j + 1]
        words, prefixes = hash_words(data[part[0]:part[-1]], part - part[0], PREFIXES)
        # a word not longer than a prefix is its own prefix
        full = [np.where(p == 0, words.hash, p) ^ np.uint64(k + 1) for k, p in enumerate(prefixes)]
        slots = np.stack([words.hash, *full], axis=1) & mask
        n_words, n_windows = linear.windows(words.per_doc)
        yield i, slots.astype(np.int32), n_words, n_windows


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts to their features."""
    for batch in batches:
        for i, slots, n_words, n_windows in features(batch.column("text")):
            k = len(n_windows)
            ends, lengths = np.cumsum(n_windows), np.cumsum(n_words)
            rows = []
            for d in range(k):
                a, b = ends[d] - n_windows[d], ends[d]
                lo = lengths[a] - n_words[a]
                rows.append((slots[lo:lengths[b - 1]].tobytes(), n_words[a:b].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, k), batch.column("fold").slice(i, k), batch.column("y").slice(i, k),
                 pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                names=["doc_id", "fold", "y", "slots", "words"])


def _unpacked(table: pa.Table):
    words = [np.frombuffer(x, np.int32) for x in table["words"].to_pylist()]
    slots = np.frombuffer(b"".join(table["slots"].to_pylist()), np.int32).reshape(-1, 1 + len(PREFIXES))
    return slots, np.concatenate(words).astype(np.int64), np.array([len(w) for w in words])


def _subset(rows, slots, n_words, n_windows):
    """The features of the texts ``rows`` (ascending)."""
    keep = np.zeros(len(n_windows), bool)
    keep[rows] = True
    window = np.repeat(keep, n_windows)
    return slots[np.repeat(window, n_words)], n_words[window], n_windows[keep]


def _fit_link(category: int, folds: int):
    """One task fits one fold's model, or (task ``folds``) the final one.
    Rows out: the texts' out-of-fold probabilities, or the final weights."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        task = table["task"][0].as_py()
        slots, n_words, n_windows = _unpacked(table)
        fold = table["fold"].to_numpy()
        y = np.array([row[category] if row[category] is not None else np.nan for row in table["y"].to_pylist()], float)
        earlier = np.array(table["p"].to_pylist(), float).reshape(len(y), category)
        train = np.flatnonzero((fold != task) & ~np.isnan(y))
        s, w, n = _subset(train, slots, n_words, n_windows)
        if len(set(y[train])) < 2:
            share = float(np.clip(y[train].mean() if len(train) else 0.0, 1e-6, 1 - 1e-6))
            model = np.zeros(1 << linear.BITS, np.float32), float(np.log(share / (1 - share))), np.zeros(category)
        else:
            model = linear.fit(s, w, np.repeat(y[train], n), np.repeat(earlier[train], n, axis=0))
        weights, bias, of_earlier = model
        if task == folds:
            return pa.table({"doc_id": pa.array([None], pa.int64()), "p": pa.array([None], pa.float64()),
                             "model": pa.array([weights.tobytes()], pa.binary()),
                             "bias": pa.array([[bias, *of_earlier]], pa.list_(pa.float64()))})
        held = np.flatnonzero(fold == task)
        s, w, n = _subset(held, slots, n_words, n_windows)
        p = linear.sigmoid(linear.segment_max(linear.margins(weights, bias, s, w), n) + earlier[held] @ of_earlier) \
            if len(held) else np.empty(0)
        return pa.table({"doc_id": table["doc_id"].take(pa.array(held)), "p": pa.array(p, pa.float64()),
                         "model": pa.nulls(len(held), pa.binary()), "bias": pa.nulls(len(held), pa.list_(pa.float64()))})

    return run


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """The limit with the fewest errors; of several the middle of the widest gap."""
    ok = ~np.isnan(y)
    p, y = p[ok], y[ok]
    if len(set(y)) < 2:
        return 0.5
    order = np.argsort(p)
    p, y = p[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[0.0], p, [1.0]])
    gap = edges[1:] - edges[:-1]
    at = np.lexsort((-gap, errors + np.where(gap > 0, 0, len(y))))[0]
    return float((edges[at] + edges[at + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE,
        folds: int = FOLDS) -> Chain:
    """Fit a chain. ``labels``: doc_id and a 0/1 column per category;
    ``docs``: doc_id and text."""
    chosen = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.array(*[F.max(c).cast("double") for c in categories]).alias("y")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(folds)).cast("int"))
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST
    rows = docs.select("doc_id", "text").filter(short).join(F.broadcast(chosen), "doc_id") \
        .groupBy("doc_id").agg(F.min_by(F.struct("fold", "y", "text"), F.struct(F.xxhash64("text"), "text")).alias("r")) \
        .select("doc_id", "r.*")                          # ``sample`` rows at most
    rows = stage(rows.select("doc_id", "fold", "y", "text").mapInArrow(
        _sampled, "doc_id bigint, fold int, y array<double>, slots binary, words binary"), "toxic-sample")
    known = rows.select("doc_id", F.array().cast("array<double>").alias("p"))
    chain = Chain(tuple(categories), [], [], [], 0.5)
    for c in range(len(categories)):
        tasks = rows.join(known, "doc_id").withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(folds))))
        done = stage(tasks.groupBy("task").applyInArrow(
            _fit_link(c, folds), "doc_id bigint, p double, model binary, bias array<double>"), "toxic-link")
        final = done.filter("model IS NOT NULL").first()
        if final is None:                                 # no labelled text
            chain.weights.append(np.zeros(1 << linear.BITS, np.float32))
            chain.bias.append(-20.0)
            chain.earlier.append(np.zeros(c))
            continue
        chain.weights.append(np.frombuffer(final["model"], np.float32))
        chain.bias.append(final["bias"][0])
        chain.earlier.append(np.array(final["bias"][1:], float))
        held_out = done.filter("doc_id IS NOT NULL").select("doc_id", F.col("p").alias("now"))
        known = stage(known.join(held_out, "doc_id").select("doc_id", F.concat("p", F.array("now")).alias("p")),
                      "toxic-held-out")
    last = known.join(rows.select("doc_id", "y"), "doc_id").select(
        F.try_element_at("p", F.lit(-1)).alias("p"), F.try_element_at("y", F.lit(-1)).alias("y")).collect()
    limit = best_limit(np.array([r["p"] for r in last], float),             # ``sample`` rows at most
                       np.array([np.nan if r["y"] is None else r["y"] for r in last], float))
    chain.limit = float(np.clip(limit, *LIMITS))          # few labels place it badly
    return chain


def score(docs: DataFrame, chain: Chain, text: str = "text", out: str = "chain") -> DataFrame:
    """Add ``out``: struct (p: probabilities in the chain's order, flagged)."""

    @F.arrow_udf("p array<double>, flagged boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ps, some = [np.empty((0, len(chain.categories)))], [np.empty(0, bool)]
            for _, slots, n_words, n_windows in features(batch):
                ps.append(chain.predict(slots, n_words, n_windows))
                some.append(linear.segment_sum(n_words.astype(float), n_windows) > 0)
            p, some = np.concatenate(ps), np.concatenate(some)
            flagged = (p[:, -1] >= chain.limit) & some
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.StructArray.from_arrays([lists, pa.array(flagged)], ["p", "flagged"])

    return docs.withColumn(out, run(F.col(f"`{text}`")))


def fit_on_labels(spark: SparkSession, sf_dir: str) -> Chain:
    """The chain of the query, fitted on the tables of ``sf_dir``."""
    labels = read(spark, sf_dir, "labels").select(
        "doc_id", (F.lit(1) - F.col("quality")).alias("low_quality"), "toxic")
    return fit(read(spark, sf_dir, "documents"), labels, CHAIN)


@query("op9_toxicity_chain")
def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = fit_on_labels(spark, sf_dir)
    scored = score(read(spark, sf_dir, "documents").select("doc_id", "text"), chain)
    return scored.select("doc_id", *[F.round(F.col("chain.p")[i], 6).alias(f"p_{c}")
                                     for i, c in enumerate(chain.categories)],
                         F.col("chain.flagged").alias("toxic"))
