"""Operators 8, 9 and 10: brute force, equal rows, several texts of one id,
long texts; staged data of the pipeline."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import op8_rendezvous as shards
from quarry.llm import op9_toxicity_chain as chain
from quarry.llm import op10_weak_quality as quality
from tests.conftest import SF001

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def test_the_highest_score_wins(spark):
    """Each record's shard against the arg-max over all shards in Python."""
    weights = [1.0, 2.0, 0.0, 0.5, 1.0, 4.0]
    rows = docs(spark, [(None if i % 50 == 0 else i, f"t{i}") for i in range(400)])
    hashes = [F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.lit(k)).alias(f"h{k}")
              for k in range(len(weights))]
    for r in shards.assign(rows, "doc_id", weights).select("shard", *hashes).collect():
        scores = []
        for k, w in enumerate(weights):
            u = (((r[f"h{k}"] % (1 << 64)) >> 11) + 0.5) * 2.0 ** -53
            scores.append((-w / math.log(u) if w else -1.0, -k))
        assert r["shard"] == -max(scores)[1]


def test_equal_rows_are_numbered_in_runs(spark):
    """A third of the rows are equal: gapless slots, no window over them."""
    rows = [(None, "")] * 3000 + [(i % 700, f"text {i % 1400}") for i in range(6000)]
    df = docs(spark, rows).select("doc_id", F.length("text").alias("size"), (F.coalesce("doc_id", F.lit(0)) % 3).alias("shard"))
    got = shards.number_rows(df, "shard", ["doc_id", "size"], "slot", buckets=16, run=100)
    assert got.columns == ["doc_id", "size", "shard", "slot"] and got.count() == 9000
    for r in got.groupBy("shard").agg(F.min("slot"), F.max("slot"), F.count("*"), F.count_distinct("slot")).collect():
        assert (r[1], r[2]) == (0, r[3] - 1) and r[3] == r[4]
    assert got.drop("slot").exceptAll(df).count() == 0
    hot = sorted(r.slot for r in got.filter("doc_id IS NULL").collect())
    assert hot == list(range(hot[0], hot[0] + 3000))


def labelled(n, junk="zzkx qqw vvk"):
    return [(i, ("this is a plain line of words about the weather " if i % 2 else junk + " ") * (3 + i % 4)) for i in range(n)]


def test_several_texts_of_one_id_fit_one_model(spark):
    rows = labelled(60) + [(i, f"other text number {i} of this id") for i in range(0, 60, 3)]
    marks = spark.createDataFrame([(i, 1 - i % 2, 1 - i % 2) for i in range(60)], "doc_id long, a int, b int")
    fits = [chain.fit(docs(spark, order).repartition(parts), marks, ("a", "b")) for order, parts in
            ((rows, 1), (rows[::-1], 5), (rows[30:] + rows[:30], 3))]
    for f in fits[1:]:
        assert f.bias == fits[0].bias and f.limit == fits[0].limit
        assert all(np.array_equal(x, y) for x, y in zip(f.weights, fits[0].weights))


def test_long_texts_teach_nothing_and_are_scored(spark, monkeypatch):
    monkeypatch.setattr(chain, "LONGEST", 2000)
    monkeypatch.setattr(quality, "LONGEST", 2000)
    rows = labelled(40)
    long = [(100, "plain words of a very long text " * 400), (101, "zzkx qqw vvk " * 900)]
    marks = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] + [(100, 1), (101, 0)], "doc_id long, a int")
    with_long, without = (chain.fit(docs(spark, r), marks, ("a",)) for r in (rows + long, rows))
    assert np.array_equal(with_long.weights[0], without.weights[0])
    scored = {r.doc_id: r["chain"] for r in chain.score(docs(spark, rows + long), with_long).collect()}
    assert len(scored) == 42 and scored[101]["flagged"] and not scored[100]["flagged"]
    model = quality.fit(docs(spark, rows + long))
    assert {r.doc_id for r in quality.score(docs(spark, rows + long), model).filter("quality.score IS NOT NULL").collect()} == set(range(40)) | {100, 101}


@pytest.mark.parametrize("most", [1, 10 ** 9])
def test_the_sample_is_bounded_in_bytes(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", most)
    model = quality.fit(docs(spark, labelled(200)))
    assert np.isfinite(model.bias) and 0 <= model.share_good <= 1


def test_the_pipeline_leaves_one_copy(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF001)
    left = [x for x in set(os.listdir(folder)) - before if x.startswith(("pipeline-", "near-", "mix-", "toxic-", "quality-", "links", "texts"))]
    assert [x.rsplit("-", 1)[0] for x in left] == ["pipeline-mixing"]
    assert out.count() > 0
