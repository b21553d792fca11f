"""Operators 9 and 10 on held-out labels, the pipeline stage by stage, and
the entry point's guard."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quarry.llm import op3_temperature_mixing as mix
from quarry.llm import op9_toxicity_chain as toxicity
from quarry.llm import op10_weak_quality as quality
from quarry.llm.common import stage
from tests.conftest import SF01, SF001

from .test_near_duplicates import brute

SF1 = "/root/testdata/sf0.1"


def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_chain_on_held_out_labels(spark):
    docs, labels = tables(spark, SF1)
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    held = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(2)) == 0
    chain = toxicity.fit(docs, labels.filter(~held), ["low_quality", "toxic"])
    assert len(chain.weights) == 2 and len(chain.earlier[1]) == 1
    # the junk of this table lost its toxic words when it was made, so its labels cannot be learned
    plain = labels.filter(held & (F.col("low_quality") == 0))
    got = toxicity.score(docs.join(plain, "doc_id"), chain).select("toxic", "chain.flagged").toPandas()
    caught, false = got.flagged[got.toxic == 1].mean(), got.flagged[got.toxic == 0].mean()
    assert caught > 0.95 and false < 0.01, (caught, false)


def test_chain_edges(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.choice([5, 60, 300]))]
        if i % 4 == 0:
            text[rng.randrange(len(text))] = "vileword"
        rows.append((i, " ".join(text), 1, 2))
    rows += [(900, None, 1, 2), (901, "", 1, 2), (902, " \n", 1, 2), (None, "w1 w2", 1, 2), (0, rows[0][1], 1, 2),
             (903, "w1 " * 50000 + "vileword " + "w2 " * 50000, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p int, y int")
    labels = spark.createDataFrame(
        [(i, int(i % 4 == 0), None if i % 3 else 0) for i in range(240)] + [(0, 0, 0), (5000, 1, 1), (None, 1, 1), (900, None, None)],
        "doc_id long, toxic int, none int")
    chain = toxicity.fit(docs, labels, ["none", "toxic"])
    got = {(r.doc_id, r.text): r.chain for r in toxicity.score(docs, chain).collect()}
    assert len(got) == len(rows) - 1
    right = sum(got[i, t].flagged == (i % 4 == 0) for i, t, *_ in rows[:240])
    assert right >= 235
    assert not any(got[i, t].flagged for i, t in ((900, None), (901, ""), (902, " \n")))
    assert got[903, rows[-1][1]].flagged                                   # one window of a long text decides
    assert toxicity.score(docs.limit(0), chain).count() == 0
    empty = toxicity.fit(docs, labels.limit(0), ["none", "toxic"])
    assert not any(r.chain.flagged for r in toxicity.score(docs, empty).collect())
    assert toxicity.best_limit(np.array([0.1, 0.2, 0.8]), np.array([0, 0, 1.0])) == pytest.approx(0.5)


def test_out_of_fold_predictions_reach_the_next_link(spark):
    """The second category equals the first one, which its own words do not show."""
    rows = [(i, ("red " if i % 2 else "blue ") + f"n{i} n{i + 1}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(300)], "doc_id long, a int, b int")
    chain = toxicity.fit(docs, labels, ["a", "b"])
    assert chain.earlier[1][0] > 0


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_weak_labels_against_the_labels(spark, sf):
    _, labels = tables(spark, sf)
    got = quality.op10_weak_quality(spark, sf).join(labels, "doc_id").toPandas()
    assert got.kept[got.quality == 1].mean() > 0.99
    assert got.kept[got.quality == 0].mean() < 0.2


def test_votes_and_edges(spark):
    clean = " ".join(["This is a plain sentence about several quite different things."] +
                     [f"Number words like item{chr(97 + i % 26)}{chr(97 + i // 26)} fill it." for i in range(60)])
    rows = [(1, clean), (2, "BUY!! NOW!! BUY!! NOW!! " * 30), (3, "a | b | c | d | " * 30), (4, "same " * 200), (5, None), (6, ""),
            (7, " \n"), (8, clean + " " + clean.replace("item", "thing") * 40), (1, clean)]
    docs = spark.createDataFrame([(i, t, "q", 1.0) for i, t in rows], "doc_id long, text string, quality string, score double")
    corpus = docs.unionByName(spark.read.parquet(f"{SF01}/documents.parquet").select(
        "doc_id", "text", F.lit("q").alias("quality"), F.lit(1.0).alias("score")))
    model = quality.fit(corpus)
    got = [(r.doc_id, r.verdict) for r in quality.score(docs, model, out="verdict").collect()]
    kept = {i: v.kept for i, v in got}
    assert len(got) == len(rows)
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False, 8: True}
    assert all(v.score == 0 for i, v in got if i in (5, 6, 7))
    assert 0.5 < model.share_good < 1 and all(a > 0.5 for a in model.accuracy.values())
    nothing = quality.fit(docs.limit(0))
    assert quality.score(docs.limit(0), nothing).count() == 0


def test_copies_do_not_shrink_the_sample(spark):
    docs = spark.createDataFrame([(" ".join(f"word{chr(97 + i % 40 % 26)}{i % 40} is here" for _ in range(30)),) for i in range(4000)],
                                 "text string")
    model = quality.fit(docs, sample=20)
    assert np.any(model.weights) and model.bias != 0
    assert quality.fit(docs, sample=1).bias != 0            # an empty sample fits nothing
    assert len(quality.fit(spark.createDataFrame([("",), (" ",)], "text string")).posterior) == 0


def test_expectation_maximisation_recovers_shares_and_accuracies():
    """Each kind of junk is known to two labellers, each right on 90 % of it."""
    rng = np.random.default_rng(0)
    n, size = len(quality.LABELLERS), 20000
    kind = np.where(rng.random(size) < 0.8, -1, rng.integers(0, n // 2, size))
    votes = np.where(rng.random((size, n)) < 0.002, 0, 1)                        # false alarms
    for k in range(n // 2):
        votes[:, 2 * k:2 * k + 2] = np.where((kind == k)[:, None], (rng.random((size, 2)) > 0.9), votes[:, 2 * k:2 * k + 2])
    votes[rng.random(votes.shape) < 0.05] = 2
    patterns, at, counts = np.unique(votes @ 3 ** np.arange(n), return_inverse=True, return_counts=True)
    post, share, accuracy = quality.expectation_maximisation(patterns, counts.astype(float))
    assert ((post[at] > 0.5) == (kind < 0)).mean() > 0.95 and abs(share - 0.8) < 0.05
    true = np.array([((votes[:, j] == (kind < 0)) & (votes[:, j] < 2)).sum() / (votes[:, j] < 2).sum() for j in range(n)])
    assert np.abs(np.array(accuracy) - true).max() < 0.05


# -- the pipeline

def test_pipeline_stages(spark):
    docs, labels = tables(spark, SF001)
    extra = spark.createDataFrame(
        [(90001, None, None, None, None), (90002, "", "en", "src0", 0), (None, "A text without any number of its own here.", "en", None, 42),
         (90003, "A text without any number of its own here.", "en", None, 42)], docs.schema)
    columns = docs.columns
    docs = stage(docs.unionByName(extra), "test-docs")
    before = docs
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, before, SF001), f"test-{name}")
        if name != "bpe":
            assert after.columns == columns
        old, new = before.toPandas(), after.toPandas()
        ids = lambda f: set(f.doc_id.dropna().astype(int))
        assert ids(new) <= ids(old)
        known = labels.toPandas().set_index("doc_id")
        if name == "quality":
            clean = ids(old) & set(known.index[known.quality == 1])
            assert len(clean - ids(new)) <= 0.02 * len(clean) and {90001, 90002}.isdisjoint(ids(new))
        elif name == "toxicity":
            clean = ids(old) & set(known.index[known.toxic == 0])
            assert len(clean - ids(new)) <= 0.02 * len(clean)
            toxic = ids(old) & set(known.index[known.toxic == 1])
            assert len(toxic & ids(new)) <= 0.5 * len(toxic)                # a tiny labelled table
        elif name == "near_dedup":
            rows = [(None if i != i else int(i), t) for i, t in zip(old.doc_id, old.text)]
            expected = [i for i, _, _, kept in brute(rows, 5, (80, 100)) if kept]
            assert sorted(ids(new)) == sorted(i for i in expected if i is not None)
        elif name == "mixing":
            drawn = mix.draw(before, max_repeats=corpus_pipeline.MAX_REPEATS).count()
            assert len(new) == drawn >= len(old) and ids(new) == ids(old)
        else:
            assert len(new) == len(old)
        before = after


def test_pipeline_runs_on_an_empty_table(spark):
    docs, _ = tables(spark, SF001)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), SF001).count() == 0, name


def test_entry_lists_the_corpus_queries():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names


def test_entry_works_without_the_corpus_operators(monkeypatch):
    import builtins
    real = builtins.__import__

    def missing(name, *args, **kw):
        if name.startswith("quarry.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", missing)
    names = set(entry.queries())
    assert "pipeline" not in names and not any(x.startswith("op") for x in names) and len(names) >= 48
