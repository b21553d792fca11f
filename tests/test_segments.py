"""Greedy batches by size against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import reviews
from quarry.operators.ranking import ordered_sums
from quarry.operators.segments import batches_by_size


def walk(sizes, budget, most=None, least=1):
    out, batch, used, n = [], 0, 0, 0
    for s in sizes:
        s = max(s, 1)
        if n and n >= least and (used + s > budget or n == most):
            batch, used, n = batch + 1, 0, 0
        used, n = used + s, n + 1
        out.append(batch)
    return out


@pytest.mark.parametrize("budget,most,least,run", [(10, None, 1, 4), (25, None, 1, 8), (25, 3, 1, 8), (10, None, 2, 4), (300, 5, 2, 64), (7, None, 1, 4096)])
def test_equals_the_walk(spark, budget, most, least, run):
    rng = random.Random(budget + run)
    groups = {g: [rng.choice([0, 1, 2, 3, 5, 9, 40 if run < 64 else 3]) for _ in range(n)] for g, n in (("a", 150), (None, 70), ("b", 1), ("", 9))}
    rows = [(g, i, s, "x") for g, sizes in groups.items() for i, s in enumerate(sizes)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, s int, batches string")
    got = batches_by_size(df, ["g"], ["i"], "s", budget, most, least, segment_rows=run)
    assert got.columns == ["g", "i", "s", "pos", "batch", "batches"]
    for g, sizes in groups.items():
        mine = sorted((r.i, r.pos, r.batch, r.batches) for r in got.collect() if r.g == g)
        expected = walk(sizes, budget, most, least)
        assert mine == [(i, i, b, expected[-1] + 1) for i, b in enumerate(expected)]


def test_no_batch_is_over_the_budget_unless_one_row_is(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(1, i, rng.randrange(1, 120)) for i in range(800)], "g int, i int, s int")
    sums = batches_by_size(df, ["g"], ["i"], "s", 100, segment_rows=32).groupBy("batch").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    assert sums.filter("s > 100 AND n > 1").count() == 0


def test_empty_and_wrong_limits(spark):
    df = spark.createDataFrame([], "g int, i int, s int")
    assert batches_by_size(df, ["g"], ["i"], "s", 5).count() == 0
    with pytest.raises(ValueError):
        batches_by_size(df, ["g"], ["i"], "s", 0)


def test_sums_before(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", None, "z"]), i, rng.randrange(-5, 50)) for i in range(900)]
    got = ordered_sums(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], ["i"], {"v": "before"}, num_partitions=7).collect()
    total = {}
    expected = {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        expected[i] = total.get(g, 0)
        total[g] = expected[i] + v
    assert {r.i: r.before for r in got} == expected


def test_prompts_are_bounded(spark):
    """No summary prompt holds more than the budget, unless one review does;
    later rounds take two at least and end."""
    rows = [("g", f"f{i:03d}", "x" * (i * 37 % 900)) for i in range(60)] + [("g", "large", "y" * 5000)]
    df = spark.createDataFrame(rows, "grp string, file_name string, response string")
    answer = "s" * 700

    def model(prompt):
        body = prompt.split("=== reviews, one block per file ===\n\n", 1)[1]
        blocks = body.count("--- Review for ")
        if blocks > 1 and len(body) - 1 > 2000 and not (blocks == 2 and "Review for summary_" in body):
            raise ValueError(f"{len(body)} characters in {blocks} blocks")
        return answer

    out = reviews.consolidate(df, model, ["grp"], fan_in=8, budget=2000).collect()
    assert len(out) == 1 and out[0].summary == answer and out[0].levels >= 3


def test_texts_are_not_ranked(spark):
    """Batching shuffles names and lengths; texts meet their batch by number."""
    df = spark.createDataFrame([("g", f"f{i}", "t" * 10) for i in range(50)], "grp string, file_name string, response string")
    for budget in (None, 100):
        b = reviews.consolidation_batches(df, ["grp"], "file_name", "response", 8, budget)
        assert b.agg(F.sum("n_reviews")).first()[0] == 50
        names = sorted(f"f{i}" for i in range(50))
        first = b.filter("batch = 0").first()
        assert [x.split(" ---")[0] for x in first["text"].split("--- Review for ")[1:]] == names[:first["n_reviews"]]
