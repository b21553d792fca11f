"""Order statistic of the split, metric values, histogram boosting and
synthetic minority rows, against plain statements of the rules."""

import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quarry.operators import minority, ml
from quarry.operators.boosting import HistogramBoosting, HistogramBoostingModel, best_split
from quarry.session import scratch_path


def digest(k):
    return hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()


def test_split_holds_out_the_smallest_hashes(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a"] * 20 + ["b"] * 3 + [None])) for i in range(5000)] + [(5001, "one")]
    df = spark.createDataFrame(rows, "k long, y string")
    for per_mille in (995, 900, 500):
        got = {r.k: r.is_train for r in ml.stratified_split(df, "k", "y", per_mille).collect()}
        for y in {y for _, y in rows}:
            mine = sorted((digest(k), k) for k, z in rows if z == y)
            held = 0 if len(mine) < 2 else max(1, math.floor(len(mine) * (1000 - per_mille) / 1000 + 0.5))
            assert {k for _, k in mine[:held]} == {k for _, k in mine if not got[k]}, (per_mille, y)


def test_split_has_no_shuffle_of_rows_and_keeps_keys_together(spark):
    df = spark.createDataFrame([(i // 3, "x", "wide" * 10) for i in range(3000)] + [(None, "x", "n")], "k long, y string, w string")
    out = ml.stratified_split(df, "k", "y", 900)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    sides = out.groupBy("k").agg(F.count_distinct("is_train").alias("n"))
    assert sides.filter("n > 1").count() == 0 and out.count() == 3001
    held = out.filter("NOT is_train").count()
    assert 300 <= held <= 303


def test_split_of_many_classes_and_of_nothing(spark):
    with pytest.raises(ValueError):
        ml.stratified_split(spark.range(500).withColumn("y", F.col("id")).unionByName(spark.range(500).withColumn("y", F.col("id"))), "id", "y").count()
    assert ml.stratified_split(spark.createDataFrame([], "k long, y string"), "k", "y").count() == 0


def brute(rows):
    pos = [s for s, y, _ in rows if y == 1]
    neg = [s for s, y, _ in rows if y == 0]
    tp = sum(y == 1 and p == 1 for _, y, p in rows)
    fp = sum(y == 0 and p == 1 for _, y, p in rows)
    fn, tn, n = len(pos) - tp, len(neg) - fp, len(rows)
    div = lambda a, b: a / b if b else None
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / n ** 2
    return {"n": n, "tp": tp, "fp": fp, "fn": fn, "tn": tn, "auc": div(sum((a > b) + (a == b) / 2 for a in pos for b in neg), len(pos) * len(neg)),
            "accuracy": (tp + tn) / n, "precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn),
            "kappa": div((tp + tn) / n - chance, 1 - chance),
            "mcc": div(tp * tn - fp * fn, math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))}


def test_metric_values(spark):
    rng = random.Random(2)
    rows = []
    for g in ("a", "b", "c", "one class", None):
        for _ in range(150):
            y = 1 if g == "one class" else int(rng.random() < 0.3)
            s = rng.choice([0.1, 0.2, 0.2, 0.5, rng.random()]) + (0.2 * y if g == "a" else 0)
            rows.append((g, s, y, int(s > 0.45)))
    rows += [("a", 0.9, None, 1)] * 5                                          # without a label: left out
    df = spark.createDataFrame(rows, "g string, s double, y int, p int")
    for r in ml.binary_metrics(df, "y", "p", "s", by=["g"]).collect():
        expected = brute([(s, y, p) for g, s, y, p in rows if g == r.g and y is not None])
        for name, value in expected.items():
            assert (r[name] is None) == (value is None) and (value is None or r[name] == pytest.approx(value, abs=1e-12)), (r.g, name)
    whole = ml.binary_metrics(df, "y", "p", "s").collect()
    assert len(whole) == 1 and whole[0].n == 750
    none = ml.binary_metrics(df.limit(0), "y", "p", "s").collect()
    assert len(none) == 1 and none[0].n == 0 and none[0].auc is None


def test_folds_mean_and_deviation(spark):
    rows = [("m", f, (i * 7 % 10) / 10, i % 2, int(i * 7 % 10 > 4)) for f in range(4) for i in range(20 + f)]
    cv = ml.binary_metrics(spark.createDataFrame(rows, "model string, fold int, s double, y int, p int"), "y", "p", "s", by=["model", "fold"])
    table = {r.stage: r for r in ml.spread_of_folds(cv).collect()}
    each = [brute([(s, y, p) for _, g, s, y, p in rows if g == f])["auc"] for f in range(4)]
    assert [table[f"cv fold {f}"].auc for f in range(4)] == pytest.approx(each)
    assert table["cv mean"].auc == pytest.approx(statistics.mean(each)) and table["cv sd"].auc == pytest.approx(statistics.stdev(each))


def assembled(spark, rows, names):
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in ["label", *names]))
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(df)


def test_best_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    g, h = rng.normal(size=(3, 8)), rng.random((3, 8)) + 0.1
    g[1:] = g[1:] / g[1:].sum(1, keepdims=True) * g[0].sum()
    h[1:] = h[1:] / h[1:].sum(1, keepdims=True) * h[0].sum()
    gain = lambda a, b: a * a / (b + 1.0)
    every = [(0.5 * (gain(g[f, :b + 1].sum(), h[f, :b + 1].sum()) + gain(g[f, b + 1:].sum(), h[f, b + 1:].sum()) - gain(g[f].sum(), h[f].sum())), -f, -b)
             for f in range(3) for b in range(7) if min(h[f, :b + 1].sum(), h[f, b + 1:].sum()) >= 0.5]
    top = max(every)
    found = best_split(g, h, 1.0, 0.5)
    assert (top[0] <= 0 and found is None) or (found[0] == pytest.approx(top[0]) and found[1:] == (-top[1], -top[2]))


def test_boosting_learns_what_one_feature_cannot(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(1500):
        a, b = rng.random(), rng.random()
        rows.append((float((a > 0.5) != (b > 0.3)), a, b, rng.random()))
    df = assembled(spark, rows, "abc")
    model = HistogramBoosting(maxIter=10, maxLeaves=6).fit(df)
    out = model.transform(df)
    m = ml.binary_metrics(ml._scores(out), "label", "prediction", "__score").first()
    assert m.auc > 0.97 and m.accuracy > 0.93
    p = out.select("prediction", F.col("probability").cast("string")).first()
    assert p[0] in (0.0, 1.0) and out.columns[-3:] == ["rawPrediction", "probability", "prediction"]

    def leaves(t):
        return 1 if "value" in t else leaves(t["left"]) + leaves(t["right"])

    assert all(2 <= leaves(t) <= 6 for t in model.tree_list())
    again = HistogramBoosting(maxIter=10, maxLeaves=6).fit(df.repartition(7))
    assert again.tree_list() == model.tree_list()                    # neither order nor tasks matter
    path = scratch_path(spark, "booster")
    model.write().overwrite().save(path)
    back = HistogramBoostingModel.load(path)
    assert back.tree_list() == model.tree_list()
    assert back.transform(df).select("prediction").exceptAll(out.select("prediction")).count() == 0


def test_boosting_edges(spark):
    constant = assembled(spark, [(float(i % 2), 1.0) for i in range(40)], "a")
    assert HistogramBoosting().fit(constant).transform(constant).filter("prediction NOT IN (0, 1)").count() == 0
    single = assembled(spark, [(0.0, float(i)) for i in range(40)], "a")
    assert HistogramBoosting().fit(single).transform(single).filter("prediction = 1").count() == 0
    with pytest.raises(ValueError):
        HistogramBoosting().fit(assembled(spark, [(2.0, 1.0)], "a"))
    with pytest.raises(ValueError):
        HistogramBoosting().fit(constant.limit(0))


def test_boosting_takes_weights(spark):
    df = spark.createDataFrame([(float(i % 4 == 0), float(i % 3), 9.0 if i % 4 == 0 else 1.0) for i in range(300)], "label double, a double, w double")
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    light = HistogramBoosting().fit(df).transform(df).filter("prediction = 1").count()
    heavy = HistogramBoosting(weightCol="w").fit(df).transform(df).filter("prediction = 1").count()
    assert light == 0 and heavy == 300


def test_nearest_of_a_class(spark, monkeypatch):
    monkeypatch.setattr(minority, "BLOCK_ROWS", 16)
    rng = random.Random(5)
    rows = [(rng.choice([0, 1, None]), n, [float(rng.randrange(6)), float(rng.randrange(6))]) for n in range(160)]
    got = {}
    for r in minority.nearest_of_class(spark.createDataFrame(rows, "cls int, n long, x array<double>"), 4).collect():
        got.setdefault(r.n, []).append((r.place, r.distance, r.other))
    for cls, n, x in rows:
        every = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), m) for c, m, y in rows if c == cls and m != n)[:4]
        assert [(d, m) for _, d, m in sorted(got[n])] == every


def test_minority_is_filled_up(spark):
    rng = random.Random(6)
    rows = [(i, "big", rng.random(), None) for i in range(200)] + [(1000 + i, "small", 5 + rng.random(), float(i)) for i in range(30)]
    rows += [(2000, "single", 9.0, 9.0), (3000, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, y string, a double, b double")
    out = minority.synthetic_minority(df, "k", "y", ["a", "b"], k=3)
    assert out.columns == ["y", "a", "b", "is_synthetic"]
    found = out.collect()
    n = {}
    for r in found:
        n[r.y, r.is_synthetic] = n.get((r.y, r.is_synthetic), 0) + 1
    assert n == {("big", False): 200, ("small", False): 30, ("small", True): 170, ("single", False): 1, ("single", True): 199}
    real = [(a, b) for _, y, a, b in rows if y == "small"]
    for r in found:
        if r.y == "single":
            assert (r.a, r.b) == (9.0, 9.0)
        if r.y == "small" and r.is_synthetic:              # between a member and one of its three nearest
            on = False
            for p in real:
                near = sorted((q for q in real if q != p), key=lambda q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2)[:3]
                for q in near:
                    cross = (q[0] - p[0]) * (r.b - p[1]) - (q[1] - p[1]) * (r.a - p[0])
                    on |= abs(cross) < 1e-9 and min(p[0], q[0]) - 1e-9 <= r.a <= max(p[0], q[0]) + 1e-9
            assert on
    again = minority.synthetic_minority(df.repartition(5), "k", "y", ["a", "b"], k=3)
    assert again.exceptAll(out).count() == 0
