"""ML determinism / separability / scoring schema, and sink semantics."""

import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.operators.ml import (compare_models, fit_final, fold_col, load_model, metrics,
                                 model_features, model_labels, save_model, score,
                                 stratified_split, with_class_weights)
from quarry.session import scratch_path
from quarry.sinks.tables import append, materialize, overwrite, write_part
from quarry.sources.tables import CONTACT_SCHEMA, create_table, part_filter, snapshot_scan


def separable(spark, n=300):
    rows = [(i, float(i % 2), float(i % 2) * 3.0 + (i % 7) / 10.0, float(i % 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, label double, x1 double, x2 double")
    return with_class_weights(df.withColumn("fold", fold_col(F.col("id"))), "label")


def test_split_and_folds_are_stable(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "rare").when(
        F.col("id") == 1, None).when(F.col("id") == 3, "single").otherwise("usual").alias("y"))
    pick = lambda: {r.k: (r.y, r.is_train, r.f) for r in stratified_split(df, "k", "y").withColumn(
        "f", fold_col(F.col("k"))).collect()}
    a = pick()
    assert a == pick() and len(a) == 2000
    held = {}
    for y, train, _ in a.values():
        held[y] = held.get(y, 0) + (not train)
    assert held == {"rare": 1, "usual": 9, None: 0, "single": 0}      # 0.5 % of 200 and of 1,798
    counts = [sum(1 for _, _, f in a.values() if f == k) for k in range(5)]
    assert min(counts) > 300


def test_missing_labels_and_features(spark):
    rows = [(i, None if i % 11 == 0 else ("True" if i % 2 else "False"), None if i % 7 == 0 else float(i % 2) * 4,
             float("nan") if i % 5 == 0 else 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y string, `x 1` double, x2 double")
    weighted = with_class_weights(df, "y").withColumn("fold", fold_col(F.col("id")))
    assert weighted.filter("y IS NULL").select("weight").distinct().collect()[0][0] == 0.0
    ranked = compare_models(weighted, ["x 1", "x2"], label="y", include=["logistic_regression"])
    assert ranked[0][1] > 0.8
    model = fit_final(weighted, "logistic_regression", ["x 1", "x2"], label="y")
    assert model_features(model) == ["x 1", "x2"] and model_labels(model) == ["False", "True"]
    out = score(model, df).collect()
    assert len(out) == 200 and all(0.0 <= r.prediction_score <= 1.0 for r in out)
    assert {r.prediction_label for r in out} <= {"True", "False"}
    with pytest.raises(ValueError):
        with_class_weights(df, "id")


def test_compare_fit_score(spark):
    df = separable(spark)
    ranked = compare_models(df, ["x1", "x2"], include=["logistic_regression", "random_forest"])
    assert len(ranked) == 2 and ranked[0][1] > 0.9
    model = fit_final(df, ranked[0][0], ["x1", "x2"])
    path = save_model(model, scratch_path(spark, "m"))
    loaded = load_model(path)
    out = score(loaded, df)
    assert out.columns == df.columns + ["prediction_label", "prediction_score"]
    assert dict(out.dtypes)["prediction_score"] == "double"
    m = metrics(loaded.transform(df)).first()
    assert m.auc > 0.9 and m.accuracy > 0.9 and m.tp + m.fp + m.fn + m.tn == m.n == 300
    with pytest.raises(KeyError):
        score(loaded, df.drop("x2"))


def test_sinks_roundtrip(spark):
    base = tempfile.mkdtemp(prefix="quarry-sink-")
    empty = create_table(spark, f"{base}/t", CONTACT_SCHEMA)
    assert empty.count() == 0 and empty.schema == CONTACT_SCHEMA
    df = spark.range(10).withColumnRenamed("id", "k")
    overwrite(df, f"{base}/a")
    append(df, f"{base}/a")
    assert spark.read.parquet(f"{base}/a").count() == 20
    write_part(df, f"{base}/p", "r1", 0)
    write_part(df, f"{base}/p", "r1", 0)
    write_part(df.limit(3), f"{base}/p", "r1", 1)
    assert spark.read.parquet(f"{base}/p").count() == 13
    write_part(df.limit(0), f"{base}/p", "r1", 1)               # an empty rerun replaces too
    assert spark.read.parquet(f"{base}/p").count() == 10
    with pytest.raises(ValueError):
        write_part(df, f"{base}/p", "a/b")
    kinds = df.withColumn("kind", F.col("k") % 3)
    overwrite(kinds, f"{base}/q", partition_by=["kind"])
    overwrite(kinds.filter("kind = 1"), f"{base}/q", partition_by=["kind"])
    assert [r.kind for r in spark.read.parquet(f"{base}/q").select("kind").distinct().collect()] == [1]
    assert materialize(df.filter("k > 4")).count() == 5


def test_part_filter_partitions_the_table(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    sizes = [part_filter(df, "k", 4, p).count() for p in range(4)]
    assert sum(sizes) == 1000 and min(sizes) > 150


def test_snapshot_scan_is_pushed_down(spark):
    import datetime as dt
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    q = snapshot_scan(ev, "ts", dt.date(2024, 1, 20), drop=["props"])
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "ts" in plan.split("PushedFilters")[1][:200]
    assert "props" not in q.columns
