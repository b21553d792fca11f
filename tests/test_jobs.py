"""End-to-end jobs on fixture folders and the test tables."""

import os
import tempfile

from pyspark.sql import functions as F

from quarry.operators.reviews import stub_reviewer
from quarry.plans.jobs import review_job, score_job, split_diffs_job, train_job

from .conftest import SF001

DIFF = ("diff --git a/x/a.py b/x/a.py\n--- a/x/a.py\n+++ b/x/a.py\n"
        "@@ -1,0 +1,1 @@ def f():\n+one two three\n@@ -5,0 +6,2 @@\n+four\n+five six\n")


def test_split_diffs_job(spark):
    src = tempfile.mkdtemp(prefix="quarry-diffs-")
    for name in ("pr1.diff", "pr2.diff"):
        with open(os.path.join(src, name), "w") as fh:
            fh.write(DIFF)
    out = tempfile.mkdtemp(prefix="quarry-chunks-")
    split_diffs_job(spark, src, out, budget=12)
    back = spark.read.parquet(out)
    assert sorted(r.diff_id for r in back.select("diff_id").distinct().collect()) == ["pr1.diff", "pr2.diff"]
    assert back.filter(F.col("level") == 3).count() == 4


def test_review_job(spark):
    src = tempfile.mkdtemp(prefix="quarry-rev-src-")
    for name, text in [("a.py", "x = 1\n"), ("a.sql", "select 1"), ("b.py", ""), ("c.py", "oops!")]:
        with open(os.path.join(src, name), "w") as fh:
            fh.write(text)
    out = review_job(spark, src, tempfile.mkdtemp(prefix="quarry-rev-out-"), stub_reviewer("!"), fan_in=2)
    assert out["reviews"].count() == 3 and out["review_errors"].count() == 1
    assert out["findings"].count() == 0 and out["top_findings"].count() == 0
    s = out["summary"].collect()
    assert len(s) == 1 and s[0].levels == 2


def test_review_job_with_findings_and_unreadable_files(spark):
    src = tempfile.mkdtemp(prefix="quarry-rev-src-")
    for name, data in [("a b%20.py", b"x = 1"), ("__init__.py", b"y = 2"), ("bad.py", b"f\xff\x00"), ("odd.sql", b"select 2")]:
        with open(os.path.join(src, name), "wb") as fh:
            fh.write(data)

    def model(prompt):
        import json
        if "select" in prompt:
            return '{"summary": null, "detailed_findings": [], "key_recommendations": "oops"}'
        found = [{"file_path": "f", "severity": s, "line_number": n, "finding": "text"} for s, n in
                 (("Low", 3.0), ("Critical", 4), ("Awful", 5), ("High", 1.5))]
        return json.dumps({"summary": "s", "detailed_findings": found, "key_recommendations": []})

    out = review_job(spark, src, tempfile.mkdtemp(prefix="quarry-rev-out-"), model)
    assert sorted(r.file_name for r in out["reviews"].collect()) == ["__init__.py", "a b%20.py", "odd.sql"]
    found = out["findings"].collect()
    assert sorted((r.file_name, r.severity, r.line_number) for r in found) == [
        (f, s, n) for f in ("__init__.py", "a b%20.py") for s, n in (("Critical", 4), ("Low", 3))]
    assert out["top_findings"].count() == 4
    errors = sorted((r.file_name, r.error) for r in out["review_errors"].collect())
    assert [e[0] for e in errors] == ["__init__.py", "__init__.py", "a b%20.py", "a b%20.py", "bad.py", "odd.sql"]
    assert "UTF-8" in errors[4][1] and out["summary"].count() == 1


def test_train_and_score_jobs(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    from quarry.operators.ml import FEATURES, doc_features
    data = labels.join(doc_features(docs), "doc_id")
    tmp = tempfile.mkdtemp(prefix="quarry-train-")
    best, table = train_job(spark, data, "doc_id", "quality", FEATURES, f"{tmp}/model",
                            f"{tmp}/metrics", include=["logistic_regression"])
    assert best == "logistic_regression" and {r.stage for r in table.collect()} == {*(f"cv fold {k}" for k in range(5)), "cv mean", "cv sd", "holdout", "train"}
    mean, folds = (table.filter(F.col("stage").rlike(s)).agg(F.avg("auc")).first()[0] for s in ("cv mean", "cv fold"))
    assert abs(mean - folds) < 1e-12 and 0 <= mean <= 1
    for rerun in range(2):
        score_job(data, f"{tmp}/model", f"{tmp}/pred", "r1", keep=["doc_id"])
    assert spark.read.parquet(f"{tmp}/pred").count() == data.count()


def test_click_dataset_and_predictions(spark):
    import datetime as dt

    from quarry.operators.clean import CleanSpec
    from quarry.plans.jobs import ClickDatasetSpec, click_dataset, predictions_job

    as_of = dt.date(2024, 3, 31)
    snap_ts = dt.datetime(2024, 3, 1, 8, 30)         # as_of - 30 days
    rows = []
    for i in range(40):
        rows.append((i, snap_ts, 0, "x" if i % 4 else None, i if i % 3 else None,
                     None if i < 38 else 1, dt.date(2024, 2, 1 + i % 20), dt.date(2024, 1, 1 + i % 20),
                     "Y" if i % 2 else "N"))
    rows.append((99, snap_ts - dt.timedelta(days=1), 0, "x", 1, 1, None, None, "Y"))   # other day
    rows.append((98, snap_ts, 1, "x", 1, 1, None, None, "Y"))                          # bad email
    snap = spark.createDataFrame(rows, "registration_id long, snapshot_ts timestamp, bad_email int, "
                                       "segment string, iru_count long, rare long, last_login date, "
                                       "prior_login date, flag string")
    clicks = spark.createDataFrame([(i, dt.datetime(2024, 3, 10)) for i in range(0, 40, 5)],
                                   "reg_id long, event_date timestamp")
    feat = spark.createDataFrame([(i, i * 2) for i in range(0, 40, 2)], "registration_id long, n long")
    spec = ClickDatasetSpec(
        as_of=as_of, key="registration_id", snapshot_ts="snapshot_ts",
        scan_where=F.col("bad_email") == 0, scan_drop=["bad_email"],
        clean=CleanSpec(snapshot_day=as_of - dt.timedelta(days=30), last_login="last_login",
                        prior_login="prior_login", flag_like=("flag",)))
    out = click_dataset(snap, clicks, [feat], spec, tempfile.mkdtemp(prefix="quarry-ds-") + "/ds")
    got = out.collect()
    assert len(got) == 40                                   # one snapshot day, good emails only
    assert "rare" not in out.columns                        # 95 % NULL -> dropped
    assert "n" in out.columns                               # 50 % NULL feature kept, NULLs kept
    assert sum(r.clicked_or_not == "True" for r in got) == 8
    assert all(r.segment is not None and r.iru_count is not None for r in got)

    # the dataset as it is: a 'True' / 'False' label and a feature with NULLs
    tmp = tempfile.mkdtemp(prefix="quarry-m-")
    best, table = train_job(spark, out, "registration_id", "clicked_or_not", ["iru_count", "n"], f"{tmp}/m",
                            include=["logistic_regression"], trained_ids_path=f"{tmp}/ids")
    assert {r.stage.split(" ")[0] for r in table.collect()} == {"cv", "train", "holdout"}
    trained = spark.read.parquet(f"{tmp}/ids")
    assert trained.count() == 38                            # one of each class is held out
    pred = predictions_job(out, trained, "registration_id", f"{tmp}/m", f"{tmp}/p", metrics_path=f"{tmp}/pm")
    rows = pred.collect()
    assert len(rows) == 2 and all(0 <= r.prediction_score <= 1 and r.prediction_label in ("True", "False") for r in rows)
    assert sorted((r.stage, r.n) for r in spark.read.parquet(f"{tmp}/pm").collect()) == [("test", 2), ("train", 38)]


def test_command_line(spark):
    from quarry.__main__ import main

    src = tempfile.mkdtemp(prefix="quarry-cli-")
    with open(os.path.join(src, "x.diff"), "w") as fh:
        fh.write(DIFF)
    with open(os.path.join(src, "a.py"), "w") as fh:
        fh.write("print(1)\n")
    out = tempfile.mkdtemp(prefix="quarry-cli-out-")
    assert main(["split-diffs", src, f"{out}/chunks", "--budget", "12"]) == 0
    assert spark.read.parquet(f"{out}/chunks").count() == 2
    assert main(["review", src, f"{out}/rev", "--model",
                 "quarry.operators.reviews:stub_reviewer()"]) == 0
    assert spark.read.parquet(f"{out}/rev/summary").count() == 1
