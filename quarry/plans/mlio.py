"""Model training / scoring and table / file round trips (q44-q45, q47-q49, q53).

Training data: ``labels.quality`` as the target with numeric features of
the labelled document (``documents``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.boosting import HistogramBoosting
from quarry.operators.diffs import create_chunks, is_reviewable, read_chunks, write_chunks
from quarry.operators.ml import (FEATURES, binary_metrics, candidates, cross_validate, doc_features,
                                 fit_final, fold_col, load_model, metrics, ranked_models, save_model,
                                 score, spread_of_folds, stratified_split, with_class_weights)
from quarry.operators.minority import synthetic_minority
from quarry.operators.relational import remove_keys
from quarry.plans.click import ASSEMBLED_SQL, MEMBER_SPEC, emails, renewals, slots, txns
from quarry.plans.fixtures import DIFF_LINES_SQL, E_ASOF, H, Tables, diffs, members
from quarry.plans.jobs import ClickDatasetSpec, click_dataset, predictions_job, train_job
from quarry.plans.registry import query
from quarry.plans.text import (CHUNKS_SQL, FOLD_SQL, LEVEL_BUDGET, SOURCE_FILES_SQL, chunk_digests, source_files,
                               stratified_sql)
from quarry.session import scratch_path
from quarry.sinks.tables import append, materialize, overwrite, write_part
from quarry.sources.tables import CONTACT_SCHEMA, create_table, part_of
from quarry.sources.text import read_diffs, read_patches, read_text_dir, write_text_files


def labelled(t: Tables) -> DataFrame:
    """Features + ``label``, ``fold``, class ``weight`` and the split
    ``is_train``. The join runs first, so text features are computed for
    labelled rows only."""
    joined = t.labels.select("doc_id", F.col("quality").cast("double").alias("label")) \
        .join(t.documents.select("doc_id", "text"), "doc_id")
    df = doc_features(joined, keep=("doc_id", "label")).withColumn("fold", fold_col(F.col("doc_id")))
    return stratified_split(with_class_weights(df, "label"), "doc_id", "label")


def facts(spark, **named) -> DataFrame:
    """Rows (fact, n) from one-row frames ``(n)``."""
    out = None
    for fact, df in named.items():
        row = df.select(F.lit(fact).alias("fact"), F.col("n").cast("bigint").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def rows(df: DataFrame, where=None) -> DataFrame:
    return (df if where is None else df.filter(where)).agg(F.count(F.lit(1)).alias("n"))


_LABELLED_SQL = f"""labelled AS (SELECT l.doc_id, quality FROM labels l JOIN documents USING (doc_id)),
split AS ({stratified_sql('labelled', 'doc_id', 'quality')})"""


@query("q44_train_metrics", f"""WITH {_LABELLED_SQL},
folded AS (SELECT {FOLD_SQL.format(k='doc_id')} AS fold, quality AS y FROM split WHERE is_train),
folds AS (SELECT fold, count(*) AS n FROM folded a GROUP BY fold HAVING count(DISTINCT y) > 1
          AND (SELECT count(DISTINCT y) FROM folded b WHERE b.fold <> a.fold) > 1)
SELECT 'families compared' AS fact, CAST(4 AS BIGINT) AS n
UNION ALL SELECT 'folds measured', 4 * count(*) FROM folds
UNION ALL SELECT 'scores from 0 to 1, best first', 4
UNION ALL SELECT 'best mean score above chance', 1
UNION ALL SELECT 'rows in the confusion counts of the folds', 4 * sum(n)::BIGINT FROM folds
UNION ALL SELECT 'train rows in confusion counts', count(*) FROM split WHERE is_train
UNION ALL SELECT 'holdout rows in confusion counts', count(*) FROM split WHERE NOT is_train
UNION ALL SELECT 'final rows in confusion counts', count(*) FROM split
UNION ALL SELECT 'good rows among them', count(*) FROM split WHERE quality = 1""")
def q44(spark, root):
    """Compare candidates by 5-fold AUC on the training split, refit the
    best on every row, and measure it: what holds of the metrics tables
    whatever the models learn (q58 checks the metrics' values)."""
    data = materialize(labelled(Tables(spark, root)), "train-data")
    train, hold = data.filter("is_train"), data.filter("NOT is_train")
    cv = cross_validate(train, FEATURES)
    ranked = ranked_models(cv, candidates("label", "weight"))
    best = ranked[0][0]
    fitted, final = fit_final(train, best, FEATURES), fit_final(data, best, FEATURES)
    means = cv.groupBy("model").agg(F.avg("auc").alias("auc"))
    inside = F.col("auc").between(0.0, 1.0) & (F.col("auc") <= ranked[0][1])
    whole = lambda m: m.filter(F.col("n") == F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    last = materialize(metrics(final.transform(data), model=best, stage="final"), "final-metrics")
    return facts(spark, **{
        "families compared": cv.agg(F.count_distinct("model").alias("n")),
        "folds measured": rows(cv, F.col("auc").between(0.0, 1.0) & F.coalesce("kappa", F.lit(0.0)).between(-1.0, 1.0)),
        "scores from 0 to 1, best first": rows(means, inside),
        "best mean score above chance": rows(means, (F.col("model") == best) & (F.col("auc") > 0.5)),
        "rows in the confusion counts of the folds": whole(cv).agg(F.sum("n").alias("n")),
        "train rows in confusion counts": whole(metrics(fitted.transform(train), model=best, stage="train")),
        "holdout rows in confusion counts": whole(metrics(fitted.transform(hold), model=best, stage="holdout")),
        "final rows in confusion counts": whole(last),
        "good rows among them": last.select((F.col("tp") + F.col("fn")).alias("n"))})


_RANKED_SQL = """ranked AS (
  SELECT *, count(*) OVER w AS n, sum(y) OVER w AS pos, rank() OVER (PARTITION BY fold ORDER BY score) AS low,
         count(*) OVER (PARTITION BY fold, score) AS ties FROM scored WINDOW w AS (PARTITION BY fold)),
counts AS (
  SELECT fold, count(*) AS n, sum(y)::DOUBLE AS pos, sum(CASE WHEN y = 1 THEN low + (ties - 1) / 2.0 END) AS ranks,
         count_if(y = 1 AND p = 1)::DOUBLE AS tp, count_if(y = 0 AND p = 1)::DOUBLE AS fp,
         count_if(y = 1 AND p = 0)::DOUBLE AS fn, count_if(y = 0 AND p = 0)::DOUBLE AS tn FROM ranked GROUP BY fold),
measured AS (
  SELECT fold, n, (ranks - pos * (pos + 1) / 2) / nullif(pos * (n - pos), 0) AS auc, (tp + tn) / n AS accuracy,
         tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1,
         ((tp + tn) / n - e) / nullif(1 - e, 0) AS kappa,
         (tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0) AS mcc
  FROM (SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n::DOUBLE * n) AS e FROM counts))"""
_MEASURES = ("auc", "accuracy", "precision", "recall", "f1", "kappa", "mcc")


@query("q58_metric_values", f"""WITH
scored AS (SELECT l.quality AS y, {FOLD_SQL.format(k='l.doc_id')} AS fold, d.n_chars % 13 AS score,
                  CASE WHEN d.n_chars % 13 > 2 THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d USING (doc_id)),
{_RANKED_SQL}
SELECT 'cv fold ' || fold AS stage, n, {', '.join(f'round({m}, 6) AS {m}' for m in _MEASURES)} FROM measured
UNION ALL SELECT 'cv mean', sum(n)::BIGINT, {', '.join(f'round(avg({m}), 6)' for m in _MEASURES)} FROM measured
UNION ALL SELECT 'cv sd', sum(n)::BIGINT, {', '.join(f'round(stddev_samp({m}), 6)' for m in _MEASURES)} FROM measured""")
def q58(spark, root):
    """The metrics of a fixed score with many ties, by fold, with mean
    and deviation, by the operators that the training queries use."""
    t = Tables(spark, root)
    score_of = F.col("n_chars") % 13
    scored = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        F.lit("fixed").alias("model"), fold_col(F.col("doc_id")).alias("fold"), "quality",
        F.when(score_of > 2, 1).otherwise(0).alias("guess"), score_of.alias("score"))
    table = spread_of_folds(binary_metrics(scored, "quality", "guess", "score", by=["model", "fold"]))
    return table.select("stage", "n", *[F.round(m, 6).alias(m) for m in _MEASURES])


_SPLIT_FEATURES = {"a": 17, "b": 23}


@query("q60_first_split", f"""WITH
t AS (SELECT quality AS y, {', '.join(f'(n_chars % {m})::DOUBLE AS {f}' for f, m in _SPLIT_FEATURES.items())}
      FROM labels JOIN documents USING (doc_id)),
s AS (SELECT sum(0.5 - y) AS g, count(*) * 0.25 AS h FROM t),
v AS ({' UNION ALL '.join(f"SELECT {i} AS f, {f} AS x, sum(0.5 - y) AS g, count(*) * 0.25 AS h FROM t GROUP BY {f}" for i, f in enumerate(_SPLIT_FEATURES))}),
l AS (SELECT f, x, sum(g) OVER w AS g, sum(h) OVER w AS h FROM v WINDOW w AS (PARTITION BY f ORDER BY x)),
gains AS (SELECT f, x, l.g AS lg, l.h AS lh, s.g - l.g AS rg, s.h - l.h AS rh,
                 0.5 * (l.g * l.g / (l.h + 1) + (s.g - l.g) * (s.g - l.g) / (s.h - l.h + 1) - s.g * s.g / (s.h + 1)) AS gain
          FROM l, s WHERE l.h >= 1 AND s.h - l.h >= 1)
SELECT f::INTEGER AS feature, x AS threshold, round(gain, 6) AS gain, round(-0.3 * lg / (lh + 1), 6) AS left_value,
       round(-0.3 * rg / (rh + 1), 6) AS right_value FROM gains ORDER BY gain DESC, f, x LIMIT 1""")
def q60(spark, root):
    """M5: the first split of the histogram booster: feature, threshold, gain
    and both leaves' values."""
    from pyspark.ml.feature import VectorAssembler
    t = Tables(spark, root)
    data = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").alias("label"), *[(F.col("n_chars") % m).cast("double").alias(f) for f, m in _SPLIT_FEATURES.items()])
    data = VectorAssembler(inputCols=list(_SPLIT_FEATURES), outputCol="features").transform(data)
    tree = HistogramBoosting(maxIter=1, maxLeaves=2, stepSize=0.3).fit(data).tree_list()[0]
    # one row, the model's: the fit behind it has read the table
    row = (tree["feature"], tree["threshold"], round(tree["gain"], 6), round(tree["left"]["value"], 6), round(tree["right"]["value"], 6))
    return spark.createDataFrame([row], "feature int, threshold double, gain double, left_value double, right_value double")


@query("q61_minority_rows", """
WITH n AS (SELECT toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY toxic),
x AS (SELECT toxic, min(n_chars) AS lo, max(n_chars) AS hi FROM labels JOIN documents USING (doc_id) GROUP BY toxic)
SELECT toxic, false AS is_synthetic, n, n AS inside FROM n
UNION ALL SELECT toxic, true, (SELECT max(n) FROM n) - n, (SELECT max(n) FROM n) - n FROM n WHERE n < (SELECT max(n) FROM n)""")
def q61(spark, root):
    """M3: rows of each class after the minority is filled up with synthetic
    rows, and how many of them lie within the range of their class."""
    t = Tables(spark, root)
    data = t.labels.join(t.documents.select("doc_id", "n_chars", "text"), "doc_id").select(
        "doc_id", "toxic", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", "\n")).cast("double").alias("n_lines"))
    filled = synthetic_minority(data, "doc_id", "toxic", ["n_chars", "n_lines"])
    span = data.groupBy(F.col("toxic").alias("cls")).agg(*[f(c).alias(f"{n}_{c}") for c in ("n_chars", "n_lines")
                                                           for n, f in (("lo", F.min), ("hi", F.max))])
    inside = F.col("n_chars").between(F.col("lo_n_chars"), F.col("hi_n_chars")) & F.col("n_lines").between(F.col("lo_n_lines"), F.col("hi_n_lines"))
    return filled.join(span, F.col("toxic") == F.col("cls")).groupBy("toxic", "is_synthetic").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("inside"))


@query("q45_score", f"""WITH {_LABELLED_SQL}
SELECT doc_id, true AS in_range, true AS label_agrees, true AS reloaded_equal, CAST(1 AS BIGINT) AS parts
FROM split WHERE NOT is_train""")
def q45(spark, root):
    """Save a model, load it back and score every labelled document that
    was not used for training (training ids removed by anti join) in one pass
    with its part (S4) as a column: each row in one part, with a score from 0
    to 1, a label that agrees with it, and the score of the model before it was saved."""
    data = materialize(labelled(Tables(spark, root)), "score-data")
    train = data.filter("is_train")
    model = fit_final(train, "logistic_regression", FEATURES)
    loaded = load_model(save_model(model, scratch_path(spark, "model")))
    to_score = remove_keys(data, "doc_id", train.select("doc_id"))
    before = score(model, to_score).withColumnsRenamed({"prediction_score": "before", "prediction_label": "label_before"})
    scored = score(loaded, before).withColumn("part", part_of("doc_id", 4))
    s = F.col("prediction_score")
    label = F.when(s > 0.5, "1.0").otherwise("0.0")
    return scored.groupBy("doc_id").agg(
        F.bool_and(s.between(0.0, 1.0)).alias("in_range"),
        F.bool_and((F.col("prediction_label") == label) | (s == 0.5)).alias("label_agrees"),
        F.bool_and((s == F.col("before")) & (F.col("prediction_label") == F.col("label_before"))).alias("reloaded_equal"),
        F.count_distinct("part").alias("parts"))


@query("q49_click_train_score", f"""{ASSEMBLED_SQL},
dataset AS (SELECT registration_id, clicked_or_not FROM assembled),
split AS ({stratified_sql('dataset', 'registration_id', 'clicked_or_not')}),
folded AS (SELECT {FOLD_SQL.format(k='registration_id')} AS fold, clicked_or_not AS y FROM split WHERE is_train),
folds AS (SELECT fold FROM folded a GROUP BY fold HAVING count(DISTINCT y) > 1
          AND (SELECT count(DISTINCT y) FROM folded b WHERE b.fold <> a.fold) > 1)
SELECT 'dataset rows' AS fact, count(*) AS n FROM split
UNION ALL SELECT 'trained ids', count(*) FROM split WHERE is_train
UNION ALL SELECT 'scored rows', count(*) FROM split WHERE NOT is_train
UNION ALL SELECT 'scores from 0 to 1', count(*) FROM split WHERE NOT is_train
UNION ALL SELECT 'labels of the dataset', count(*) FROM split WHERE NOT is_train
UNION ALL SELECT 'training metrics rows', (SELECT CASE WHEN count(*) = 0 THEN 2 ELSE count(*) + 4 END FROM folds)
UNION ALL SELECT 'rows in the test metrics', count(*) FROM split""")
def q49(spark, root):
    """The click dataset as it stands (NULL features, label 'True' / 'False')
    through training and scoring, with their tables."""
    t = Tables(spark, root)
    base = scratch_path(spark, "click")
    # the members of one snapshot: the scan's day is the same for all
    snapshot = members(t).withColumn("snapshot_ts", F.lit((E_ASOF - H * dt.timedelta(days=1)).isoformat()).cast("timestamp"))
    spec = ClickDatasetSpec(as_of=E_ASOF, key="registration_id", snapshot_ts="snapshot_ts", clean=MEMBER_SPEC,
                            snapshot_lag_days=H, click_key="user_id", click_ts="ts", label_window_days=H)
    clicks = t.events.filter(F.col("event_type") == "click")
    data = click_dataset(snapshot, clicks, [emails(t), txns(t), slots(t), renewals(t)], spec, f"{base}/dataset")
    numeric = [c for c, kind in data.dtypes if kind in ("bigint", "int", "double") and c != "registration_id"]
    train_job(spark, data, "registration_id", "clicked_or_not", numeric, f"{base}/model", f"{base}/metrics",
              include=["logistic_regression"], trained_ids_path=f"{base}/trained")
    trained = spark.read.parquet(f"{base}/trained")
    scored = predictions_job(data, trained, "registration_id", f"{base}/model", f"{base}/predictions",
                             metrics_path=f"{base}/prediction-metrics")
    return facts(spark, **{
        "dataset rows": rows(data), "trained ids": rows(trained), "scored rows": rows(scored),
        "scores from 0 to 1": rows(scored, F.col("prediction_score").between(0.0, 1.0)),
        "labels of the dataset": rows(scored, F.col("prediction_label").isin("True", "False")),
        "training metrics rows": rows(spark.read.parquet(f"{base}/metrics")),
        "rows in the test metrics": spark.read.parquet(f"{base}/prediction-metrics").agg(F.sum("n").alias("n"))})


@query("q47_table_roundtrip", """
SELECT step, c_custkey AS id FROM customer, (VALUES ('overwritten, then appended'), ('part, written twice')) v(step)
UNION ALL SELECT 'part, written again without rows', -1
UNION ALL SELECT 'partitions replaced', c_custkey FROM customer WHERE c_nationkey < 10
UNION ALL SELECT 'staged', min(c_custkey) FROM customer GROUP BY c_mktsegment""")
def q47(spark, root):
    """Fixed-schema table creation, overwrite, append, idempotent part
    writes, a partitioned overwrite and a staged re-read: the rows that each
    step leaves (and id -1 for the part that was emptied)."""
    c = Tables(spark, root).customer
    base = scratch_path(spark, "roundtrip")
    contacts = c.select(
        F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("last_name"),
        F.col("c_custkey").alias("phone_num"), F.lit(None).cast("string").alias("address"),
        F.lit(None).cast("string").alias("city"), F.col("c_nationkey").cast("bigint").alias("zipcode"),
        F.lit(None).cast("string").alias("country"), F.col("c_custkey").cast("string").alias("account_num"))
    create_table(spark, f"{base}/contacts", CONTACT_SCHEMA)
    overwrite(contacts.filter(F.col("zipcode") < 10), f"{base}/contacts")
    append(contacts.filter(F.col("zipcode") >= 10), f"{base}/contacts")
    back = spark.read.parquet(f"{base}/contacts")
    for df, part in ((contacts, 0), (contacts, 0), (contacts, 1), (contacts.filter(F.lit(False)), 1)):
        write_part(df, f"{base}/scored", "run1", part)          # a rerun replaces, also with nothing
    scored = spark.read.parquet(f"{base}/scored")
    emptied = scored.filter("part = 1").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("part, written again without rows").alias("step"), (F.col("n") - 1).alias("id"))
    overwrite(contacts, f"{base}/by-zip", partition_by=["zipcode"])
    overwrite(contacts.filter(F.col("zipcode") < 10), f"{base}/by-zip", partition_by=["zipcode"])
    staged = materialize(back.groupBy("last_name").agg(F.min("phone_num").alias("phone_num")), "segments")
    out = emptied
    for step, df in (("overwritten, then appended", back), ("part, written twice", scored.filter("part = 0")),
                     ("partitions replaced", spark.read.parquet(f"{base}/by-zip")), ("staged", staged)):
        out = out.unionByName(df.select(F.lit(step).alias("step"), F.col("phone_num").alias("id")))
    return out


ODD_FOLDERS = ("_private", ".github", "pkg/_inner/deep", "with space/.x y")
ODD_NAMES = ("with space", "per%20cent", "ümlaut", "__init__", "plus+and#hash")


@query("q48_text_directory", f"""WITH {SOURCE_FILES_SQL},
odd AS (SELECT unnest({list(ODD_NAMES)}) AS stem),
inside AS (SELECT unnest({list(ODD_FOLDERS)}) AS folder)
SELECT file_name, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5, false AS bad
FROM source_files WHERE path LIKE '%.py' OR path LIKE '%.sql'
UNION ALL SELECT stem || '.py', CAST(length(text) AS BIGINT), md5(text), false FROM odd, documents WHERE doc_id = 1
UNION ALL SELECT regexp_replace(folder, '.*/', '') || ' in.py', CAST(length(text) AS BIGINT), md5(text), false FROM inside, documents WHERE doc_id = 1
UNION ALL SELECT 'empty ' || stem || '.sql', 0, md5(''), false FROM odd
UNION ALL SELECT 'bad.py', NULL, NULL, true""")
def q48(spark, root):
    """Documents written one file each (.py / .sql / .md) under a folder per
    source, with odd names and folders, empty files and one file of bad bytes among them,
    read back as whole files filtered by suffix."""
    t = Tables(spark, root)
    base = scratch_path(spark, "sources")
    odd = F.explode(F.array(*[F.lit(x) for x in ODD_NAMES])).alias("stem")
    one = t.documents.filter(F.col("doc_id") == 1).select(odd, "text")
    files = source_files(t).select("path", F.col("text").cast("binary").alias("data"))
    files = files.unionByName(one.select(F.concat(F.lit("odd/"), "stem", F.lit(".py")).alias("path"),
                                         F.col("text").cast("binary").alias("data")))
    inside = F.explode(F.array(*[F.lit(x) for x in ODD_FOLDERS])).alias("folder")
    files = files.unionByName(t.documents.filter(F.col("doc_id") == 1).select(inside, "text").select(
        F.concat("folder", F.lit("/"), F.regexp_extract("folder", "[^/]*$", 0), F.lit(" in.py")).alias("path"),
        F.col("text").cast("binary").alias("data")))
    files = files.unionByName(one.select(F.concat(F.lit("odd/empty "), "stem", F.lit(".sql")).alias("path"),
                                         F.lit(b"").alias("data")))
    files = files.unionByName(one.limit(1).select(F.lit("odd/bad.py").alias("path"), F.unhex(F.lit("66FF00FE")).alias("data")))
    write_text_files(files, base, text="data").agg(F.sum("bytes")).collect()          # run the write
    back = read_text_dir(spark, base, suffixes=(".py", ".sql"), recursive=True)
    return back.filter(is_reviewable(F.col("file_name"))).select(
        "file_name", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"),
        F.col("read_error").isNotNull().alias("bad"))


@query("q53_diff_folder", rf"""WITH {DIFF_LINES_SQL},
d AS (SELECT doc_id, sum(tokens) AS tokens FROM (SELECT doc_id, sum(len(regexp_extract_all(hunk, '\S+'))) + max(hdr_tokens) AS tokens
      FROM diff_hunks GROUP BY doc_id, file_idx) GROUP BY 1)
SELECT 'doc' || doc_id || '.diff' AS diff_id, tokens <= {LEVEL_BUDGET} AS whole,
       CASE WHEN tokens <= {LEVEL_BUDGET} THEN CAST(tokens AS BIGINT) END AS tokens
FROM d WHERE (tokens <= {LEVEL_BUDGET} OR EXISTS (SELECT 1 FROM diff_hunks h WHERE h.doc_id = d.doc_id
  AND (h.path LIKE '%.py' OR h.path LIKE '%.sql')))""")
def q53(spark, root):
    """Every document's diff written as a file, the folder read
    as diffs, split, written by diff and read back."""
    base = scratch_path(spark, "diffs")
    files = diffs(Tables(spark, root)).select(
        F.concat("diff_id", F.lit(".diff")).alias("path"), "text")
    write_text_files(files, f"{base}/in").agg(F.sum("bytes")).collect()
    write_chunks(create_chunks(read_diffs(spark, f"{base}/in"), LEVEL_BUDGET), f"{base}/out")
    return read_chunks(spark, f"{base}/out").groupBy("diff_id").agg(
        F.bool_and(F.col("level") == 1).alias("whole"),
        F.max(F.when(F.col("level") == 1, F.col("tokens"))).alias("tokens"))


@query("q57_patch_records", f"SELECT * REPLACE (diff_id || '.diff' AS diff_id) FROM ({CHUNKS_SQL})")
def q57(spark, root):
    """S6 and T1-T8 for diffs that need not fit a row: every document's diff
    written as a file, the files read in ranges of 4 KB as records, and the
    records split: the same chunks as of whole diffs (q37)."""
    base = scratch_path(spark, "records")
    files = diffs(Tables(spark, root)).select(F.concat("diff_id", F.lit(".diff")).alias("path"), "text")
    write_text_files(files, base).agg(F.sum("bytes")).collect()
    return chunk_digests(create_chunks(read_patches(spark, base, range_bytes=4096), LEVEL_BUDGET))
