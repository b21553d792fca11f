"""End-to-end jobs, one per reference procedure / script.

Each job takes DataFrames or paths plus explicit parameters (the reference
date is an argument, D1), runs on Spark end to end and writes its outputs;
the driver only sees the one-row-per-column profiles and a few counts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.clean import CleanSpec, clean_members, drop_columns
from quarry.operators.diffs import create_chunks, read_chunks, write_chunks
from quarry.operators.features import assemble
from quarry.operators.label import add_existence_label, distinct_keys_since, label_counts
from quarry.operators.ml import (candidates, cross_validate, fit_final, fold_col, load_model,
                                 metrics, ranked_models, save_model, score, spread_of_folds,
                                 stratified_split, transform_labelled, with_class_weights)
from quarry.operators.profile import drop_sparse
from quarry.operators.relational import remove_keys
from quarry.operators.reviews import (ERROR_TEXT, build_prompts, call_model, call_model_once, consolidate, findings,
                                      parse_reviews, split_status, trim_by_severity)
from quarry.sinks.tables import materialize, overwrite, staged_scope, write_part
from quarry.sources.tables import part_filter, snapshot_scan
from quarry.sources.text import read_diffs, read_text_dir


@dataclass
class ClickDatasetSpec:
    """Parameters of the click-propensity dataset job."""

    as_of: dt.date
    key: str
    snapshot_ts: str
    clean: CleanSpec
    snapshot_lag_days: int = 30
    scan_drop: Sequence[str] = ()
    scan_where: object = None
    click_key: str = "reg_id"
    click_ts: str = "event_date"
    label_window_days: int = 30
    label: str = "clicked_or_not"
    sparse_threshold: float = 90.0


def click_dataset(snapshot: DataFrame, clicks: DataFrame, features: Sequence[DataFrame],
                  spec: ClickDatasetSpec, out_path: str | None = None) -> DataFrame:
    """Snapshot scan -> clean -> click label -> feature joins -> second
    sparsity drop (features keep their NULLs, D6) -> write.

    ``features`` are per-key aggregates already keyed by ``spec.key``. The
    snapshot and the assembled table are staged once each, for the profile
    and the select that follows it; the result is a read of ``out_path``, or
    of the staged table.
    """
    if out_path:
        with staged_scope(snapshot.sparkSession):
            overwrite(click_dataset(snapshot, clicks, features, spec), out_path)
        return snapshot.sparkSession.read.parquet(out_path)
    day = spec.as_of - dt.timedelta(days=spec.snapshot_lag_days)
    snap = snapshot_scan(snapshot, spec.snapshot_ts, day, where=spec.scan_where,
                         drop=spec.scan_drop)
    clean, _ = clean_members(snap, replace(spec.clean, stage=True))   # profile a staged copy
    clean = clean.drop(spec.snapshot_ts)
    clickers = distinct_keys_since(clicks, spec.click_key, spec.click_ts,
                                   spec.as_of - dt.timedelta(days=spec.label_window_days))
    labelled = add_existence_label(clean, spec.key, clickers, spec.label)
    full, _ = drop_sparse(assemble(labelled, spec.key, features), spec.sparse_threshold, stage=True)
    return full


def label_distribution(dataset: DataFrame, label: str = "clicked_or_not") -> DataFrame:
    return label_counts(dataset, label)


def train_job(spark: SparkSession, data: DataFrame, key: str, label: str,
              features: Sequence[str], model_path: str, metrics_path: str | None = None,
              include: Sequence[str] | None = None,
              trained_ids_path: str | None = None) -> tuple[str, DataFrame]:
    """Model development: stratified split (99.5 % train), 5 hash folds,
    class weights, compare candidates by CV AUC, refit the best on all rows,
    save the model, write a metrics table (a row per candidate and fold, their
    mean and deviation, a train and a hold-out row) and the ids of the training split. Any label with two values will do;
    rows without a label are left out."""
    with staged_scope(spark):
        d = data.filter(F.col(label).isNotNull()).withColumn("fold", fold_col(F.col(key)))
        d = materialize(stratified_split(with_class_weights(d, label), key, label), "train")
        train, hold = d.filter("is_train"), d.filter("NOT is_train")
        cv = cross_validate(train, features, label=label, include=include)
        best = ranked_models(cv, candidates(label, "weight"), include)[0][0]
        fitted = fit_final(train, best, features, label=label)
        save_model(fit_final(d, best, features, label=label), model_path)
        table = spread_of_folds(cv)
        for part, stage in ((train, "train"), (hold, "holdout")):
            table = table.unionByName(metrics(transform_labelled(fitted, part), model=best, stage=stage), allowMissingColumns=True)
        if trained_ids_path:
            overwrite(train.select(key), trained_ids_path)
        if metrics_path:
            overwrite(table, metrics_path)
            return best, spark.read.parquet(metrics_path)
        rows = table.collect()                            # a row per candidate and fold and some more
        return best, spark.createDataFrame(rows, table.schema)


def score_job(table: DataFrame, model_path: str, target_path: str, run_id: str,
              keep: Sequence[str] | None = None, key: str | None = None,
              num_parts: int | None = None, part: int = 0) -> DataFrame:
    """Chunk scoring: score the whole table in one distributed pass (or one
    hash part of it) and write under ``run_id``/``part`` so a rerun replaces
    instead of duplicating (D16). Returns a read of what was written."""
    if num_parts:
        table = part_filter(table, key, num_parts, part)
    scored = score(load_model(model_path), table)
    if keep:
        scored = scored.select(*keep, "prediction_label", "prediction_score")
    write_part(scored, target_path, run_id, part)
    return table.sparkSession.read.parquet(f"{target_path.rstrip('/')}/run_id={run_id}/part={part}")


def predictions_job(dataset: DataFrame, trained_ids: DataFrame, key: str, model_path: str,
                    out_path: str, drop: Sequence[str] = (), metrics_path: str | None = None) -> DataFrame:
    """Score every dataset row whose key was not used for training (D5) and
    write the predictions, and with ``metrics_path`` the metrics of the
    model on the training rows and on the scored rows (M8). Returns a read
    of the predictions."""
    model = load_model(model_path)
    to_score = remove_keys(dataset, key, trained_ids, key)
    overwrite(score(model, drop_columns(to_score, drop, strict=True)), out_path)
    if metrics_path:
        ids = trained_ids.select(F.col(key).alias("__used")).distinct()
        used = dataset.join(ids, F.col(key) == F.col("__used"), "left_semi")
        table = metrics(transform_labelled(model, used), model=model_path, stage="train").unionByName(
            metrics(transform_labelled(model, to_score), model=model_path, stage="test"))
        overwrite(table, metrics_path)
    return dataset.sparkSession.read.parquet(out_path)


def split_diffs_job(spark: SparkSession, diff_dir: str, out_path: str,
                    budget: int = 100_000) -> DataFrame:
    """Diff splitter: every ``*.diff`` file in a folder -> chunks, written by
    diff. Returns a read of what was written."""
    write_chunks(create_chunks(read_diffs(spark, diff_dir), budget), out_path)
    return read_chunks(spark, out_path)


def review_tables(results: DataFrame, keep: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of model answers ``(…keep, response, error)``:
    ``reviews``, ``review_errors`` (failed calls and answers against the
    contract), ``findings`` (valid ones) and ``top_findings`` (those that fit
    the answer limit, most severe first). Skipped files are reviews without
    findings."""
    ok, bad = split_status(results)
    parsed = parse_reviews(ok)
    found = findings(parsed.filter(F.col("prompt_md5").isNotNull()), keep=list(keep))
    valid = found.filter("is_valid").drop("is_valid")
    broken = parsed.filter(F.col("prompt_md5").isNotNull() & ~(F.col("is_json") & F.col("top_ok"))).select(
        *keep, F.col("response"), F.lit("the answer is not a review by the contract").alias("error"))
    odd = found.filter(~F.col("is_valid") & F.col("finding_idx").isNotNull()).select(
        *keep, F.lit(None).cast("string").alias("response"),
        F.format_string("finding %d is not valid by the contract", "finding_idx").alias("error"))
    errors = bad.select(*keep, "response", "error").unionByName(broken).unionByName(odd)
    return {"reviews": ok, "review_errors": errors, "findings": valid,
            "top_findings": trim_by_severity(valid, list(keep))}


def review_job(spark: SparkSession, src_dir: str, out_path: str, model: Callable[[str], str],
               group: str = "run", fan_in: int = 8, answers: str | None = None,
               run_id: str = "run") -> dict[str, DataFrame]:
    """Reviewer: every ``.py``/``.sql`` file of a folder -> prompt -> model
    (per partition, failures isolated) -> reviews / errors / findings
    tables -> consolidated summary (tree of summaries, cut to 65,000). A file
    that cannot be read is an error row. With ``answers`` (a table's path) equal
    prompts are called once, and a later run calls only prompts without an
    answer there. Returns reads of the tables."""
    keep = (group, "file_name", "path")
    with staged_scope(spark):
        src = read_text_dir(spark, src_dir).withColumn(group, F.lit(src_dir))
        good = src.filter(F.col("read_error").isNull())
        unread = src.filter(F.col("read_error").isNotNull()).select(
            *keep, F.lit(None).cast("string").alias("prompt_md5"), F.lit(None).cast("string").alias("response"),
            F.col("read_error").alias("error"))
        prompts = build_prompts(good)
        called = call_model(prompts, model, keep=keep) if answers is None else \
            call_model_once(prompts, model, answers, run_id, keep=keep)
        results = called.unionByName(unread)
        results = materialize(results, "reviews")      # model answers are never recomputed
        answers = results.withColumn("response", F.coalesce(
            F.col("response"), F.concat(F.lit(ERROR_TEXT), F.col("error"))))
        out = review_tables(results, keep)
        out["summary"] = consolidate(answers, model, [group], name="file_name", text="response", fan_in=fan_in)
        for name, df in out.items():
            overwrite(df, f"{out_path.rstrip('/')}/{name}")
    return {name: spark.read.parquet(f"{out_path.rstrip('/')}/{name}") for name in out}
