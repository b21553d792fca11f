"""Work that must not be done twice, and sums that must not depend on tasks."""

import threading
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.functions.text import WHITESPACE, token_count
from quarry.operators import ml
from quarry.operators.boosting import UNIT, _leaf_sums
from quarry.operators.diffs import read_chunks, write_chunks


def test_chunks_are_made_once_when_written(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    chunks = spark.range(0, 600, 1, 3).select(
        F.concat(F.lit("d"), (F.col("id") % 20).cast("string")).alias("diff_id"), F.lit(3).alias("level"), F.lit("a.py").alias("path"),
        F.col("id").cast("int").alias("part"), F.lit("c").alias("chunk_name"), F.lit("x").alias("text"), F.lit(1).cast("bigint").alias("tokens"))
    write_chunks(chunks.mapInArrow(counted, chunks.schema), str(tmp_path / "out"))
    assert made.value == 600
    assert read_chunks(spark, str(tmp_path / "out")).count() == 600


def test_blank_separated_tokens_are_counted_as_by_the_pattern(spark):
    texts = ["", " ", "a", " a  b ", "a\tb\x0bc\x0cd\re\nf", "\n\n", "a b c", " x ", "\x1c \x1d", "ü ß\t\t中 文", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [(r.a, r.b) for r in df.select(token_count("t").alias("a"), F.coalesce(
        F.regexp_count("t", F.lit(WHITESPACE)), F.lit(0)).alias("b")).collect() if r.a != r.b] == []


def test_a_tasks_sums_are_those_of_its_rows_in_any_batches():
    rng = np.random.default_rng(5)
    bins, y, w = rng.integers(0, 3, (500, 2)), rng.integers(0, 2, 500).astype(float), rng.integers(1, 4, 500) / 4
    batch = pa.RecordBatch.from_arrays([pa.array(bins.tolist(), pa.list_(pa.int32())), pa.array(y), pa.array(w)], names=["bins", "y", "w"])
    numbers = {"feature": 0, "threshold": 0, "left": {"value": 1}, "right": {"value": 2}}
    run = _leaf_sums([], numbers, [1, 2], 2, 3)
    got = [{tuple(r.values())[:3]: (r["g"], r["h"]) for b in run(iter(cut)) for r in b.to_pylist()} for cut in (
        [batch], [batch.slice(0, 123), batch.slice(123, 0), batch.slice(123)])]
    want = {}
    for x, label, weight in zip(bins, y, w):
        for f, b in enumerate(x):
            g, h = want.get((1 if x[0] <= 0 else 2, f, int(b)), (0, 0))
            want[(1 if x[0] <= 0 else 2, f, int(b))] = (g + int(weight * (0.5 - label) * UNIT), h + int(weight * 0.25 * UNIT))
    assert got[0] == got[1] == {k: v for k, v in want.items() if v != (0, 0)}


def test_the_fits_of_all_folds_run_side_by_side(spark, monkeypatch):
    together, real = threading.Barrier(5), ml._pipeline

    def waiting(*args):
        return SimpleNamespace(fit=lambda df: (together.wait(120), real(*args).fit(df))[1])

    monkeypatch.setattr(ml, "_pipeline", waiting)
    df = spark.range(100).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("label"),
                                 F.lit(1.0).alias("weight"), (F.floor(F.col("id") / 2) % 5).cast("int").alias("fold"))
    assert ml.cross_validate(df, ["a"], include=["logistic_regression"]).count() == 5
