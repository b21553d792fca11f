"""Corpus pipeline over ``documents``: each stage takes (spark, docs, sf_dir)
and returns a DataFrame, which is written and read again as the next stage's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import op3_temperature_mixing as mixing
from quarry.llm import op6_lsh_forest as near
from quarry.llm import op7_bpe as bpe
from quarry.llm import op9_toxicity_chain as toxicity
from quarry.llm import op10_weak_quality as quality
from quarry.llm.common import free_name, read, ship_package, stage
from quarry.session import ensure_checkpoint_dir
from quarry.sinks.tables import staged_scope

SHINGLE, SIMILAR = 5, (80, 100)      # near duplicates: five words, similarity 0.8
MAX_REPEATS = 1.25                   # a small source is drawn so often at most


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps (operator 10). It is
    fitted on ``docs``."""
    _ready(spark)
    out = free_name(docs.columns, "quality")
    scored = quality.score(docs, quality.fit(docs), out=out)
    return scored.filter(F.col(f"{out}.kept")).drop(out)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not flag (operator 9). It is
    fitted on the labelled documents of ``sf_dir``."""
    _ready(spark)
    out = free_name(docs.columns, "chain")
    scored = toxicity.score(docs, toxicity.fit_on_labels(spark, sf_dir), out=out)
    return scored.filter(~F.col(f"{out}.flagged")).drop(out)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (operator 6)."""
    _ready(spark)
    return near.one_of_each(docs, SHINGLE, SIMILAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The draws of a temperature mix (operator 3): every document once, and
    documents of small sources again, up to the repetition limit."""
    _ready(spark)
    return mixing.draw(docs, max_repeats=MAX_REPEATS).select(*docs.columns)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every draw, decoded again (operator 7)."""
    _ready(spark)
    return bpe.digests(docs, bpe.default_vocabulary())


STAGES = [
    ("quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", encode_bpe),
]

# Two stages apply models that are fitted at run time, so no SQL states the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again. When a
    stage is written, all that was staged for it and the stage before are
    deleted, so the checkpoint folder holds one copy of the corpus at the end."""
    docs, before = read(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        with staged_scope(spark) as staged:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
            written = staged.pop()                # the last one staged
            staged.extend(before)
        before = [written]
    return STAGES[-1][1](spark, docs, sf_dir)
