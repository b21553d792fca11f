"""Training, model comparison, metrics and scoring with Spark ML (M1-M9,
A14, K7).

* M1: labels are indexed and missing features filled inside the pipeline,
  so both are stored with the model.
* M2 splits each class at an order statistic of its keys' hashes, found by
  refining histograms; M4 folds are hashes of the row key: the same rows on
  every run, and the same rule runs in SQL.
* M3: class imbalance is handled with a weight column (class weights
  from a one-row-per-class count).
* M5: built-in classifiers are compared by cross-validated ROC AUC; the
  winner is refitted on every row (M6) and saved as a ``PipelineModel``
  together with its feature list (K7, M9).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import WORD_PUNCT, token_count
from quarry.operators.boosting import HistogramBoosting
from quarry.operators.ranking import ordered_sums
from quarry.sinks.tables import materialize

# Hold-out share, folds and seed of the reference setup.
TRAIN_PER_MILLE = 995
FOLDS = 5
SEED = 123
FITS_AT_ONCE = 8
MOST_CLASSES = 100                 # a label column with more values is no class label
FILLED = "__filled"


def hash_bucket(key: Column, start: int, modulo: int) -> Column:
    """Stable bucket from 8 hex digits of ``md5(key)`` starting at ``start``."""
    h = F.conv(F.substring(F.md5(key.cast("string")), start, 8), 16, 10).cast("bigint")
    return h % modulo


HASH_BINS = 4096                   # of a histogram of hashes


def hash_limits(df: DataFrame, cls: Column, place: Column, held: Column) -> dict[str, int]:
    """The ``held``-th smallest ``place`` (a hash below 2**60) of each class,
    ``held`` being an expression of the class's number of rows ``total``;
    classes of which none is held have no entry.

    Every round counts the rows of each class in bins of its interval (one
    aggregate, partial sums per task) and goes on with the bin that holds the
    wanted row, until its smallest and greatest hash are the same: two or three
    rounds, and 15 bits or so for each. The driver sees a row for each class."""
    rows = df.select(cls.alias("c"), place.alias("h"))
    state: dict[str, tuple[int, int, int, int]] = {}          # class -> low, high, rows below, rows wanted
    limits: dict[str, int] = {}
    first = True
    while first or state:
        if first:
            binned = rows.withColumn("bin", F.floor(F.col("h") / F.lit(2 ** 60 // HASH_BINS)).cast("bigint"))
        else:
            low, width, below = (F.create_map(*[x for c, v in state.items() for x in (F.lit(c), F.lit(pick(v)))]) for pick in (
                lambda v: v[0], lambda v: (v[1] - v[0]) // HASH_BINS + 1, lambda v: v[2]))
            inside = rows.filter(F.col("c").isin(list(state))).withColumn("low", low[F.col("c")])
            high = F.create_map(*[x for c, v in state.items() for x in (F.lit(c), F.lit(v[1]))])
            binned = inside.filter(F.col("h").between(F.col("low"), high[F.col("c")])) \
                .withColumn("bin", F.floor((F.col("h") - F.col("low")) / width[F.col("c")]).cast("bigint"))
        bins = binned.groupBy("c", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("c").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        bins = bins.withColumn("upto", upto)
        if first:
            bins = bins.withColumn("total", F.sum("n").over(Window.partitionBy("c"))).withColumn("wanted", held.cast("bigint"))
        else:
            wanted = F.create_map(*[x for c, v in state.items() for x in (F.lit(c), F.lit(v[3]))])
            bins = bins.withColumn("upto", F.col("upto") + below[F.col("c")]).withColumn("wanted", wanted[F.col("c")])
        hit = bins.filter((F.col("wanted") > 0) & (F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted"))) \
            .limit(MOST_CLASSES + 1).collect()
        if len(hit) > MOST_CLASSES:
            raise ValueError(f"more than {MOST_CLASSES} classes")
        limits |= {r["c"]: r["lo"] for r in hit if r["lo"] == r["hi"]}
        state = {r["c"]: (r["lo"], r["hi"], r["upto"] - r["n"], r["wanted"]) for r in hit if r["lo"] < r["hi"]}
        first = False
    return limits


def stratified_split(df: DataFrame, key: str, label: str, per_mille: int = TRAIN_PER_MILLE,
                     out: str = "is_train") -> DataFrame:
    """M2: add ``out``, true for ``per_mille``/1000 of each class. Of a class
    of n rows, ``max(1, round(n * (1000 - per_mille) / 1000))`` are held out
    (none of a single row): those whose keys have the smallest MD5.

    Rows of one key stay on one side (those of the last key held out are held
    out all); a NULL key counts as empty, a NULL label as a class. Only
    ``key`` and ``label`` are read for the limits, a row passes a filter and is
    neither sorted nor moved. ``df`` is read more than once and must give the
    same rows. A label with more than ``MOST_CLASSES`` values is refused."""
    cls = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")
    total = F.col("total")
    held = F.when(total < 2, 0).otherwise(F.greatest(F.lit(1), F.round(total * F.lit((1000 - per_mille) / 1000.0))))
    limits = hash_limits(df, cls, place, held)
    if not limits:
        return df.withColumn(out, F.lit(True))
    limit = F.create_map(*[x for c, v in limits.items() for x in (F.lit(c), F.lit(v))])
    return df.withColumn(out, place > F.coalesce(F.try_element_at(limit, cls), F.lit(-1)))


def fold_col(key: Column, folds: int = FOLDS) -> Column:
    """M4: fold number in ``[0, folds)`` from a second slice of the hash."""
    return hash_bucket(key, 9, folds).cast("int")


def doc_features(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Numeric features of a text row (all computed in the JVM), plus the
    ``keep`` columns."""
    t = F.col("text")
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    return docs.select(
        *keep,
        F.length(t).cast("double").alias("n_chars"),
        (F.size(F.split(t, "\n"))).cast("double").alias("n_lines"),
        token_count(t).cast("double").alias("ws_tokens"),
        token_count(t, WORD_PUNCT).cast("double").alias("wp_tokens"),
        (F.regexp_count(t, F.lit("[A-Z]")) / n).alias("upper_share"),
        (F.regexp_count(t, F.lit("[0-9]")) / n).alias("digit_share"),
        (F.regexp_count(t, F.lit(r"[^A-Za-z0-9\s]")) / n).alias("punct_share"),
    )


FEATURES = ("n_chars", "n_lines", "ws_tokens", "wp_tokens", "upper_share", "digit_share",
            "punct_share")


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """M3: weight ``n / (k * n_class)`` per row (one tiny aggregate); rows
    without a label weigh 0. A label with more than ``MOST_CLASSES`` values
    is refused."""
    known = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    counts = {r[label]: r["n"] for r in known.limit(MOST_CLASSES + 1).collect()}
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} values")
    total, k = sum(counts.values()), len(counts)
    if not counts:
        return df.withColumn(out, F.lit(0.0))
    m = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(total / (k * n)))])
    return df.withColumn(out, F.coalesce(F.try_element_at(m, F.col(label)), F.lit(0.0)))


def candidates(label: str, weight: str) -> dict[str, object]:
    """M5: the classifiers compared: for the reference's two boosted-tree
    libraries (D15) Spark's own and a second-order one on histograms."""
    return {
        "logistic_regression": LogisticRegression(labelCol=label, weightCol=weight, maxIter=50,
                                                  tol=1e-4),
        "random_forest": RandomForestClassifier(labelCol=label, weightCol=weight, numTrees=20,
                                                seed=SEED),
        "gbt": GBTClassifier(labelCol=label, weightCol=weight, maxIter=10, maxDepth=4,
                             seed=SEED),
        "histogram_boosting": HistogramBoosting(labelCol=label, weightCol=weight),
    }


INDEX = "label_index"


def _pipeline(features: Sequence[str], label: str, weight: str, name: str) -> Pipeline:
    """M1: index the label (alphabetical, so False before True and 0 before
    1), fill missing features with 0, assemble, fit."""
    index = StringIndexer(inputCol=label, outputCol=INDEX, handleInvalid="error", stringOrderType="alphabetAsc")
    quoted = [c.replace("`", "``") for c in features]
    fills = ", ".join(f"coalesce(nanvl(cast(`{c}` AS double), 0D), 0D) AS `{c}{FILLED}`" for c in quoted)
    return Pipeline(stages=[
        index, SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}{FILLED}" for c in features], outputCol="features"),
        candidates(INDEX, weight)[name]])


def cross_validate(train: DataFrame, features: Sequence[str], label: str = "label",
                   weight: str = "weight", fold: str = "fold",
                   include: Sequence[str] | None = None) -> DataFrame:
    """M4/M5: ``binary_metrics`` of each candidate in each fold, with the
    candidate's name in ``model``.

    One fit per candidate and fold, on one cached frame that all share; fits
    run side by side, ``FITS_AT_ONCE`` of them, as Spark takes jobs from several
    driver threads. The held-out predictions of all fits are measured in one job. A
    fold without both classes, in it or beside it, is left out.
    """
    from concurrent.futures import ThreadPoolExecutor

    data = train.filter(F.col(label).isNotNull()).persist()
    todo = [n for n in candidates(label, weight) if not include or n in include]
    held = {(r[fold], r[label]) for r in data.select(fold, label).distinct().collect()}   # folds x classes
    folds = sorted({f for f, _ in held})
    usable = [f for f in folds if len({y for g, y in held if g == f}) > 1 and len({y for g, y in held if g != f}) > 1]

    def run(fit: tuple[int, str]) -> DataFrame:
        f, name = fit
        model = _pipeline(features, label, weight, name).fit(data.filter(F.col(fold) != f))
        return _scores(model.transform(data.filter(F.col(fold) == f))) \
            .select(F.lit(name).alias("model"), F.lit(f).cast("int").alias("fold"), INDEX, "prediction", "__score")

    try:
        with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
            parts = list(pool.map(run, [(f, name) for f in usable for name in todo]))
        if not parts:
            return binary_metrics(data.limit(0).select(
                F.lit("").alias("model"), F.lit(0).alias("fold"), F.lit(0.0).alias(INDEX), F.lit(0.0).alias("prediction"),
                F.lit(0.0).alias("__score")), INDEX, "prediction", "__score", by=["model", "fold"])
        scored = parts[0]
        for df in parts[1:]:
            scored = scored.unionByName(df)
        return materialize(binary_metrics(scored, INDEX, "prediction", "__score", by=["model", "fold"]), "cross-validation")
    finally:
        data.unpersist()


def compare_models(train: DataFrame, features: Sequence[str], label: str = "label",
                   weight: str = "weight", fold: str = "fold",
                   include: Sequence[str] | None = None) -> list[tuple[str, float]]:
    """M5: mean AUC over the folds per candidate, best first (ties by name)."""
    return ranked_models(cross_validate(train, features, label, weight, fold, include), candidates(label, weight), include)


def ranked_models(cv: DataFrame, names, include: Sequence[str] | None = None) -> list[tuple[str, float]]:
    means = {r["model"]: r["auc"] for r in cv.groupBy("model").agg(F.avg("auc").alias("auc")).collect()}   # a row per candidate
    scores = [(n, means.get(n)) for n in names if not include or n in include]
    scores = [(n, float("nan") if a is None else a) for n, a in scores]
    return sorted(scores, key=lambda x: (-x[1] if x[1] == x[1] else 1.0, x[0]))


def fit_final(df: DataFrame, name: str, features: Sequence[str], label: str = "label",
              weight: str = "weight") -> PipelineModel:
    """M6: refit the chosen candidate on every labelled row given."""
    return _pipeline(features, label, weight, name).fit(df.filter(F.col(label).isNotNull()))


def save_model(model: PipelineModel, path: str) -> str:
    """K7: overwrite the model at a shared path."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_features(model: PipelineModel) -> list[str]:
    """M9: the feature list stored with the model."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return [c.removesuffix(FILLED) for c in assembler.getInputCols()]


def _indexer(model: PipelineModel) -> StringIndexerModel:
    return next(s for s in model.stages if isinstance(s, StringIndexerModel))


def model_labels(model: PipelineModel) -> list[str]:
    """The label values stored with the model, by index."""
    return list(_indexer(model).labels)


def transform_labelled(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The model's output for the rows whose label it knows, for ``metrics``."""
    label = F.col(_indexer(model).getInputCol())
    return model.transform(df.filter(label.cast("string").isin(model_labels(model))))


def score(model: PipelineModel, df: DataFrame, strict: bool = True) -> DataFrame:
    """M7: add ``prediction_label`` (the label's own value) and
    ``prediction_score`` (probability of the second class); the first
    class's score is dropped. Missing features score as filled. With
    ``strict`` a missing feature column is an error (D18)."""
    missing = [c for c in model_features(model) if c not in df.columns]
    if strict and missing:
        raise KeyError(f"feature columns missing for scoring: {missing}")
    label = _indexer(model).getInputCol()
    hidden = {label: "__own_label"} if label in df.columns else {}     # labels play no part here
    out = model.transform(df.withColumnsRenamed(hidden)).withColumnsRenamed({v: k for k, v in hidden.items()})
    names = F.array(*[F.lit(x) for x in model_labels(model)])
    return out.select(*df.columns,
                      F.get(names, F.col("prediction").cast("int")).alias("prediction_label"),
                      # a model of one class knows no second one
                      F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)).alias("prediction_score"))


MEASURES = ("auc", "accuracy", "precision", "recall", "f1", "kappa", "mcc")


def binary_metrics(scored: DataFrame, label: str, prediction: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """A row for each group ``by`` of n, auc, tp, fp, fn, tn, accuracy,
    precision, recall, f1, kappa and mcc; ``label`` and ``prediction`` are 0
    or 1, rows without a label are left out. Measures that divide by zero are NULL.

    The AUC is exact (Mann-Whitney): a positive row counts the negative ones
    with a lower score and half of those with an equal one, so rows are first
    summed per distinct score, and the rows below come from prefix sums over
    the ordered scores (``ordered_sums``: no task holds a group). A NULL score
    is below all others."""
    by = list(by)
    y, p = F.col(label), F.col(prediction)
    rows = scored.filter(y.isNotNull())
    one = rows.groupBy(*by, F.col(score).alias("__s")).agg(
        F.count_if(y == 1).alias("__pos"), F.count_if(y == 0).alias("__neg"),
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"))
    ranked = ordered_sums(one, by, ["__s"], {"__neg": "__below"})
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    wins = (wide("__pos") * (wide("__below") * 2 + wide("__neg"))).cast("decimal(38,0)")
    total = ranked.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in (
        ("__pos", F.col("__pos")), ("__neg", F.col("__neg")), ("tp", F.col("tp")), ("fp", F.col("fp")), ("__wins", wins))])
    c = total.select(*by, (F.col("__pos") + F.col("__neg")).alias("n"), "tp", "fp", (F.col("__pos") - F.col("tp")).alias("fn"),
                     (F.col("__neg") - F.col("fp")).alias("tn"), "__pos", "__neg", "__wins")
    d = lambda name: F.col(name).cast("double")
    tp, fp, fn, tn, n = (d(x) for x in ("tp", "fp", "fn", "tn", "n"))
    agree, chance = F.try_divide(tp + tn, n), F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return c.select(
        *by, "n", F.try_divide(d("__wins"), 2.0 * d("__pos") * d("__neg")).alias("auc"), "tp", "fp", "fn", "tn",
        agree.alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(agree - chance, 1 - chance).alias("kappa"),
        F.try_divide(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)).alias("mcc"))


def spread_of_folds(cv: DataFrame) -> DataFrame:
    """M8: rows of stage ``cv fold k``, ``cv mean`` and ``cv sd`` (over the
    folds, sample deviation) of each model of ``cross_validate``."""
    each = cv.select("model", F.concat(F.lit("cv fold "), F.col("fold").cast("string")).alias("stage"),
                     "n", *MEASURES, "tp", "fp", "fn", "tn")
    total = lambda stage, how: cv.groupBy("model").agg(
        F.lit(stage).alias("stage"), F.sum("n").alias("n"), *[how(c).alias(c) for c in MEASURES])
    return each.unionByName(total("cv mean", F.avg), allowMissingColumns=True) \
               .unionByName(total("cv sd", F.stddev_samp), allowMissingColumns=True)


def _scores(pred: DataFrame) -> DataFrame:
    """A fitted pipeline's output with ``__score``, by which the AUC orders rows."""
    return pred.withColumn("__score", F.get(vector_to_array("rawPrediction"), F.lit(1)))


def metrics(pred: DataFrame, label: str = INDEX, model: str = "", stage: str = "") -> DataFrame:
    """One row of ``binary_metrics`` of a fitted pipeline's output
    over its labelled rows, with the model's and the stage's name."""
    m = binary_metrics(_scores(pred), label, "prediction", "__score")
    return m.select(F.lit(model).alias("model"), F.lit(stage).alias("stage"), *m.columns)
