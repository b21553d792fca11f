"""Second-order boosting on histograms (M5), as a Spark ML estimator.

Features are cut into bins at approximate quantiles. A tree grows leaf by
leaf, the one with the highest gain first; all it needs are the sums of
gradients and Hessians for each (leaf, feature, bin): tasks add up their rows
with numpy, and one Spark aggregate of as many rows adds up the tasks. The children of all leaves that could
be split are summed in one job, so a tree takes about as many jobs as it has
levels. Sums are of whole numbers (gradients in steps of ``1 / UNIT``), so a
fit does not depend on the order of rows or on tasks that ran again.

A fitted model is a list of trees; scoring is one expression of comparisons
inside generated code.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sinks.tables import materialize

UNIT = 1 << 24


def tree_value(node: dict, value_of) -> Column:
    """The leaf value of a row; ``value_of(feature)`` is the feature's column."""
    if "value" in node:
        return F.lit(float(node["value"]))
    return F.when(value_of(node["feature"]) <= F.lit(float(node["threshold"])), tree_value(node["left"], value_of)) \
        .otherwise(tree_value(node["right"], value_of))


def margin(trees: list[dict], value_of) -> Column:
    total = F.lit(0.0)
    for t in trees:
        total = total + tree_value(t, value_of)
    return total


def _leaf_sums(trees: list[dict], numbers: dict, nodes: list[int], features: int, width: int):
    """For ``mapInArrow`` over rows ``(bins, y, w)``: a task's sums ``(leaf,
    f, b, g, h)`` of gradients and Hessians, in steps of ``1 / UNIT``, of the
    nodes asked for. ``numbers`` is a tree whose values are node numbers. The
    trees come as data, so no job has code of its own to compile."""
    unit = float(UNIT)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def fill(node, bins, at, out):
            if "value" in node:
                out[at] = node["value"]
                return
            left = bins[at, node["feature"]] <= node["threshold"]
            fill(node["left"], bins, at[left], out)
            fill(node["right"], bins, at[~left], out)

        def steps(x):                                  # half away from zero, as SQL's round
            whole = np.trunc(x)
            return (whole + np.sign(x) * (np.abs(x - whole) >= 0.5)).astype(np.int64)

        wanted = np.array(sorted(nodes))
        g_sums, h_sums = (np.zeros(len(wanted) * features * width, np.int64) for _ in range(2))
        for batch in batches:
            n = batch.num_rows
            bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(n, features)
            y, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("y", "w"))
            if not np.isfinite(w).all():
                raise ValueError("weights must be finite")
            at, leaf, total, value = np.arange(n), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            fill(numbers, bins, at, leaf)
            for tree in trees:
                fill(tree, bins, at, value)
                total += value
            p = 1.0 / (1.0 + np.exp(-total))
            g, h = steps(np.where(np.isnan(y), 0.0, w * (p - y)) * unit), steps(w * p * (1 - p) * unit)
            of = np.isin(leaf, wanted)
            place = (np.searchsorted(wanted, leaf[of])[:, None] * features + np.arange(features)) * width + bins[of]
            np.add.at(g_sums, place.ravel(), np.repeat(g[of], features))
            np.add.at(h_sums, place.ravel(), np.repeat(h[of], features))
        found = np.flatnonzero((g_sums != 0) | (h_sums != 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(wanted[found // (features * width)], pa.int32()), pa.array(found // width % features, pa.int32()),
             pa.array(found % width, pa.int32()), pa.array(g_sums[found], pa.int64()), pa.array(h_sums[found], pa.int64())],
            names=["leaf", "f", "b", "g", "h"])

    return run


def best_split(grad: np.ndarray, hess: np.ndarray, reg: float, least: float) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a leaf into bins up to and
    after ``bin``, from its sums (features, bins); ties to the first."""
    left_g, left_h = np.cumsum(grad, axis=1)[:, :-1], np.cumsum(hess, axis=1)[:, :-1]
    all_g, all_h = grad.sum(axis=1, keepdims=True), hess.sum(axis=1, keepdims=True)
    right_g, right_h = all_g - left_g, all_h - left_h
    score = lambda g, h: g * g / (h + reg)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 0.5 * (score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h))
    gain[(left_h < least) | (right_h < least) | ~np.isfinite(gain)] = -1.0
    if not gain.size:
        return None
    at = int(np.argmax(gain))
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), f, b) if gain[f, b] > 0 else None


class _BoostingParams(HasFeaturesCol, HasLabelCol, HasWeightCol, HasMaxIter):
    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a tree's value that is taken", TypeConverters.toFloat)
    regParam = Param(Params._dummy(), "regParam", "added to a leaf's sum of Hessians", TypeConverters.toFloat)
    minHessian = Param(Params._dummy(), "minHessian", "least sum of Hessians of a leaf", TypeConverters.toFloat)

    def _defaults(self):
        self._setDefault(featuresCol="features", labelCol="label", maxIter=5, maxLeaves=8, maxBins=32, stepSize=0.5,
                         regParam=1.0, minHessian=1.0)


class HistogramBoosting(Estimator, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for a label of 0 and 1. Other labels are an error; a
    missing weight counts 1; features must not be missing."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol=None, maxIter=5, maxLeaves=8, maxBins=32,
                 stepSize=0.5, regParam=1.0, minHessian=1.0):
        super().__init__()
        self._defaults()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> HistogramBoostingModel:
        y = F.col(self.getOrDefault("labelCol")).cast("double")
        weight = F.coalesce(F.col(self.getOrDefault("weightCol")).cast("double"), F.lit(1.0)) if self.isSet("weightCol") else F.lit(1.0)
        rows = dataset.select(vector_to_array(self.getOrDefault("featuresCol")).alias("x"), y.alias("y"), weight.alias("w"))
        edges = self._edges(rows)
        places = [sum((F.col("x")[f] > F.lit(e)).cast("int") for e in cuts) if cuts else F.lit(0) for f, cuts in enumerate(edges)]
        rows = materialize(rows.select(F.array(*places).alias("bins") if places else F.array().cast("array<int>").alias("bins"), "y", "w"),
                           "boosting-bins")
        trees: list[dict] = []
        for _ in range(self.getOrDefault("maxIter")):
            tree = self._tree(rows, trees, edges)
            if tree is None:
                break
            trees.append(tree)
        model = HistogramBoostingModel(trees=json.dumps([_in_values(t, edges) for t in trees]),
                                       featuresCol=self.getOrDefault("featuresCol"))
        return model._resetUid(self.uid)

    def _edges(self, rows: DataFrame) -> list[list[float]]:
        """Each feature's cuts: distinct approximate quantiles, the greatest value left out."""
        first = rows.select(F.size("x").alias("n")).first()
        if first is None:
            raise ValueError("no rows to fit")
        n, bins = first["n"], self.getOrDefault("maxBins")
        shares = [k / bins for k in range(1, bins)]
        found = rows.agg(F.min("y"), F.max("y"), *[x for f in range(n) for x in (
            F.percentile_approx(F.col("x")[f], shares, 100 * bins).alias(f"q{f}"), F.max(F.col("x")[f]).alias(f"m{f}"))]).first()
        if found[0] is None or found[0] < 0 or found[1] > 1:
            raise ValueError("labels must be 0 or 1")
        return [sorted({float(q) for q in found[f"q{f}"] if q < found[f"m{f}"]}) for f in range(n)]

    def _tree(self, rows: DataFrame, trees: list[dict], edges: list[list[float]]) -> dict | None:
        reg, least, leaves = (self.getOrDefault(x) for x in ("regParam", "minHessian", "maxLeaves"))
        if not edges:
            return None
        width = max((len(e) for e in edges), default=0) + 1

        def sums(nodes: dict[int, dict], numbers: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            out = {k: (np.zeros((len(edges), width)), np.zeros((len(edges), width))) for k in nodes}
            parts = rows.mapInArrow(_leaf_sums(trees, numbers, list(nodes), len(edges), width), "leaf int, f int, b int, g bigint, h bigint")
            found = parts.groupBy("leaf", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()   # leaves x features x bins
            for r in found:
                out[r["leaf"]][0][r["f"], r["b"]], out[r["leaf"]][1][r["f"], r["b"]] = r["g"] / UNIT, r["h"] / UNIT
            return out

        root: dict = {"id": 0}
        known = sums({0: root}, {"value": 0})
        if not known[0][1].any():
            return None
        open_leaves, last = {0: root}, 0
        pending: dict[int, tuple] = {0: best_split(*known[0], reg, least)}      # best split by leaf
        while True:
            # children of every leaf that may be split: one job for all whose sums are not known
            new = {}
            for k, leaf in open_leaves.items():
                if pending[k] and "children" not in leaf:
                    leaf["children"] = [{"id": last + 1}, {"id": last + 2}]
                    last += 2
                    new |= {c["id"]: c for c in leaf["children"]}
            room = leaves - len(open_leaves)
            if new and room > 0:
                known |= sums(new, self._numbers(root, pending))
                pending |= {k: best_split(*known[k], reg, least) for k in new}
            ready = [(-pending[k][0], k) for k, leaf in open_leaves.items() if pending[k]]
            if not ready or room <= 0:
                break
            _, k = min(ready)
            leaf = open_leaves.pop(k)
            leaf["split"] = pending[k]
            open_leaves |= {c["id"]: c for c in leaf["children"]}
        rate = self.getOrDefault("stepSize")

        def finish(node: dict) -> dict:
            g, h = known[node["id"]][0][0].sum(), known[node["id"]][1][0].sum()
            if "split" not in node:
                return {"value": -rate * g / (h + reg)}
            gain, f, b = node["split"]
            left, right = (finish(c) for c in node["children"])
            return {"feature": f, "threshold": b, "gain": gain, "left": left, "right": right}

        return finish(root)

    @staticmethod
    def _numbers(root: dict, pending: dict[int, tuple]) -> dict:
        """A tree over bins whose values are the numbers of the deepest known nodes."""

        def number(node: dict) -> dict:
            if "children" not in node or not pending.get(node["id"]):
                return {"value": node["id"]}
            _, f, b = pending[node["id"]]
            left, right = (number(c) for c in node["children"])
            return {"feature": f, "threshold": b, "left": left, "right": right}

        return number(root)


def _in_values(node: dict, edges: list[list[float]]) -> dict:
    """A tree over bins as a tree over feature values."""
    if "value" in node:
        return node
    return {**node, "threshold": edges[node["feature"]][node["threshold"]],
            "left": _in_values(node["left"], edges), "right": _in_values(node["right"], edges)}


class HistogramBoostingModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction``, ``probability`` and ``prediction``."""

    trees = Param(Params._dummy(), "trees", "the trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees="[]", featuresCol="features"):
        super().__init__()
        self._setDefault(featuresCol="features", trees="[]")
        self._set(**self._input_kwargs)

    def tree_list(self) -> list[dict]:
        return json.loads(self.getOrDefault("trees"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = dataset.withColumn("__x", vector_to_array(self.getOrDefault("featuresCol")))
        m = values.withColumn("__m", margin(self.tree_list(), lambda f: F.col("__x")[f]))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__m")))
        return m.withColumns({
            "rawPrediction": array_to_vector(F.array(-F.col("__m"), F.col("__m"))),
            "probability": array_to_vector(F.array(F.lit(1.0) - p, p)),
            "prediction": F.when(p > 0.5, 1.0).otherwise(0.0)}).drop("__x", "__m")
