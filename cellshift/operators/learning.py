"""Distributed model fits used by the decoder, region and effect operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_unit


def with_folds(rows: DataFrame, unit: Sequence[str], k: int, seed: int) -> DataFrame:
    """Hash folds 0..k-1, fixed per unit."""
    return rows.withColumn("fold", F.floor(hash_unit(seed, *unit) * k).cast("int"))


def region_partition(cells: DataFrame, vec: str, k: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """k-means regions: cells with ``region``, and the centres."""
    data = cells.withColumn("_f", array_to_vector(F.col(vec)))
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="region").fit(data)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    table = cells.sparkSession.createDataFrame(centres, "region int, centre array<double>")
    return model.transform(data).drop("_f"), table


def fit_decoder(rows: DataFrame, vec: str, cls: str, max_iter: int = 1000, c: float = 1.0):
    """Multinomial logistic regression on vectors with integer classes; ``c`` weighs the data against the L2 penalty."""
    data = rows.select(array_to_vector(F.col(vec)).alias("features"), F.col(cls).cast("double").alias("label")).cache()
    n = data.count()
    model = LogisticRegression(maxIter=max_iter, regParam=1.0 / (c * max(n, 1)), standardization=False, tol=1e-4).fit(data)
    data.unpersist()
    return model


def decode(model, cells: DataFrame, vec: str) -> DataFrame:
    """Add ``decoded_cls`` and ``probs`` = ARRAY<STRUCT<cls, p>> in class order."""
    data = model.transform(cells.withColumn("features", array_to_vector(F.col(vec))))
    p = F.transform(vector_to_array("probability"), lambda x, i: F.struct(i.alias("cls"), x.alias("p")))
    return data.withColumns({"probs": p, "decoded_cls": F.col("prediction").cast("int")}).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


MODEL_BYTES = 1 << 26  # parameters of all models of one joint fit, sent to every task each round


OWN_BYTES = 1 << 26  # vectors of a group that one task fits by itself; larger groups are fitted over all tasks


DIRECT_BYTES = 1 << 26  # partial sums of all tasks that the driver adds up itself; more are summed in Spark first


class _Search:
    """L-BFGS of one model, driven by values and gradients that arrive one at a time; minimises the penalised loss."""

    def __init__(self, size: int, memory: int = 10):
        self.x = self.trial = np.zeros(size)
        self.f, self.g, self.t, self.done, self.memory = np.inf, np.zeros(size), 1.0, False, memory
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def tell(self, f: float, g: np.ndarray, tol: float) -> None:
        """Take the value at ``trial``; the next trial is a shorter step, or one along a new direction."""
        if np.isfinite(self.f) and f > self.f + 1e-4 * self.t * self.slope:
            self.t /= 2
            self.done = self.t < 1e-10
        else:
            step, turn = self.trial - self.x, g - self.g
            if np.isfinite(self.f) and step @ turn > 0:
                self.pairs = [*self.pairs, (step, turn)][-self.memory :]
            self.done = np.isfinite(self.f) and abs(self.f - f) <= tol * max(abs(f), 1.0)
            self.x, self.f, self.g, self.t = self.trial, f, g, 1.0
            self.p = -self._inverse(g)
            if not self.pairs:
                self.t = min(1.0, 1.0 / max(np.abs(g).sum(), 1e-300))
            self.slope = float(g @ self.p)
            self.done = self.done or self.slope > -1e-300
        self.trial = self.x + self.t * self.p

    def _inverse(self, g: np.ndarray) -> np.ndarray:
        q, kept = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(kept)):
            q += s * (a - (y @ q) / (s @ y))
        return q


def _probabilities(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    z = x @ theta[:-1] + theta[-1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _part(x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Loss and its gradient over some rows, without the penalty, as one vector."""
    p, at = _probabilities(x, theta), np.arange(len(x))
    loss = -np.log(np.maximum(p[at, y], 1e-300)).sum()
    p[at, y] -= 1.0
    return np.concatenate([[loss], np.vstack([x.T @ p, p.sum(axis=0)]).ravel()])


def _told(search: _Search, theta: np.ndarray, part: np.ndarray, c: float, tol: float) -> None:
    """Tell a search the penalised value and gradient at ``theta``."""
    w = theta.copy()
    w[-1] = 0.0  # no penalty on the intercepts
    search.tell(float(part[0] + (w * w).sum() / (2 * c)), part[1:] + w.ravel() / c, tol)


def _fit_rows(x: np.ndarray, y: np.ndarray, n_classes: int, max_rounds: int, c: float, tol: float) -> np.ndarray:
    """Parameters of one model from rows at hand, by the same search as the joint fit."""
    shape = (x.shape[1] + 1, n_classes)
    search = _Search(shape[0] * shape[1])
    for _ in range(max_rounds if len(x) else 0):
        theta = search.trial.reshape(shape)
        _told(search, theta, _part(x, y, theta), c, tol)
        if search.done:
            break
    return search.x.reshape(shape)


def fit_folds(data: DataFrame, group: str, vec: str, cls: str, classes: Sequence[int], groups: Sequence, k: int,
              max_rounds: int = 1000, c: float = 1.0, tol: float = 1e-7) -> dict[tuple, np.ndarray]:
    """Parameters ((dimension + 1) x classes) of a multinomial logistic regression for every (group value, fold left out).

    ``data`` has ``fold`` 0..k-1. All models share the rounds of one joint L-BFGS: in a round each task adds its rows'
    part to the gradients of its groups' models, k - 1 of k folds each; model-sized blocks are summed, by a shuffle
    where there are many. Every model has its own step and history on the driver and leaves when it has converged, so the number of
    rounds is that of the slowest model, not of all together. ``c`` weighs the data against the L2 penalty on the weights.
    """
    place = {y: i for i, y in enumerate(classes)}
    dim = data.select(F.max(F.size(vec))).first()[0]
    shape = (dim + 1, len(classes))
    if 8 * shape[0] * shape[1] * len(groups) * k > MODEL_BYTES:
        raise ValueError(f"{len(groups) * k} models of {shape[0] * shape[1]} parameters exceed {MODEL_BYTES} bytes; fit fewer groups at once")
    rows = data.select(group, "fold", cls, vec).persist()
    spark, models = data.sparkSession, {(g, f): _Search(shape[0] * shape[1]) for g in groups for f in range(k)}

    def parts(theta: dict):
        def run(batches):
            sums: dict[tuple, np.ndarray] = {}
            for b in batches:
                of, fold, label = (np.array(b.column(i).to_pylist(), object) for i in range(3))
                x = np.asarray(b.column(3).flatten(), float).reshape(b.num_rows, -1)
                y = np.array([place[v] for v in label], int)
                for g in set(of.tolist()):
                    mine = of == g
                    for f in range(k):
                        t = theta.get((g, f))
                        at = np.flatnonzero(mine & (fold != f))
                        if t is None or not len(at):
                            continue
                        part = _part(x[at], y[at], t)
                        sums[g, f] = sums[g, f] + part if (g, f) in sums else part
            if sums:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names.index(m) for m in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                    names=["model", "sums"])
        return run

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for m, raw in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.frombuffer(raw.as_buffer(), float)
                sums[m] = sums[m] + v if m in sums else v
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["model", "sums"])

    names, tasks, bytes_each = list(models), rows.rdd.getNumPartitions(), 8 * shape[0] * shape[1]
    for _ in range(max_rounds):
        open_ = {m: s.trial.reshape(shape) for m, s in models.items() if not s.done}
        if not open_:
            break
        block = rows.mapInArrow(parts(open_), "model int, sums binary")
        if tasks * len(open_) * bytes_each > DIRECT_BYTES:
            block = block.repartition(min(len(open_), 1000), "model").mapInArrow(add, "model int, sums binary")
        got: dict[tuple, np.ndarray] = {}
        for r in block.collect():
            v = np.frombuffer(r["sums"], float)
            got[names[r.model]] = got[names[r.model]] + v if names[r.model] in got else v
        for m, s in models.items():
            if m in open_:
                if m not in got:  # no rows to learn from
                    s.done = True
                    continue
                _told(s, open_[m], got[m], c, tol)
    rows.unpersist()
    return {m: s.x.reshape(shape) for m, s in models.items()}


def _joint_decoded(data: DataFrame, group: str, vec: str, cls: str, classes: Sequence[int], groups: Sequence, k: int, max_rounds: int) -> DataFrame:
    """(group, fold, true_cls, pred_cls) per row, by one joint fit of the models of ``groups``."""
    theta = fit_folds(data, group, vec, cls, classes, groups, k, max_rounds)
    kind = data.schema[group].dataType.simpleString()

    def decode_own(batches):
        for b in batches:
            of, fold = b.column(0).to_pylist(), b.column(1).to_pylist()
            x = np.asarray(b.column(3).flatten(), float).reshape(b.num_rows, -1)
            got = np.zeros(b.num_rows, np.int64)
            for m in set(zip(of, fold)):
                at = np.flatnonzero([p == m for p in zip(of, fold)])
                got[at] = np.array(classes)[_probabilities(x[at], theta[m]).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(got, pa.int32())], names=[group, "fold", "true_cls", "pred_cls"])

    return data.select(group, "fold", F.col(cls).cast("int").alias(cls), vec).mapInArrow(
        decode_own, f"`{group}` {kind}, fold int, true_cls int, pred_cls int")


def _own_decoded(data: DataFrame, group: str, vec: str, cls: str, classes: Sequence[int], k: int, max_rounds: int) -> DataFrame:
    """The same where a group's rows fit a task: it fits and tells all folds of the group, and no model leaves it."""
    kind = data.schema[group].dataType.simpleString()
    place = {y: i for i, y in enumerate(classes)}

    def run(t: pa.Table) -> pa.Table:
        x = np.asarray(t.column(3).combine_chunks().flatten(), float).reshape(t.num_rows, -1)
        fold, label = (np.array(t.column(i).to_pylist(), int) for i in (1, 2))
        y, got = np.array([place[v] for v in label.tolist()], int), np.zeros(t.num_rows, np.int64)
        for f in range(k):
            here = fold == f
            if here.any():
                theta = _fit_rows(x[~here], y[~here], len(classes), max_rounds, 1.0, 1e-7)
                got[here] = np.array(classes)[_probabilities(x[here], theta).argmax(axis=1)]
        return pa.table([t.column(0), t.column(1), t.column(2), pa.array(got, pa.int32())], names=[group, "fold", "true_cls", "pred_cls"])

    return data.select(group, "fold", F.col(cls).cast("int").alias(cls), vec).groupBy(group).applyInArrow(
        run, f"`{group}` {kind}, fold int, true_cls int, pred_cls int")


def fold_scores(
    rows: DataFrame, group: str, unit: Sequence[str], vec: str, cls: str, k: int = 5, seed: int = 42, max_rounds: int = 1000,
    own_bytes: int = OWN_BYTES,
) -> DataFrame:
    """(group, fold, accuracy, n_test, macro_f1) of a decoder for every group value and hash fold.

    Groups whose vectors take up to ``own_bytes`` are fitted each in a task, so any number of them sends nothing to the
    driver; larger ones, few for their rows, are fitted jointly over all tasks, as many at once as ``MODEL_BYTES`` holds.
    """
    data = with_folds(rows, unit, k, seed)
    classes = sorted(r[0] for r in data.select(cls).distinct().collect())
    stats = data.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.max(F.size(vec)).alias("_d"))
    large = sorted((r[0], r["_d"]) for r in stats.filter(F.col("_n") * F.col("_d") * 8 > own_bytes).collect())
    told = None
    if large:
        names = [g for g, _ in large]
        at_once = max(1, MODEL_BYTES // (8 * (max(d for _, d in large) + 1) * len(classes) * k))
        for i in range(0, len(names), at_once):
            part = names[i : i + at_once]
            got = _joint_decoded(data.filter(F.col(group).isin(part)), group, vec, cls, classes, part, k, max_rounds)
            told = got if told is None else told.unionByName(got)
        own = data.filter(~F.col(group).isin(names))
    else:
        own = data
    if own_bytes:
        got = _own_decoded(own, group, vec, cls, classes, k, max_rounds)
        told = got if told is None else told.unionByName(got)
    counts = told.groupBy(group, "fold", "true_cls", "pred_cls").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("true_cls") == F.col("pred_cls"), F.col("n")).otherwise(0)
    sides = counts.select(group, "fold", F.inline(F.array(
        F.struct(F.col("true_cls").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), hit.cast("bigint").alias("h")),
        F.struct(F.col("pred_cls").alias("cls"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("h")),
    ))).groupBy(group, "fold", "cls").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    return sides.groupBy(group, "fold").agg(
        (F.sum("h") / F.sum("t")).alias("accuracy"), F.sum("t").alias("n_test"), F.avg(2 * F.col("h") / (F.col("t") + F.col("p"))).alias("macro_f1"))


def decoder_cv(
    rows: DataFrame, unit: Sequence[str], vec: str, cls: str, k: int = 5, seed: int = 42, max_rounds: int = 1000
) -> DataFrame:
    """Accuracy and macro-F1 per hash fold; the folds are fitted together."""
    return fold_scores(rows.withColumn("_all", F.lit(0)), "_all", unit, vec, cls, k, seed, max_rounds, own_bytes=0).drop("_all")


def decoder_by_year(rows: DataFrame, unit: Sequence[str], vec: str, cls: str, **kw) -> DataFrame:
    """``decoder_cv`` averaged per year; a year's models are fitted in a task, or jointly over all tasks if it is large."""
    return fold_scores(rows, "year", unit, vec, cls, **kw).groupBy("year").agg(
        F.avg("accuracy").alias("cv_accuracy"), F.avg("macro_f1").alias("cv_macro_f1"))


def accuracy(pred: DataFrame, label: str, prediction: str) -> float:
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction, metricName="accuracy")
    return ev.evaluate(pred)


def cross_fitted_propensity(
    rows: DataFrame, unit: Sequence[str], features: Sequence[str], treated: str, k: int = 5, seed: int = 42,
    max_iter: int = 20,
) -> DataFrame:
    """Out-of-fold treatment probability from boosted trees."""
    data = VectorAssembler(inputCols=list(features), outputCol="_f").transform(with_folds(rows, unit, k, seed))
    data = data.withColumn("_y", F.col(treated).cast("double"))
    out = None
    for f in range(k):
        gbt = GBTClassifier(featuresCol="_f", labelCol="_y", maxIter=max_iter, maxDepth=3, seed=seed)
        model = gbt.fit(data.filter(F.col("fold") != f))
        p = model.transform(data.filter(F.col("fold") == f)).withColumn(
            "propensity", vector_to_array("probability")[1]
        ).drop("_f", "_y", "rawPrediction", "probability", "prediction")
        out = p if out is None else out.unionByName(p)
    return out
