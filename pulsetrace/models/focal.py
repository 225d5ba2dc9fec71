"""Logistic regression under the focal loss, fitted by second-order steps on aggregated derivatives.

A row of weight a whose class the model gives probability p costs ``-a (1 - p)^gamma log p``: rows that are already
right hardly count. Each step is two passes over a written table: one sums loss, gradient and curvature of the row
margins, the other the loss at step lengths 1, 1/2, ..., of which the best is taken. A task sends features^2 numbers
and the driver solves one system of that size, whatever the number of rows. The fits of a search, over folds and
penalties, are moved on together: both passes serve all of them, over rows written once as blocks of bytes.

Defined cases. Rows without features, class or weight take no part. Features of one value get no coefficient. No rows, or
weights of zero, leave all coefficients at zero. ``gamma`` 0 is plain logistic regression. Where one class is absent or
the classes are apart, the loss has no lowest point without a penalty; the steps then end at ``maxIter``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasRegParam, HasTol, HasWeightCol
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsetrace.session import materialise

#: Least curvature of a row; the focal loss bends the other way far on the wrong side.
LEAST_CURVATURE = 1e-6
#: Step lengths tried side by side.
STEPS = tuple(2.0 ** -i for i in range(11))
PARTIAL = "i int, j int, value double"
#: Rows of a packed record, so few that a batch of records stays small, and rows that a task works on at a time.
ROWS_PER_RECORD = 8
ROWS_AT_ONCE = 2_048


def row_loss(margin: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature by the margin of the row's own class."""
    log_right = -np.logaddexp(0, -margin)
    log_wrong = -np.logaddexp(0, margin)
    right, wrong = np.exp(log_right), np.exp(log_wrong)
    scale = np.exp(gamma * log_wrong)
    loss = -scale * log_right
    slope = scale * (gamma * right * log_right - wrong)
    curvature = scale * right * (wrong * (1 + 2 * gamma) + gamma * log_right * (wrong - gamma * right))
    return loss, slope, curvature


def plain_loss(margin: np.ndarray, gamma: float) -> np.ndarray:
    """The loss of ``row_loss`` alone: the logarithms of both classes' probabilities differ by the margin."""
    log_right = -np.logaddexp(0, -margin)
    return -np.exp(gamma * (log_right - margin)) * log_right


def _arrays(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            sign = 2.0 * batch.column("y").to_numpy(zero_copy_only=False) - 1
            yield np.column_stack([np.ones(len(x)), x]), sign, batch.column("a").to_numpy(zero_copy_only=False)


def _cells(matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    i, j = np.indices(matrix.shape, dtype=np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(matrix.ravel())],
                                     names=["i", "j", "value"])


def _summed(rows: DataFrame, partial, shape: tuple[int, int]) -> np.ndarray:
    """Sum of one matrix per task."""
    out = np.zeros(shape)
    for r in rows.mapInArrow(partial, PARTIAL).groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r.i, r.j] = r.value
    return out


def _derivatives(x: np.ndarray, sign: np.ndarray, a: np.ndarray, beta: np.ndarray, gamma: float) -> np.ndarray:
    """Loss, gradient (last column) and curvature of the rows as one matrix."""
    n = len(beta)
    total = np.zeros((n + 1, n + 1))
    loss, slope, bend = row_loss(sign * (x @ beta), gamma)
    total[0, n] = a @ loss
    total[1:, n] = x.T @ (a * sign * slope)
    total[1:, :n] = (x * (a * np.maximum(bend, LEAST_CURVATURE))[:, None]).T @ x
    return total


def derivatives(rows: DataFrame, beta: np.ndarray, gamma: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed loss, gradient and curvature at ``beta`` (intercept first) over rows of (x, y, a)."""
    n = len(beta)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n + 1, n + 1))
        for x, sign, a in _arrays(batches, n - 1):
            total += _derivatives(x, sign, a, beta, gamma)
        yield from _cells(total)

    total = _summed(rows, partial, (n + 1, n + 1))
    return float(total[0, n]), total[1:, n], total[1:, :n]


def losses(rows: DataFrame, betas: np.ndarray, gamma: float) -> np.ndarray:
    """Summed loss of each row of ``betas``, in one pass."""
    count, n = betas.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, 1))
        for x, sign, a in _arrays(batches, n - 1):
            for k, margin in enumerate((x @ betas.T).T):
                total[k, 0] += a @ plain_loss(sign * margin, gamma)
        yield from _cells(total)

    return _summed(rows, partial, (count, 1))[:, 0]


def direction(gradient: np.ndarray, curvature: np.ndarray, beta: np.ndarray, penalty: float) -> np.ndarray:
    """The second-order step of the penalised mean loss; the intercept carries no penalty."""
    held = np.full(len(beta), penalty)
    held[0] = 0.0
    return -np.linalg.lstsq(curvature + np.diag(held), gradient + held * beta, rcond=None)[0]


@dataclass(frozen=True)
class FocalFit:
    """Coefficients (intercept first) on the features as given, and the penalised mean loss before every step."""

    beta: np.ndarray
    losses: list[float]


def spread(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and summed square deviation of each column; a column of one value has exactly that mean and none."""
    mean = x[0] + (x - x[0]).mean(axis=0)
    return len(x), mean, ((x - mean) ** 2).sum(axis=0)


def merged(one: tuple, two: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """``spread`` of two sets of rows together."""
    if not one[0]:
        return two
    n, apart = one[0] + two[0], two[1] - one[1]
    return n, one[1] + apart * (two[0] / n), one[2] + two[2] + apart ** 2 * (one[0] * two[0] / n)


def standardised(rows: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, float]:
    """The rows with centred features of sample deviation one, their centre and scale, and the summed weight.

    Rows are (x, y, a); the result is written out, as every step reads it.
    """
    usable = rows.where("x IS NOT NULL AND y IS NOT NULL AND a IS NOT NULL AND NOT exists(x, v -> v IS NULL OR isnan(v))")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, mean, square = 0, 0.0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                n, mean, square = merged((n, mean, square), spread(x))
                total += float(batch.column("a").to_numpy(zero_copy_only=False).sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([mean.tolist()]), pa.array([square.tolist()])],
                                             names=["n", "total", "mean", "square"])

    # Two numbers a feature from each task.
    found = usable.select(F.col("x").cast("array<double>").alias("x"), F.col("a").cast("double").alias("a")).mapInArrow(
        moments, "n long, total double, mean array<double>, square array<double>").collect()
    n, centre, square = reduce(merged, [(r.n, np.array(r.mean), np.array(r.square)) for r in found], (0, np.zeros(0), np.zeros(0)))
    scale = np.sqrt(square / max(n - 1, 1))
    scale = np.where(scale > 0, scale, 1.0)
    flat = lambda values: F.array(*[F.lit(float(v)) for v in values])
    moved = F.zip_with(F.zip_with("x", flat(centre), lambda v, c: v - c), flat(scale), lambda v, s: v / s)
    table = materialise(usable.select(moved.alias("x"), F.col("y").cast("double").alias("y"), F.col("a").cast("double").alias("a")))
    return table, centre, scale, float(sum(r.total for r in found))


def fit_focal(rows: DataFrame, gamma: float = 2.0, penalty: float = 0.0, steps: int = 50,
              tolerance: float = 1e-9) -> FocalFit:
    """Fit rows of (x array<double>, y 0/1, a weight) until a step lowers the loss by less than ``tolerance`` of it."""
    table, centre, scale, total = standardised(rows)
    beta, seen = np.zeros(len(centre) + 1), []
    for _ in range(steps if total else 0):
        loss, gradient, curvature = derivatives(table, beta, gamma)
        seen.append(loss / total + penalty / 2 * float(beta[1:] @ beta[1:]))
        step = direction(gradient / total, curvature / total, beta, penalty)
        tried = np.array([beta + t * step for t in STEPS])
        found = losses(table, tried, gamma) / total + penalty / 2 * (tried[:, 1:] ** 2).sum(axis=1)
        best = int(np.argmin(found))
        if not found[best] < seen[-1] * (1 - tolerance):
            break
        beta = tried[best]
    given = beta[1:] / scale
    return FocalFit(np.concatenate([[beta[0] - given @ centre], given]), seen)


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows at a time: fold, class, weight, features."""
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column("block").to_pylist())).reshape(-1, width + 3)
        for at in range(0, len(rows), ROWS_AT_ONCE):
            part = rows[at:at + ROWS_AT_ONCE]
            yield part[:, 0], part[:, 1], part[:, 2], part[:, 3:]


def _training(chunk: tuple, left_out: int, centre: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Standardised rows outside a fold with a leading one, signs and weights."""
    fold, y, a, x = chunk
    kept = fold != left_out
    z = np.empty((int(kept.sum()), len(centre) + 1))
    z[:, 0], z[:, 1:] = 1.0, (x[kept] - centre) / scale
    return z, 2.0 * y[kept] - 1, a[kept]


@dataclass(frozen=True)
class Packed:
    """Rows of (x, y, a, fold) in blocks of bytes, and for every set of rows to fit its moments.

    ``sets`` maps the fold left out (-1: none) to centre, scale and summed weight.
    """

    blocks: DataFrame
    width: int
    sets: dict[int, tuple[np.ndarray, np.ndarray, float]]

    def summed(self, per_chunk, shapes: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
        """Per fit the sum of ``per_chunk``'s matrices; one matrix a fit from each task."""
        width = self.width

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {i: np.zeros(shape) for i, shape in shapes.items()}
            for chunk in _chunks(batches, width):
                per_chunk(chunk, total)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                             names=["fit", "total"])

        def together(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"fit": [pdf["fit"].iat[0]], "total": [sum(np.frombuffer(v) for v in pdf["total"]).tobytes()]})

        found = self.blocks.mapInArrow(partial, "fit int, total binary").groupBy("fit").applyInPandas(together, "fit int, total binary")
        out = {i: np.zeros(shape) for i, shape in shapes.items()}
        for r in found.collect():
            out[r.fit] = np.frombuffer(r.total).reshape(shapes[r.fit])
        return out


def packed(rows: DataFrame, folds: int) -> Packed:
    """Rows of (x array<double>, y 0/1, a weight, fold) written once, with the moments of all rows and of all folds but one."""
    usable = rows.where("x IS NOT NULL AND y IS NOT NULL AND a IS NOT NULL AND NOT exists(x, v -> v IS NULL OR isnan(v))").select(
        F.col("x").cast("array<double>").alias("x"), *[F.col(c).cast("double").alias(c) for c in ("y", "a", "fold")])
    first = usable.select(F.size("x").alias("n")).first()
    width = first.n if first else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # A row without a fold belongs to every training side.
                fold, y, a = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "y", "a"))
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                table = np.column_stack([np.where(np.isnan(fold), -2.0, fold), y, a, x])
                yield pa.RecordBatch.from_arrays([pa.array([table[at:at + ROWS_PER_RECORD].tobytes() for at in range(0, len(table), ROWS_PER_RECORD)], pa.binary())],
                                                 names=["block"])

    blocks = materialise(usable.mapInArrow(pack, "block binary"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for fold, _, a, x in _chunks(batches, width):
            for k in np.unique(fold):
                at = fold == k
                total, one = found.get(k, (0.0, (0, 0.0, 0.0)))
                found[k] = total + float(a[at].sum()), merged(one, spread(x[at]))
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array([int(k) for k in found]), pa.array([one[0] for _, one in found.values()]), pa.array([total for total, _ in found.values()]),
                pa.array([one[1].tolist() for _, one in found.values()]), pa.array([one[2].tolist() for _, one in found.values()])],
                names=["fold", "n", "total", "mean", "square"])

    # Two numbers a feature and fold from each task.
    parts = blocks.mapInArrow(moments, "fold long, n long, total double, mean array<double>, square array<double>").collect()
    sets = {}
    for left_out in (-1, *range(folds)):
        own = [r for r in parts if r.fold != left_out]
        n, centre, square = reduce(merged, [(r.n, np.array(r.mean), np.array(r.square)) for r in own], (0, np.zeros(width), np.zeros(width)))
        scale = np.sqrt(square / max(n - 1, 1))
        sets[left_out] = centre, np.where(scale > 0, scale, 1.0), float(sum(r.total for r in own))
    return Packed(blocks, width, sets)


def fit_folds(data: Packed, fits: list[tuple[int, float]], gamma: float = 2.0, steps: int = 50, tolerance: float = 1e-9) -> list[FocalFit]:
    """``fit_focal`` for each (fold left out, penalty), all moved on by the same passes over the rows."""
    betas, seen = [np.zeros(data.width + 1) for _ in fits], [[] for _ in fits]
    sets = data.sets
    going = [i for i, (left_out, _) in enumerate(fits) if sets[left_out][2]]
    for _ in range(steps):
        if not going:
            break
        by_set = {k: [i for i in going if fits[i][0] == k] for k in sets}

        def bend(chunk, total, by_set=by_set, betas=tuple(betas)):
            for k, members in by_set.items():
                if members:
                    x, sign, a = _training(chunk, k, *sets[k][:2])
                    for i in members:
                        total[i] += _derivatives(x, sign, a, betas[i], gamma)

        found, moves = data.summed(bend, {i: (data.width + 2,) * 2 for i in going}), {}
        for i in going:
            (left_out, penalty), beta = fits[i], betas[i]
            weight, total = sets[left_out][2], found[i]
            seen[i].append(float(total[0, -1]) / weight + penalty / 2 * float(beta[1:] @ beta[1:]))
            moves[i] = direction(total[1:, -1] / weight, total[1:, :-1] / weight, beta, penalty)

        def tries(chunk, total, by_set=by_set, betas=tuple(betas), moves=moves):
            for k, members in by_set.items():
                if members:
                    x, sign, a = _training(chunk, k, *sets[k][:2])
                    for i in members:
                        here, move = sign * (x @ betas[i]), sign * (x @ moves[i])
                        for n, t in enumerate(STEPS):
                            total[i][n, 0] += a @ plain_loss(here + t * move, gamma)

        lengths, left = data.summed(tries, {i: (len(STEPS), 1) for i in going}), []
        for i in going:
            left_out, penalty = fits[i]
            tried = np.array([betas[i] + t * moves[i] for t in STEPS])
            values = lengths[i][:, 0] / sets[left_out][2] + penalty / 2 * (tried[:, 1:] ** 2).sum(axis=1)
            best = int(np.argmin(values))
            if values[best] < seen[i][-1] * (1 - tolerance):
                betas[i] = tried[best]
                left.append(i)
        going = left
    out = []
    for (left_out, _), beta, losses_ in zip(fits, betas, seen):
        centre, scale, _ = sets[left_out]
        given = beta[1:] / scale
        out.append(FocalFit(np.concatenate([[beta[0] - given @ centre], given]), losses_))
    return out


def held_scores(data: Packed, found: dict[tuple[int, int], FocalFit]) -> DataFrame:
    """``target``, ``fold``, ``shape`` and the probability that the fit of (shape, fold) gives to each row of that fold, in one pass."""
    betas, width = {key: fit.beta for key, fit in found.items()}, data.width

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, y, _, x in _chunks(batches, width):
            for (shape, k), beta in betas.items():
                at = np.flatnonzero(fold == k)
                if len(at):
                    score = np.exp(-np.logaddexp(0, -(x[at] @ beta[1:] + beta[0])))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(y[at].astype(np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), shape, np.int32)), pa.array(score)],
                        names=["target", "fold", "shape", "score"])

    return data.blocks.mapInArrow(scored, "target int, fold int, shape int, score double")


class FocalLogistic(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, HasMaxIter, HasRegParam, HasTol):
    """``fit_focal`` as an estimator; its model is a plain logistic regression model."""

    gamma = Param(Params._dummy(), "gamma", "how little rows that are right count", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol=None, maxIter=50, regParam=0.0,
                 tol=1e-9, gamma=2.0):
        super().__init__()
        self._setDefault(maxIter=50, regParam=0.0, tol=1e-9, gamma=2.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _rows(self, dataset: DataFrame, *more: str) -> DataFrame:
        weight = F.col(self.getWeightCol()) if self.isSet("weightCol") else F.lit(1.0)
        return dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).alias("y"), weight.alias("a"), *more)

    def _model(self, beta: np.ndarray) -> LogisticRegressionModel:
        spark = SparkSession.active()
        made = LogisticRegressionModel(spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
            self.uid, _py2java(spark.sparkContext, Vectors.dense(beta[1:])), float(beta[0])))
        return made.setFeaturesCol(self.getFeaturesCol())

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        rows = self._rows(dataset)
        fit = fit_focal(rows, self.getOrDefault(self.gamma), self.getRegParam(), self.getMaxIter(), self.getTol())
        return self._model(fit.beta)

    def search(self, dataset: DataFrame, folds: int, penalties: list[float]) -> tuple[list, dict, DataFrame]:
        """For each penalty the model of all rows, by (penalty's place, fold) that of the other folds, and their scores of the fold.

        All are fitted together, so the models of all rows cost no passes of their own.
        """
        data = packed(self._rows(dataset, "fold"), folds)
        keys = [(s, k) for s in range(len(penalties)) for k in (-1, *range(folds))]
        found = dict(zip(keys, fit_folds(data, [(k, penalties[s]) for s, k in keys], self.getOrDefault(self.gamma),
                                         self.getMaxIter(), self.getTol())))
        models = {key: self._model(fit.beta) for key, fit in found.items()}
        scores = held_scores(data, {key: fit for key, fit in found.items() if key[1] >= 0})
        return [models[s, -1] for s in range(len(penalties))], models, scores
