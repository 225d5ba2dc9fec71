"""Model-agnostic attribution: a weighted regression of the score on which features a row brings.

A coalition is a set of features taken from the row, the others coming from a background row; its value is the mean
score over the whole background. Shapley values are the coefficients of the regression of these values on the
coalitions' indicators under the Shapley kernel, constrained to add up to the row's score less the background's.
All sets of one feature, and of all but one, are asked; sets of the sizes between are drawn by the kernel, each with
its complement, and share the kernel's remaining weight.

Every row is asked for the same sets, so the matrix of the normal equations is one d x d matrix; its right side is
summed per row from one number for each coalition, combined before the shuffle.

Cost: coalitions x background rows scores per explained row, by default about 4 d x 100. Where the score is a logistic
function of a weighted sum, the sum of a mixed row is the row's part plus the background's, so a task computes these scores
from the two parts, all sets and background rows of a session together, and nothing is shuffled. Any other model is given
the mixed rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetrace.functions.hashing import hash60
from pulsetrace.models.supervised import positive_probability

BACKGROUND_ROWS = 100
#: Scores held at a time by a task of a logistic model.
SCORES_HELD = 1_000_000


def coalitions(d: int, drawn: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Indicators (sets, d) and kernel weights: the outer sizes whole, ``drawn`` sets of the sizes between."""
    mass = {s: (d - 1) / (s * (d - s)) for s in range(1, d)}
    rows, weights = [], []
    for size in sorted({1, d - 1} & set(mass)):
        for i in range(d):
            rows.append([int((j == i) == (size == 1)) for j in range(d)])
            weights.append(mass[size] / d)
    inner = [s for s in mass if 2 <= s <= d - 2]
    rng, counts = random.Random(seed), {}
    for _ in range(drawn // 2 if inner else 0):
        members = frozenset(rng.sample(range(d), rng.choices(inner, [mass[s] for s in inner])[0]))
        for one in (members, frozenset(range(d)) - members):
            counts[one] = counts.get(one, 0) + 1
    rest = sum(mass[s] for s in inner)
    for members, n in counts.items():
        rows.append([int(j in members) for j in range(d)])
        weights.append(rest * n / sum(counts.values()))
    return np.array(rows, float).reshape(-1, d), np.array(weights)


def solution(sets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and vector that turn the normal equations' right side and the total into the coefficients."""
    d = sets.shape[1]
    inverse = np.linalg.pinv(sets.T @ (weights[:, None] * sets)) if len(sets) else np.eye(d)
    ones = inverse.sum(axis=1)
    return inverse - np.outer(ones, ones) / ones.sum(), ones / ones.sum()


def logistic(margin: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-margin)), in place."""
    np.negative(margin, out=margin)
    with np.errstate(over="ignore"):
        np.exp(margin, out=margin)
    margin += 1.0
    return np.reciprocal(margin, out=margin)


def logistic_shares(rows: DataFrame, model: LogisticRegressionModel, sample: np.ndarray, sets: np.ndarray, weights: np.ndarray,
                    matrix: np.ndarray, share: np.ndarray) -> DataFrame:
    """``session_id`` and coefficients ``_phi`` under a two-class logistic model."""
    slope, start = model.coefficients.toArray(), float(model.intercept)
    base = float(logistic(sample @ slope + start).mean())
    d = sets.shape[1]
    others = (1.0 - sets) @ (sample * slope).T + start  # what the background adds: sets x background rows
    step = max(1, SCORES_HELD // max(others.size, 1))
    to_phi = matrix @ (weights[:, None] * sets).T

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) * slope
            found = np.outer(logistic(x.sum(axis=1) + start) - base, share)
            own = x @ sets.T
            for lo in range(0, len(x) if len(sets) else 0, step):
                values = logistic(own[lo: lo + step, :, None] + others[None]).mean(axis=2)
                found[lo: lo + step] += (values - base) @ to_phi.T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * d, pa.int32()), pa.array(found.ravel()))],
                names=["session_id", "_phi"])

    return rows.select("session_id", vector_to_array("features").alias("_x")).mapInArrow(
        explained, "session_id string, _phi array<double>")


def listed(shares: DataFrame, features: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(n) for n in features])
    return shares.select("session_id", F.inline(F.arrays_zip(names.alias("feature"), F.col("_phi").alias("attribution"))))


def sampled_attribution(rows: DataFrame, background: DataFrame, model, features: Sequence[str],
                        drawn: int | None = None, seed: int = 42) -> DataFrame:
    """``session_id``, ``feature``, ``attribution`` of every row; ids are distinct.

    ``drawn``: sets of the sizes between (default twice the number of features).
    """
    d = len(features)
    sample = np.array([r[0] for r in background.orderBy(hash60(seed, "session_id", "background"))
                       .limit(BACKGROUND_ROWS).select(vector_to_array("features")).collect()])
    sets, weights = coalitions(d, 2 * d if drawn is None else drawn, seed)
    matrix, share = solution(sets, weights)
    if isinstance(model, LogisticRegressionModel) and model.numClasses == 2:
        return listed(logistic_shares(rows, model, sample, sets, weights, matrix, share), features)
    taken = sets.astype(bool)

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for lo in range(0, len(taken), 64):
                    part = taken[lo: lo + 64]
                    values = np.where(part[:, None, :], np.array(one), sample[None]).reshape(-1, d)
                    ends = pa.array(np.arange(len(values) + 1) * d, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(values), pa.string()), pa.array(np.repeat(np.arange(lo, lo + len(part)), len(sample)), pa.int32()),
                         pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=["session_id", "_set", "_x"])

    asked = rows.select("session_id", vector_to_array("features").alias("_x")).mapInArrow(
        mixed, "session_id string, _set int, _x array<double>")
    values = (model.transform(asked.select("session_id", "_set", array_to_vector("_x").alias("features")))
              .groupBy("session_id", "_set").agg(F.avg(positive_probability()).alias("_v")))
    spark = rows.sparkSession
    # Fixed size: one row of d numbers per set.
    design = F.broadcast(spark.createDataFrame([(i, (w * z).tolist()) for i, (z, w) in enumerate(zip(sets, weights))], "_set int, _zw array<double>"))
    score_of = spark.createDataFrame([(x.tolist(),) for x in sample], "_x array<double>")
    base = model.transform(score_of.select(array_to_vector("_x").alias("features"))).agg(F.avg(positive_probability())).first()[0]
    total = model.transform(rows.select("session_id", "features")).select("session_id", (positive_probability() - F.lit(base)).alias("_total"))
    right = values.join(design, "_set").groupBy("session_id").agg(F.array(*[
        F.sum(F.get("_zw", i) * (F.col("_v") - F.lit(base))) for i in range(d)]).alias("_right"))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = np.array(batch.column(2).to_pylist(), float).reshape(-1, d)
            found = side @ matrix.T + np.outer(batch.column(1).to_numpy(), share)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * d, pa.int32()), pa.array(found.ravel()))],
                names=["session_id", "_phi"])

    zeros = F.array(*[F.lit(0.0)] * d)
    sides = total.join(right, "session_id", "left").select("session_id", "_total", F.coalesce("_right", zeros).alias("_right"))
    return listed(sides.mapInArrow(solved, "session_id string, _phi array<double>"), features)
