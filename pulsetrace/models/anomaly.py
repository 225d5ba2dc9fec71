"""The anomaly branch: models that see benign rows only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS, Settings
from pulsetrace.functions.hashing import hash60
from pulsetrace.models.supervised import learn_inputs
from pulsetrace.operators import encode
from pulsetrace.operators.anomaly_scores import benign_threshold, normalised
from pulsetrace.session import materialise


@dataclass(frozen=True)
class Scaled:
    """Encoding and scaling learned on benign rows; adds ``z``, the standardised inputs."""

    stages: PipelineModel
    names: list[str]

    def transform(self, rows: DataFrame) -> DataFrame:
        ready = self.stages.transform(rows)
        added = [c for c in ready.columns if c not in rows.columns and c != "z"]
        return ready.drop(*added)


def learn_scaling(benign: DataFrame, columns: Sequence[str] | None = None) -> Scaled:
    inputs = learn_inputs(benign, columns)
    coded = Pipeline(stages=inputs.stages[:-1]).fit(benign)
    stats = encode.scaling(coded.transform(benign), inputs.features)
    stages = [*coded.stages, encode.standardise(stats),
              encode.assembler([f"{c}_z" for c in inputs.features], "z")]
    return Scaled(PipelineModel(stages), inputs.features)


# ------------------------------------------------------------------ principal components


@dataclass(frozen=True)
class Components:
    """Best linear reconstruction from k components."""

    scaled: Scaled
    pca: object

    def error(self, rows: DataFrame, output: str = "error") -> DataFrame:
        """Mean squared reconstruction error: what the kept components leave of the squared length."""
        ready = self.pca.transform(self.scaled.transform(rows))

        def squares(name):
            return F.aggregate(vector_to_array(name), F.lit(0.0), lambda a, x: a + x * x)

        left = F.greatest(squares("z") - squares("kept"), F.lit(0.0))
        return ready.withColumn(output, left / F.lit(float(len(self.scaled.names)))).drop("z", "kept")


def train_components(benign: DataFrame, k: int = 8, columns: Sequence[str] | None = None) -> Components:
    scaled = learn_scaling(benign, columns)
    pca = PCA(k=min(k, len(scaled.names)), inputCol="z", outputCol="kept").fit(
        scaled.transform(benign).select("z"))
    return Components(scaled, pca)


# ------------------------------------------------------------------ autoencoder


def _layers(n: int, hidden: Sequence[int]) -> list[tuple[int, int]]:
    sizes = [n, *hidden, n]
    return list(zip(sizes[:-1], sizes[1:]))


def _unpack(flat: np.ndarray, layers) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in layers:
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def _forward(x: np.ndarray, weights, masks=None) -> list[np.ndarray]:
    """Activations of every layer; all but the last are rectified (and thinned by the masks)."""
    values = [x]
    for i, (w, b) in enumerate(weights):
        y = values[-1] @ w + b
        if i < len(weights) - 1:
            y = np.maximum(y, 0.0)
            if masks is not None:
                y = y * masks[i]
        values.append(y)
    return values


def _gradient(x: np.ndarray, weights, rng, dropout: float) -> np.ndarray:
    """Gradient of the summed (over rows) mean squared error, flat."""
    keep = 1.0 - dropout
    masks = [(rng.random((len(x), len(b))) < keep) / keep for _, b in weights[:-1]]
    values = _forward(x, weights, masks)
    delta = 2.0 * (values[-1] - x) / x.shape[1]
    parts = []
    for i in reversed(range(len(weights))):
        parts.append(np.concatenate([(values[i].T @ delta).ravel(), delta.sum(axis=0)]))
        if i:
            delta = (delta @ weights[i][0].T) * masks[i - 1] * (values[i] > 0)
    return np.concatenate(parts[::-1])


@dataclass(frozen=True)
class Autoencoder:
    scaled: Scaled
    flat: np.ndarray
    hidden: tuple[int, ...]
    validation_loss: float
    epochs: int

    def error(self, rows: DataFrame, output: str = "error") -> DataFrame:
        layers, flat = _layers(len(self.scaled.names), self.hidden), self.flat

        @F.pandas_udf("double")
        def reconstruction(z: pd.Series) -> pd.Series:
            if not len(z):
                return pd.Series([], dtype=float)
            x = np.stack(z.to_numpy())
            return pd.Series(((_forward(x, _unpack(flat, layers))[-1] - x) ** 2).mean(axis=1))

        return self.scaled.transform(rows).withColumn(
            output, reconstruction(vector_to_array("z"))).drop("z")


#: Rows of one lane of the training; a constant of the method, not of the data.
LANE_ROWS = 8192


def train_autoencoder(benign: DataFrame, settings: Settings = DEFAULTS,
                      columns: Sequence[str] | None = None, key: str = "session_id") -> Autoencoder:
    """Data-parallel training by mini-batches with averaged weights.

    The rows are dealt into lanes of about ``LANE_ROWS`` by hash. In each pass every lane takes Adam steps over
    mini-batches of its rows, from the shared weights and moments; the results are averaged by rows and
    become the next pass' start. A lane is one group, so the outcome does not depend on partitions. A
    tenth of the rows measures the loss of the shared weights and stops training when it no longer falls.
    """
    scaled = learn_scaling(benign, columns)
    place = hash60(settings.seed, key, "lane")
    total = benign.count()
    lanes = max(1, total // LANE_ROWS)
    data = materialise(scaled.transform(benign).select(
        vector_to_array("z").alias("x"), place.alias("place"), F.pmod(place, F.lit(lanes)).alias("lane"),
        (F.pmod(hash60(settings.seed, key, "validation"), F.lit(10)) == 0).alias("held")))
    layers = _layers(len(scaled.names), settings.autoencoder_hidden)
    rng = np.random.default_rng(settings.seed)
    flat = np.concatenate([np.concatenate([
        rng.uniform(-1, 1, a * b) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)])
        for a, b in layers])
    size, state = len(flat), np.concatenate([flat, np.zeros(2 * len(flat))])
    best, best_loss, waited, epoch = flat, np.inf, 0, 0
    rate, dropout, seed = settings.autoencoder_rate, settings.autoencoder_dropout, settings.seed
    rows, inner = settings.autoencoder_batch, settings.autoencoder_inner_passes

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        return pd.DataFrame({"lane": [int(pdf["lane"].iat[0])], "x": [np.stack(pdf["x"].to_numpy()).tobytes()],
                             "held": [pdf["held"].to_numpy(bool).tobytes()]})

    def lane_pass(lane: int, x: np.ndarray, held: np.ndarray, shared: np.ndarray, epoch: int) -> tuple[int, int, float, np.ndarray]:
        now, first, second = (shared[i * size:(i + 1) * size].copy() for i in range(3))
        check, fit = x[held], x[~held]
        loss = float(((_forward(check, _unpack(now, layers))[-1] - check) ** 2).mean(axis=1).sum()) if len(check) else 0.0
        draw = np.random.default_rng([seed, epoch, lane])
        step = (epoch - 1) * inner * max(1, -(-len(fit) // rows))
        for _ in range(inner):
            order = draw.permutation(len(fit))
            for lo in range(0, len(fit), rows):
                part = fit[order[lo:lo + rows]]
                gradient = _gradient(part, _unpack(now, layers), draw, dropout) / len(part)
                step += 1
                first = 0.9 * first + 0.1 * gradient
                second = 0.999 * second + 0.001 * gradient ** 2
                now = now - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        return len(fit), len(check), loss, np.concatenate([now, first, second]) * len(fit)

    def pass_of(shared: np.ndarray, epoch: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, held, loss, sums = 0, 0, 0.0, np.zeros(3 * size)
            for pdf in batches:
                for lane, x, marks in zip(pdf["lane"], pdf["x"], pdf["held"]):
                    one = lane_pass(lane, np.frombuffer(x).reshape(len(marks), -1), np.frombuffer(marks, bool), shared, epoch)
                    n, held, loss, sums = n + one[0], held + one[1], loss + one[2], sums + one[3]
            if n + held:
                yield pd.DataFrame({"n": [n], "held": [held], "loss": [loss], "state": [sums.tobytes()]})
        return run

    # The rows are shuffled once: a lane stays one packed row of the same task for all passes, a few lanes to a task.
    tasks = min(lanes, max(4 * data.sparkSession.sparkContext.defaultParallelism, -(-lanes // 16)))
    stored = data.repartitionByRange(tasks, "lane").groupBy("lane").applyInPandas(
        packed, "lane bigint, x binary, held binary").persist(StorageLevel.MEMORY_AND_DISK)
    kind = "n bigint, held bigint, loss double, state binary"
    for epoch in range(1, settings.autoencoder_epochs + 1):
        # One row per task: the weights and moments, some ten thousand numbers.
        parts = stored.mapInPandas(pass_of(state, epoch), kind).collect()
        n, held = sum(r["n"] for r in parts), sum(r["held"] for r in parts)
        loss = sum(r["loss"] for r in parts) / held if held else 0.0
        if loss < best_loss:
            best, best_loss, waited = state[:size], loss, 0
        else:
            waited += 1
            if waited >= settings.autoencoder_patience:
                break
        if n:
            state = sum(np.frombuffer(r["state"]) for r in parts) / n
    stored.unpersist()
    return Autoencoder(scaled, best, tuple(settings.autoencoder_hidden), float(best_loss), epoch)


# ------------------------------------------------------------------ isolation forest


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random tree of n points."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


NODES = "tree int, node int, feature int, cut double, left int, right int, size int"


def _grow(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One isolation tree from its sample."""
    tree = int(pdf["tree"].iat[0])
    x = np.stack(pdf.sort_values("_h")["x"].to_numpy())
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = []

    def split(points, depth):
        number = len(nodes)
        nodes.append([tree, number, -1, 0.0, -1, -1, len(points)])
        spread = np.flatnonzero(np.ptp(points, axis=0) > 0) if len(points) > 1 else []
        if depth < limit and len(spread):
            f = int(rng.choice(spread))
            cut = float(rng.uniform(points[:, f].min(), points[:, f].max()))
            below = points[:, f] <= cut
            nodes[number][2:4] = [f, cut]
            nodes[number][4] = split(points[below], depth + 1)
            nodes[number][5] = split(points[~below], depth + 1)
        return number

    split(x, 0)
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "size"])


@dataclass(frozen=True)
class IsolationForest:
    scaled: Scaled
    nodes: pd.DataFrame
    sample: int

    def error(self, rows: DataFrame, output: str = "error") -> DataFrame:
        """Isolation score minus one half: higher means easier to isolate."""
        trees = [t.sort_values("node").reset_index(drop=True) for _, t in self.nodes.groupby("tree")]
        usual = float(_average_path(self.sample))

        @F.pandas_udf("double")
        def score(z: pd.Series) -> pd.Series:
            if not len(z):
                return pd.Series([], dtype=float)
            x = np.stack(z.to_numpy())
            depth = np.zeros(len(x))
            for t in trees:
                feature, cut = t["feature"].to_numpy(), t["cut"].to_numpy()
                left, right = t["left"].to_numpy(), t["right"].to_numpy()
                rest = _average_path(t["size"].to_numpy())
                at, steps = np.zeros(len(x), dtype=int), np.zeros(len(x))
                inner = np.flatnonzero(feature[at] >= 0)
                while len(inner):
                    here = at[inner]
                    below = x[inner, feature[here]] <= cut[here]
                    at[inner] = np.where(below, left[here], right[here])
                    steps[inner] += 1
                    inner = inner[feature[at[inner]] >= 0]
                depth += steps + rest[at]
            return pd.Series(2.0 ** (-depth / len(trees) / max(usual, 1e-9)) - 0.5)

        return self.scaled.transform(rows).withColumn(
            output, score(vector_to_array("z"))).drop("z")


def train_isolation_forest(benign: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42,
                           columns: Sequence[str] | None = None,
                           key: str = "session_id") -> IsolationForest:
    """Each tree is grown in its own task from the ``sample`` rows that hash lowest for it.

    A row draws only as many trees as the sample needs, and a hash bound thins the rest before the
    per-tree ranking, which therefore sees about twice the sample whatever the table size.
    """
    scaled = learn_scaling(benign, columns)
    total = benign.count()
    draws = min(trees, max(1, -(-2 * trees * sample // max(total, 1))))
    needed = min(1.0, 2.0 * trees * sample / max(total * draws, 1))
    spread = (scaled.transform(benign).select(key, vector_to_array("z").alias("x"))
              .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))))
    token = F.xxhash64(key, F.lit(seed), F.floor(F.col("draw")))
    chance = F.pmod(F.xxhash64(F.lit("kept"), key, F.lit(seed), "draw"), F.lit(1 << 30))
    # Consecutive draws walk to consecutive trees, so a row enters a tree once.
    tree = F.pmod(F.xxhash64(key, F.lit(seed)) + F.col("draw"), F.lit(trees)).cast("int")
    chosen = spread.where(chance < int(needed * (1 << 30))).select(
        tree.alias("tree"), token.alias("_h"), "x")
    best = F.slice(F.sort_array(F.collect_list(F.struct("_h", "x"))), 1, sample)
    samples = chosen.groupBy("tree").agg(best.alias("rows")).select("tree", F.inline("rows"))
    grown = samples.groupBy("tree").applyInPandas(
        lambda pdf: _grow(pdf, seed), NODES).toPandas()  # trees x 2 x sample rows
    return IsolationForest(scaled, grown, min(sample, total))


# ------------------------------------------------------------------ distance to the benign mean


@dataclass(frozen=True)
class Distance:
    scaled: Scaled
    inverse: np.ndarray

    def error(self, rows: DataFrame, output: str = "error") -> DataFrame:
        """Squared Mahalanobis distance per input."""
        inverse = self.inverse

        @F.pandas_udf("double")
        def distance(z: pd.Series) -> pd.Series:
            if not len(z):
                return pd.Series([], dtype=float)
            x = np.stack(z.to_numpy())
            return pd.Series(np.einsum("ij,jk,ik->i", x, inverse, x) / x.shape[1])

        return self.scaled.transform(rows).withColumn(
            output, distance(vector_to_array("z"))).drop("z")


def train_distance(benign: DataFrame, ridge: float = 0.05,
                   columns: Sequence[str] | None = None) -> Distance:
    """Benign correlation of the standardised inputs, ridge-regularised and inverted on the driver."""
    scaled = learn_scaling(benign, columns)
    matrix = Correlation.corr(scaled.transform(benign).select("z"), "z").first()[0].toArray()
    matrix = np.where(np.isnan(matrix), 0.0, matrix)
    np.fill_diagonal(matrix, 1.0)
    return Distance(scaled, np.linalg.inv((1 - ridge) * matrix + ridge * np.eye(len(matrix))))


# ------------------------------------------------------------------ common use

TRAINERS = {
    "components": lambda benign, settings, columns: train_components(benign, columns=columns),
    "autoencoder": lambda benign, settings, columns: train_autoencoder(benign, settings, columns),
    "isolation_forest": lambda benign, settings, columns: train_isolation_forest(
        benign, seed=settings.seed, columns=columns),
    "distance": lambda benign, settings, columns: train_distance(benign, columns=columns),
}


@dataclass(frozen=True)
class Detector:
    """A fitted model with the benign threshold that centres its score."""

    model: object
    threshold: float

    def score(self, rows: DataFrame, output: str = "anomaly_score") -> DataFrame:
        scored = self.model.error(rows, "_error")
        return scored.withColumn(output, normalised("_error", self.threshold)).drop("_error")


def train_detector(name: str, train: DataFrame, settings: Settings = DEFAULTS,
                   columns: Sequence[str] | None = None) -> Detector:
    """Fit on the benign training rows; the threshold is a percentile of their own errors."""
    if name not in TRAINERS:
        raise ValueError(f"unknown anomaly model: {name}")
    benign = train.where("target = 0")
    model = TRAINERS[name](benign, settings, columns)
    errors = materialise(model.error(benign).select("target", "error"))
    return Detector(model, benign_threshold(errors, percentile=settings.benign_percentile))
