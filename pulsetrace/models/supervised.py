"""The supervised branch: tuned, weighted and calibrated classifiers from pyspark.ml."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS, STATE_CATEGORIES, Settings
from pulsetrace.functions.hashing import hash60
from pulsetrace.models.focal import FocalLogistic
from pulsetrace.operators import encode
from pulsetrace.operators.curves import average_precision
from pulsetrace.operators.order_stats import cut_at_fractions
from pulsetrace.operators.smote import smote
from pulsetrace.session import keep_checkpoints, materialise

MODELS = ("random_forest", "gradient_boosting", "logistic_regression")
DEEPEST = 30  # the deepest tree pyspark.ml grows


def positive_probability(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


class Forest(RandomForestClassificationModel):
    """The model without a Python object for each tree, which pyspark makes of every model: some 40 calls a tree."""

    trees = property(RandomForestClassificationModel.trees.func)


class Boosted(GBTClassificationModel):
    """As ``Forest``."""

    trees = property(GBTClassificationModel.trees.func)


class ForestClassifier(RandomForestClassifier):
    def _create_model(self, java_model) -> Forest:
        return Forest(java_model)


class BoostedClassifier(GBTClassifier):
    """Rounds build on each other's rows, so their lineage is cut every ``checkpointInterval`` rounds."""

    def _create_model(self, java_model) -> Boosted:
        return Boosted(java_model)

    def _fit(self, dataset: DataFrame) -> Boosted:
        keep_checkpoints(dataset.sparkSession)
        return super()._fit(dataset)


@dataclass(frozen=True)
class Inputs:
    """Encoding learned on the training rows and the resulting feature names."""

    stages: list
    features: list[str]


def learn_inputs(train: DataFrame, columns: Sequence[str] | None = None) -> Inputs:
    """Encoder and assembler for the given columns (default: every feature of the frame)."""
    chosen = list(columns) if columns is not None else [
        *encode.numeric_columns(train), *(c for c in STATE_CATEGORIES if c in train.columns)]
    categories = [c for c in STATE_CATEGORIES if c in chosen]
    numbers = [c for c in chosen if c not in categories]
    if not categories:
        return Inputs([encode.assembler(numbers)], numbers)
    words = encode.vocabulary(train, categories)
    names = [*numbers, *encode.dummy_columns(words)]
    return Inputs([encode.one_hot(words), encode.assembler(names)], names)


@dataclass(frozen=True)
class Grid:
    """An unfitted classifier, its parameter maps without the ensemble's size, and the sizes to compare.

    ``sizes`` is empty for a model that is no ensemble; ``size`` names the parameter that holds it.
    """

    estimator: object
    shapes: list[dict]
    size: object = None
    sizes: tuple[int, ...] = ()

    def largest(self, shape: dict) -> dict:
        return {**shape, self.size: self.sizes[-1]} if self.sizes else dict(shape)

    @property
    def points(self) -> int:
        return len(self.shapes) * max(1, len(self.sizes))


def estimator(name: str, settings: Settings, total_weight: float, weighted: bool = True) -> Grid:
    """The unfitted classifier and its parameter grid."""
    common = {"featuresCol": "features", "labelCol": "target"}
    if weighted:
        common["weightCol"] = "weight"
    if name == "random_forest":
        est = ForestClassifier(seed=settings.seed, **common)
        grid = (ParamGridBuilder()
                .addGrid(est.maxDepth, [d or DEEPEST for d in settings.forest_depth])
                .addGrid(est.minInstancesPerNode, list(settings.forest_min_leaf)))
        return Grid(est, grid.build(), est.numTrees, tuple(sorted(settings.forest_trees)))
    if name == "gradient_boosting":
        est = BoostedClassifier(seed=settings.seed, **common)
        grid = (ParamGridBuilder()
                .addGrid(est.maxDepth, list(settings.boost_depth))
                .addGrid(est.stepSize, list(settings.boost_step)))
        return Grid(est, grid.build(), est.maxIter, tuple(sorted(settings.boost_rounds)))
    if name == "logistic_regression":
        focal = settings.imbalance == "focal_loss"
        est = FocalLogistic(gamma=settings.focal_gamma, **common) if focal else LogisticRegression(maxIter=200, **common)
        # The usual C is the inverse of the penalty on the summed, not the mean, loss.
        grid = ParamGridBuilder().addGrid(
            est.regParam, [1.0 / (c * total_weight) for c in settings.logistic_c])
        return Grid(est, grid.build())
    raise ValueError(f"unknown model: {name}")


def side_by_side(spark: SparkSession, rows: int, width: int, trees: int = 0, most: int = 8) -> int:
    """How many fits to run at a time: as many as half of the session's storage memory holds the rows of.

    A fit keeps ``width`` numbers a row, and a forest how often each of its trees drew the row. Beyond that memory,
    fits side by side would only push each other's rows to disk, and one fit has tasks for all cores.
    """
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    driver = jvm.org.apache.spark.SparkEnv.get().blockManager().blockManagerId().hostPort()
    held, pairs = {}, sc.getExecutorMemoryStatus().iterator()
    while pairs.hasNext():
        pair = pairs.next()
        held[pair._1()] = pair._2()._1()
    room = sum(v for k, v in held.items() if k != driver or len(held) == 1) / 2
    return max(1, min(most, int(room // max(1, rows * (8 * width + 4 * trees)))))


def stratified_folds(df: DataFrame, settings: Settings = DEFAULTS, key: str = "session_id",
                     ) -> tuple[DataFrame, int]:
    """Add ``fold`` with the same class shares in every fold.

    With fewer positives than folds, fewer folds are used, so that each holds a positive.
    """
    positives = df.where("target = 1").count()
    folds = max(2, min(settings.cv_folds, positives))
    keyed = df.withColumn("_h", hash60(settings.seed, key, "fold"))
    part = cut_at_fractions(keyed, "target", "_h", [i / folds for i in range(1, folds)])
    return keyed.withColumn("fold", part.cast("int")).drop("_h"), folds


def part_of(model, start: int, stop: int):
    """The ensemble of a fitted ensemble's trees ``start`` to ``stop``, as a model of its own."""
    java, jvm = model._java_obj, SparkSession.active()._jvm
    ml, uid, boosted = jvm.org.apache.spark.ml, f"{java.uid()}_{start}_{stop}", isinstance(model, GBTClassificationModel)

    def run(array, kind):
        out = SparkSession.active().sparkContext._gateway.new_array(kind, stop - start)
        jvm.java.lang.System.arraycopy(array, start, out, 0, stop - start)
        return out

    if boosted:
        made = ml.classification.GBTClassificationModel(
            uid, run(java.trees(), ml.regression.DecisionTreeRegressionModel), run(java.treeWeights(), jvm.double),
            java.numFeatures(), java.numClasses())
    else:
        made = ml.classification.RandomForestClassificationModel(
            uid, run(java.trees(), ml.classification.DecisionTreeClassificationModel), java.numFeatures(), java.numClasses())
    made = java.copyValues(made, java.extractParamMap())
    made.set(made.getParam("maxIter" if boosted else "numTrees"), stop - start)
    return (Boosted if boosted else Forest)(made)


def prefix_scores(model, rows: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``target``, ``size`` and the ``score`` that the first ``size`` trees give, for all sizes in one pass.

    Trees are evaluated once: each run of them between two sizes gives a partial sum (votes of a forest, margin
    of boosted trees), and a prefix is the sum of the runs before its end.
    """
    boosted = isinstance(model, GBTClassificationModel)
    out, total, found = rows, None, []
    for n, (start, stop) in enumerate(zip((0, *sizes), sizes)):
        run = part_of(model, start, stop).setRawPredictionCol(f"_raw{n}").setProbabilityCol("").setPredictionCol("")
        out = run.transform(out)
        votes = vector_to_array(f"_raw{n}")
        one = votes[1] if boosted else F.struct(votes[1].alias("for"), (votes[0] + votes[1]).alias("all"))
        if boosted:
            total = one if total is None else total + one
            score = 1 / (1 + F.exp(-2 * total))
        else:
            total = (one["for"], one["all"]) if total is None else (total[0] + one["for"], total[1] + one["all"])
            score = total[0] / total[1]
        found.append(F.struct(F.lit(stop).alias("size"), score.alias("score")))
    return out.select("target", F.inline(F.array(*found)))


def fold_precision(model, held: DataFrame, sizes: Sequence[int]) -> list[float]:
    """Average precision on the held-out fold, of every size of an ensemble or of the model itself."""
    if not sizes:
        scored = model.transform(held).select("target", positive_probability().alias("score"))
        return [average_precision(scored).first()["pr_auc"] or 0.0]
    found = {r["size"]: r["pr_auc"] or 0.0 for r in average_precision(prefix_scores(model, held, sizes), by=["size"]).collect()}
    return [found.get(n, 0.0) for n in sizes]


@dataclass(frozen=True)
class Search:
    """The refitted best model, its parameters and mean score, and its folds' models where they were fitted."""

    model: object
    params: dict
    score: float | None
    fold_models: list | None


def tuned(name: str, rows: DataFrame, folds: int, settings: Settings, total_weight: float,
          weighted: bool, parallelism: int = 8) -> Search:
    """Grid search by stratified folds, nested in the size of the ensemble.

    Trees are added one after the other, so a forest or boosted model of the largest size holds those of all
    smaller ones: each shape (the other parameters) is fitted once per fold and compared at every size. The
    models of the best shape's folds, cut to the best size, are what calibration needs; the others are dropped
    shape by shape. Folds and shapes are fitted side by side, so that a slow fit holds up no others. First of equal points
    in grid order.
    """
    grid = estimator(name, settings, total_weight, weighted)
    if grid.points == 1:
        params = grid.largest(grid.shapes[0])
        return Search(grid.estimator.fit(rows, params), params, None, None)

    if isinstance(grid.estimator, FocalLogistic):
        return focal_search(grid, rows, folds)

    def one(shape: dict, k: int):
        model = grid.estimator.fit(rows.where(F.col("fold") != k), grid.largest(shape))
        return model, fold_precision(model, rows.where(F.col("fold") == k), grid.sizes)

    best = None
    with ThreadPoolExecutor(parallelism) as pool:
        fits = pool.map(lambda job: one(*job), [(shape, k) for shape in grid.shapes for k in range(folds)])
        for shape in grid.shapes:
            found = [next(fits) for _ in range(folds)]
            for n, scores in enumerate(zip(*(precision for _, precision in found))):
                mean = sum(scores) / folds
                if best is None or mean > best[0]:
                    best = mean, shape, n, [model for model, _ in found]
    mean, shape, n, models = best
    params = {**shape, grid.size: grid.sizes[n]} if grid.sizes else shape
    cut = [part_of(m, 0, grid.sizes[n]) for m in models] if grid.sizes else models
    return Search(grid.estimator.fit(rows, params), params, mean, cut)


def focal_search(grid: Grid, rows: DataFrame, folds: int) -> Search:
    """The search over penalties with all folds' fits and the refits side by side in the same passes over the rows."""
    est = grid.estimator
    whole, models, scores = est.search(rows, folds, [shape[est.regParam] for shape in grid.shapes])
    found = {(r["shape"], r["fold"]): r["pr_auc"] or 0.0 for r in average_precision(scores, by=["shape", "fold"]).collect()}
    means = [sum(found.get((s, k), 0.0) for k in range(folds)) / folds for s in range(len(grid.shapes))]
    best = means.index(max(means))
    return Search(whole[best], grid.shapes[best], means[best], [models[best, k] for k in range(folds)])


@dataclass(frozen=True)
class Calibrated:
    """Fold models with their calibrators; the score is the mean calibrated probability."""

    pairs: list = field(default_factory=list)
    method: str = "isotonic"

    def transform(self, rows: DataFrame, output: str = "score") -> DataFrame:
        out, names = rows, []
        for i, (model, calibrator) in enumerate(self.pairs):
            name = f"_c{i}"
            out = _with_raw(model, out)
            out = _calibrate(calibrator, out, self.method, name)
            names.append(name)
        mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / F.lit(float(len(names)))
        return out.withColumn(output, mean).drop(*names)


def _with_raw(model, rows: DataFrame) -> DataFrame:
    """Uncalibrated probability as ``_raw``, the model's own columns dropped."""
    return model.transform(rows).withColumn("_raw", positive_probability()).drop(
        "probability", "rawPrediction", "prediction")


def _calibrate(calibrator, rows: DataFrame, method: str, name: str) -> DataFrame:
    if method == "isotonic":
        out = calibrator.transform(rows)
        return out.withColumn(name, F.col("prediction")).drop("prediction", "_raw")
    shaped = VectorAssembler(inputCols=["_raw"], outputCol="_one").transform(rows)
    return calibrator.transform(shaped).withColumn(name, positive_probability()).drop(
        "probability", "rawPrediction", "prediction", "_one", "_raw")


def _fit_calibrator(scored: DataFrame, method: str):
    if method == "isotonic":
        return IsotonicRegression(featuresCol="_raw", labelCol="target").fit(
            scored.select("_raw", F.col("target").cast("double").alias("target")))
    if method == "sigmoid":
        shaped = VectorAssembler(inputCols=["_raw"], outputCol="_one").transform(scored)
        return LogisticRegression(featuresCol="_one", labelCol="target").fit(shaped)
    raise ValueError(f"unknown calibration method: {method}")


def calibrate_scores(learned_on: DataFrame, rows: DataFrame, score: str, method: str, output: str) -> DataFrame:
    """``rows`` with ``score`` mapped to a probability by a calibration learned on other scores and targets."""
    def raw(df):
        return df.withColumn("_raw", F.col(score))

    return _calibrate(_fit_calibrator(raw(learned_on), method), raw(rows), method, output)


def calibrated(est, params, rows: DataFrame, folds: int, method: str = "isotonic",
               models: Sequence | None = None, parallelism: int = 8) -> Calibrated:
    """Per fold: a model of the others (fitted here unless given), and the calibration learned on the fold itself."""
    def one(k: int):
        model = models[k] if models else est.fit(rows.where(F.col("fold") != k), params)
        return model, _fit_calibrator(_with_raw(model, rows.where(F.col("fold") == k)), method)

    with ThreadPoolExecutor(parallelism) as pool:
        return Calibrated(list(pool.map(one, range(folds))), method)


@dataclass(frozen=True)
class Classifier:
    """Everything needed to score new rows."""

    inputs: PipelineModel
    features: list[str]
    model: object
    calibration: Calibrated | None
    metadata: dict

    def score(self, rows: DataFrame, output: str = "supervised_score") -> DataFrame:
        ready = self.inputs.transform(rows)
        if self.calibration is not None:
            scored = self.calibration.transform(ready, output)
        else:
            scored = self.model.transform(ready).withColumn(output, positive_probability()).drop(
                "probability", "rawPrediction", "prediction")
        return scored.drop("features", *(c for c in self.features if c not in rows.columns))


def save_classifier(classifier: Classifier, spark: SparkSession, path: str) -> None:
    """Everything that scores: encoding, refitted model, and each fold's model and calibrator."""
    parts = {"inputs": classifier.inputs, "model": PipelineModel([classifier.model])}
    folds = classifier.calibration
    for k, (model, calibrator) in enumerate(folds.pairs if folds else ()):
        parts[f"fold{k}"] = PipelineModel([model, calibrator])
    for name, part in parts.items():
        part.write().overwrite().save(f"{path}/{name}")
    record = {**classifier.metadata, "feature_list": classifier.features,
              "calibration": folds.method if folds else None, "saved_folds": len(folds.pairs) if folds else 0}
    (spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "metadata string")
     .coalesce(1).write.mode("overwrite").json(f"{path}/metadata"))


def load_classifier(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> Classifier:
    """The classifier as it was saved; a differing feature list is refused."""
    record = json.loads(spark.read.schema("metadata string").json(f"{path}/metadata").first()["metadata"])
    if features is not None and list(record["feature_list"]) != list(features):
        raise ValueError("the model was trained on other features")
    pairs = [tuple(PipelineModel.load(f"{path}/fold{k}").stages) for k in range(record["saved_folds"])]
    calibration = Calibrated(pairs, record["calibration"]) if pairs else None
    return Classifier(PipelineModel.load(f"{path}/inputs"), list(record["feature_list"]),
                      PipelineModel.load(f"{path}/model").stages[0], calibration, record)


def train_classifier(name: str, train: DataFrame, settings: Settings = DEFAULTS,
                     columns: Sequence[str] | None = None, calibrate: bool = True) -> Classifier:
    """Encode, balance, tune by average precision, refit and calibrate.

    ``train`` has ``session_id``, ``target`` and the features. With SMOTE, synthetic rows are made
    inside each fold's training side only through their own fold number, so none leaks to another.
    """
    started = datetime.now(timezone.utc)
    inputs = learn_inputs(train, columns)
    prepared = Pipeline(stages=inputs.stages).fit(train)
    ready = prepared.transform(train).select("session_id", "target", "features")
    searching = estimator(name, settings, 1.0).points > 1
    if searching or calibrate or settings.imbalance == "smote":
        rows, folds = stratified_folds(ready, settings)
    else:
        rows, folds = ready, 0
    weights = encode.class_weights(rows)
    weighted = settings.imbalance in ("class_weight", "focal_loss")
    rows = materialise(encode.add_weight(rows, weights) if weighted else rows)
    if settings.imbalance == "smote":
        rows = materialise(smote(rows, settings, per="fold"))
    if settings.imbalance == "focal_loss" and name != "logistic_regression":
        rows = materialise(focal_weights(rows, settings.focal_gamma))
    total = rows.count()
    trees = max(settings.forest_trees) if name == "random_forest" else 0
    parallelism = side_by_side(train.sparkSession, total, len(inputs.features), trees)
    if parallelism > 1:
        # Every fit and fold reads them. Where one fit fills the memory, they are read from their table.
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    found = tuned(name, rows, folds, settings, float(total), weighted, parallelism)
    est = estimator(name, settings, float(total), weighted).estimator
    calibration = calibrated(est, {getattr(est, p.name): v for p, v in found.params.items()}, rows, folds,
                             settings.calibration, found.fold_models, parallelism) if calibrate else None
    rows.unpersist()
    # The names in a model's record.
    metadata = {
        "model_name": name, "trained_at": started.isoformat(),
        "imbalance_strategy": settings.imbalance,
        "best_params": {p.name: v for p, v in found.params.items()},
        "cv_best_score_pr_auc": found.score, "feature_list": inputs.features, "n_train_rows": total,
        "train_seconds": (datetime.now(timezone.utc) - started).total_seconds(), "folds": folds}
    return Classifier(prepared, inputs.features, found.model, calibration, metadata)


def focal_weights(rows: DataFrame, gamma: float = DEFAULTS.focal_gamma) -> DataFrame:
    """Scale each row's weight by (1 - p)^gamma, p being the focal fit's probability of its class.

    For trees, whose losses pyspark.ml fixes; logistic regression is fitted to the focal loss itself.
    """
    probability = positive_probability()
    right = F.when(F.col("target") == 1, probability).otherwise(1 - probability)
    return (FocalLogistic(labelCol="target", weightCol="weight", gamma=gamma).fit(rows).transform(rows)
            .withColumn("weight", F.col("weight") * F.pow(1 - right, F.lit(float(gamma))))
            .drop("probability", "rawPrediction", "prediction"))
