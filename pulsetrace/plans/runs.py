"""Whole runs: one split end to end, the full report, ablation, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS, Settings
from pulsetrace.models.anomaly import train_detector
from pulsetrace.models.forest_attribution import tree_attribution
from pulsetrace.models.supervised import Classifier, save_classifier, train_classifier
from pulsetrace.operators import curves, explain, fusion, splits, sweeps
from pulsetrace.operators.decision import Thresholds, calibrate_thresholds, decision_log
from pulsetrace.operators.features import feature_matrix, matrix_of, tier_columns
from pulsetrace.session import materialise
from pulsetrace.sources import sinks

SPLITS = {"random": splits.stratified_split, "temporal": splits.temporal_split,
          "held_out_family": splits.held_out_family_split}


def session_matrix(flows: DataFrame, settings: Settings = DEFAULTS,
                   context_flows: DataFrame | None = None) -> DataFrame:
    """The feature matrix, written once: every later step works on sessions, not flows."""
    return materialise(feature_matrix(flows, settings, context_flows))


def score_rows(train: DataFrame, rows: DataFrame, settings: Settings = DEFAULTS,
               model: str = "random_forest", detector: str = "components",
               calibrate: bool = True) -> tuple[DataFrame, Classifier]:
    """Train both branches and score ``rows``: supervised, anomaly and risk score."""
    classifier = train_classifier(model, train, settings, calibrate=calibrate)
    anomaly = train_detector(detector, train, settings)
    scored = anomaly.score(classifier.score(rows))
    return materialise(scored.withColumn("risk_score", fusion.fuse(settings=settings)).select(
        *rows.columns, "supervised_score", "anomaly_score", "risk_score")), classifier


def evaluate_split(matrix: DataFrame, split: str, settings: Settings = DEFAULTS,
                   model: str = "random_forest", detector: str = "components",
                   calibrate: bool = True) -> tuple[DataFrame, DataFrame, Thresholds, Classifier]:
    """One split end to end; returns its metric rows, scored test rows, thresholds and classifier.

    Metric rows: the fused score at the BLOCK threshold and the anomaly branch alone at 0.5.
    """
    parts = materialise(SPLITS[split](matrix, settings))
    test = parts.where("split = 'test'").drop("split")
    scored, classifier = score_rows(parts.where("split = 'train'").drop("split"), test, settings,
                                    model, detector, calibrate)
    rows, limits = branch_metrics(scored, split, settings)
    return rows, scored, limits, classifier


def branch_metrics(scored: DataFrame, split: str, settings: Settings = DEFAULTS) -> tuple[DataFrame, Thresholds]:
    """Metric rows of scored sessions (fused at the BLOCK threshold, anomaly branch at 0.5) and the thresholds."""
    limits = calibrate_thresholds(scored, settings=settings)
    fused = curves.full_metrics(scored, limits.high, settings.flows_per_day, "risk_score")
    alone = curves.full_metrics(scored, 0.5, settings.flows_per_day, "anomaly_score")
    rows = None
    for branch, metrics in (("fused", fused), ("anomaly", alone)):
        one = metrics.select(F.lit(split).alias("split"), F.lit(branch).alias("branch"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows, limits


def tier_ablation(train: DataFrame, test: DataFrame, settings: Settings = DEFAULTS,
                  model: str = "random_forest", calibrate: bool = True) -> DataFrame:
    """Average precision with the features of more and more tiers."""
    long = None
    for tiers in settings.ablation_tiers:
        columns = tier_columns(train.columns, tiers)
        classifier = train_classifier(model, train, settings, columns, calibrate)
        one = classifier.score(test, "score").select(
            F.lit("+".join(tiers)).alias("tiers"),
            F.lit(len(classifier.features)).alias("n_features"), "target", "score")
        long = one if long is None else long.unionByName(one)
    return curves.average_precision(long, by=["tiers", "n_features"])


def model_comparison(train: DataFrame, test: DataFrame, settings: Settings = DEFAULTS,
                     models: Sequence[str] = ("random_forest", "gradient_boosting",
                                              "logistic_regression"),
                     detector: str = "components", calibrate: bool = True) -> DataFrame:
    """Average precision, ROC-AUC and recall at precision 0.9 of each model, branch and the fusion."""
    scored = train_detector(detector, train, settings).score(test)
    for name in models:
        scored = train_classifier(name, train, settings, calibrate=calibrate).score(scored, name)
    scored = materialise(scored.withColumn("fused", fusion.weighted_average(
        models[0], "anomaly_score", settings)))
    return compare_scores(scored, [*models, "anomaly_score", "fused"])


def compare_scores(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """Average precision, ROC-AUC and recall at precision 0.9 of each score column."""
    long = scored.select("target", F.inline(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(n).alias("score")) for n in names])))
    return curves.ranking_metrics(long, by=["model"]).join(
        curves.recall_at_precision(long, 0.9, by=["model"]), "model")


def cross_dataset(train: DataFrame, other: DataFrame, settings: Settings = DEFAULTS,
                  model: str = "logistic_regression", calibrate: bool = False) -> DataFrame:
    """Train on one data set, score another with the encoding of the first."""
    classifier = train_classifier(model, train, settings, calibrate=calibrate)
    return curves.ranking_metrics(classifier.score(other, "score"))


def scored_with(classifier: Classifier, context_flows: DataFrame | None = None):
    """Sweep callback: complete the matrix of perturbed sessions and score it with a fitted model.

    With ``context_flows`` (all flows, say) the context is that of the real network; otherwise it is
    counted over the perturbed positives alone.
    """
    def score(sessions: DataFrame, settings: Settings) -> DataFrame:
        return classifier.score(materialise(matrix_of(sessions, settings, context_flows)), "score")
    return score


def hardening_round(flows: DataFrame, settings: Settings = DEFAULTS,
                    model: str = "logistic_regression", level: int = 30,
                    threshold: float = 0.5, padding: float = 2.0) -> DataFrame:
    """Recall under jitter before and after training with jittered and padded copies of the positives.

    The copies come from training sessions, the recall from test sessions alone.
    """
    matrix = session_matrix(flows, settings)
    parts = materialise(splits.stratified_split(matrix, settings))
    train = parts.where("split = 'train'").drop("split")
    test = parts.where("split = 'test'").drop("split")
    positives = flows.where("target = 1")
    hardened = train
    for mark, moved in (("jitter", sweeps.inject_jitter(positives, [level], settings).drop("jitter_pct")),
                        ("padded", sweeps.inject_padding(positives, [padding], settings).drop("padding_factor"))):
        copies = session_matrix(moved, settings)
        kept = copies.join(train.select("session_id"), "session_id", "left_semi").withColumn(
            "session_id", F.concat_ws("#", "session_id", F.lit(mark)))
        hardened = hardened.unionByName(kept)
    out = None
    for stage, rows in (("before", train), ("after", hardened)):
        classifier = train_classifier(model, rows, settings, calibrate=False)
        curve = sweeps.jitter_curve(flows, scored_with(classifier), threshold, settings, test)
        one = curve.select(F.lit(stage).alias("stage"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _entries(df: DataFrame, section: str, item: str, values: Sequence[str]) -> DataFrame:
    """Report lines (section, item, metric, value) of a wide metric frame."""
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value"))
                      for v in values])
    return df.select(F.lit(section).alias("section"), F.expr(item).alias("item"), F.inline(pairs))


def full_run(flows: DataFrame, folder: str, settings: Settings = DEFAULTS,
             detector: str = "components", calibrate: bool = True) -> DataFrame:
    """Everything one run delivers, under ``folder``: model, thresholds, explained log and report.

    The report covers the three splits, both fusion methods, the tier ablation, feature importance and
    the jitter curve at the supervised branch's own threshold. Returns the report lines.
    """
    spark = flows.sparkSession
    matrix = session_matrix(flows, settings)
    found = {name: evaluate_split(matrix, name, settings, detector=detector, calibrate=calibrate)
             for name in SPLITS}
    _, scored, limits, classifier = found["random"]

    # What gave the scores, thresholds and log of this run, calibration included.
    save_classifier(classifier, spark, f"{folder}/model")
    sinks.save_thresholds(scored, limits, f"{folder}/thresholds")

    shares, _ = tree_attribution(classifier.inputs.transform(scored), classifier.model,
                                 classifier.features)
    shares = materialise(shares)
    sentences = shares.withColumn("reasons", explain.top_reasons(3)).select(
        "session_id", explain.explanation_text("reasons").alias("sentence"))
    sinks.save_decision_log(
        decision_log(scored.join(sentences, "session_id"), limits, F.col("sentence")),
        f"{folder}/decisions")

    parts = materialise(SPLITS["random"](matrix, settings))
    train = parts.where("split = 'train'").drop("split")
    test = parts.where("split = 'test'").drop("split")
    own = calibrate_thresholds(scored, "supervised_score", settings)
    curve = sweeps.jitter_curve(flows, scored_with(classifier), own.high, settings)
    metrics = ("pr_auc", "roc_auc", "precision_at_threshold", "recall_at_threshold",
               "f1_at_threshold", "accuracy", "false_positives_per_day", "threshold", "tp", "fp",
               "fn", "tn")
    lines = [_entries(rows, "split", "concat(split, '/', branch)", metrics)
             for rows, *_ in found.values()]
    lines += [
        _entries(fusion.compare_fusion(scored, settings=settings), "fusion", "method", ["pr_auc"]),
        _entries(tier_ablation(train, test, settings), "ablation", "tiers", ["n_features", "pr_auc"]),
        _entries(explain.global_importance(shares), "importance", "feature", ["importance"]),
        _entries(curve, "jitter", "cast(jitter_pct AS string)", ["recall_at_threshold", "threshold"])]
    report = reduce(DataFrame.unionByName, lines)
    sinks.save_report(report, f"{folder}/report")
    return sinks.read_report(spark, f"{folder}/report",
                             "section string, item string, metric string, value double")
