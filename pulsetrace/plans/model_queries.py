"""Queries that train models; their scores have no SQL counterpart unless one is given."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS
from pulsetrace.models import anomaly, supervised
from pulsetrace.models.forest_attribution import tree_attribution
from pulsetrace.models.sampled_attribution import sampled_attribution
from pulsetrace.operators import curves, explain, splits, sweeps
from pulsetrace.operators.decision import decision_log
from pulsetrace.operators.smote import nearest_neighbours
from pulsetrace.plans import runs, sql
from pulsetrace.plans.inputs import kept_flows, scored_sessions
from pulsetrace.plans.registry import query
from pulsetrace.session import materialise, scratch_path
from pulsetrace.sources import sinks

# The searches have the default grids, sizes and folds. Queries about what comes after the search take one shape of
# the trees; linear models keep their whole grid.
SMALL = DEFAULTS.with_(forest_trees=(40,), forest_depth=(8,), forest_min_leaf=(1,),
                       boost_rounds=(10,), boost_depth=(4,), boost_step=(0.1,))


def _parts(spark, folder, split="random"):
    matrix = runs.session_matrix(kept_flows(spark, folder))
    parts = materialise(runs.SPLITS[split](matrix, SMALL))
    return (parts.where("split = 'train'").drop("split"),
            parts.where("split = 'test'").drop("split"))


def _scores(spark, folder, name):
    """Searched, refitted and calibrated."""
    train, test = _parts(spark, folder)
    model = supervised.train_classifier(name, train, DEFAULTS)
    return model.score(test).select("session_id", "target", "supervised_score")


@query("rf_scores")
def rf_scores(spark, folder):
    return _scores(spark, folder, "random_forest")


@query("gbt_scores")
def gbt_scores(spark, folder):
    return _scores(spark, folder, "gradient_boosting")


@query("lr_scores")
def lr_scores(spark, folder):
    return _scores(spark, folder, "logistic_regression")


@query("cv_grid")
def cv_grid(spark, folder):
    """Grid search over the default points, scored by average precision on stratified folds."""
    train, _ = _parts(spark, folder)
    meta = supervised.train_classifier("logistic_regression", train, calibrate=False).metadata
    return spark.createDataFrame(
        [(meta["model_name"], float(meta["best_params"]["regParam"]),
          float(meta["cv_best_score_pr_auc"]), meta["folds"])],
        "model string, best_reg_param double, cv_pr_auc double, folds int")


@query("calibrated_scores")
def calibrated_scores(spark, folder):
    train, test = _parts(spark, folder)
    model = supervised.train_classifier("logistic_regression", train, SMALL)
    return model.score(test).select("session_id", "target", "supervised_score")


@query("focal_weights")
def focal_weights(spark, folder):
    train, test = _parts(spark, folder)
    model = supervised.train_classifier(
        "logistic_regression", train, SMALL.with_(imbalance="focal_loss"), calibrate=False)
    return model.score(test).select("session_id", "target", "supervised_score")


@query("smote")
def smote_scores(spark, folder):
    """A model trained on SMOTE-balanced rows."""
    train, test = _parts(spark, folder)
    model = supervised.train_classifier(
        "logistic_regression", train, SMALL.with_(imbalance="smote"), calibrate=False)
    return model.score(test).select("session_id", "target", "supervised_score")


@query("minority_neighbours", sql.over_scores("""
SELECT session_id, place, other, ROUND(distance, 8) AS distance
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY distance, other) AS place
      FROM (SELECT a.session_id, b.session_id AS other,
              POW(a.supervised_score - b.supervised_score, 2) + POW(a.n_flows - b.n_flows, 2)
              AS distance
            FROM scored a JOIN scored b ON a.target = 1 AND b.target = 1
              AND a.session_id <> b.session_id))
WHERE place <= 5"""))
def minority_neighbours(spark, folder):
    """The exact nearest minority neighbours SMOTE draws from, over several blocks."""
    minority = scored_sessions(spark, folder, stored=True).where("target = 1").select(
        "session_id", F.array("supervised_score", F.col("n_flows").cast("double")).alias("x"))
    near = nearest_neighbours(minority, 5, rows_per_block=20)
    return near.select("session_id", F.posexplode("neighbours").alias("place", "n")).select(
        "session_id", (F.col("place") + 1).cast("bigint").alias("place"), "n.other",
        F.round("n.distance", 8).alias("distance"))


def _anomaly(spark, folder, name):
    train, test = _parts(spark, folder)
    return anomaly.train_detector(name, train, SMALL).score(test).select(
        "session_id", "target", "anomaly_score")


@query("pca_anomaly")
def pca_anomaly(spark, folder):
    return _anomaly(spark, folder, "components")


@query("autoencoder_anomaly")
def autoencoder_anomaly(spark, folder):
    return _anomaly(spark, folder, "autoencoder")


@query("isolation_forest")
def isolation_forest(spark, folder):
    return _anomaly(spark, folder, "isolation_forest")


@query("mahalanobis_anomaly")
def mahalanobis_anomaly(spark, folder):
    return _anomaly(spark, folder, "distance")


@query("evaluate_split")
def evaluate_split(spark, folder):
    """The held-out-family split end to end: both branches, fusion, thresholds, metrics."""
    matrix = runs.session_matrix(kept_flows(spark, folder))
    return runs.evaluate_split(matrix, "held_out_family", SMALL)[0]


REPORT_SCHEMA = ("split string, branch string, pr_auc double, roc_auc double, "
                 "precision_at_threshold double, recall_at_threshold double, "
                 "false_positives_per_day double, threshold double")


@query("evaluation_report")
def evaluation_report(spark, folder):
    """Metrics of all three splits, written as JSON and read back."""
    matrix = runs.session_matrix(kept_flows(spark, folder))
    report = None
    for split in runs.SPLITS:
        rows = runs.evaluate_split(matrix, split, SMALL, "logistic_regression")[0]
        report = rows if report is None else report.unionByName(rows)
    path = scratch_path(spark, "report")
    sinks.save_report(report.withColumn("note", F.lit(curves.ACCURACY_NOTE)), path)
    return sinks.read_report(spark, path, REPORT_SCHEMA)


@query("explained_decisions")
def explained_decisions(spark, folder):
    """Decision log of the random split with a sentence per verdict, from the refitted forest."""
    matrix = runs.session_matrix(kept_flows(spark, folder))
    _, scored, limits, classifier = runs.evaluate_split(matrix, "random", SMALL)
    ready = classifier.inputs.transform(scored)
    found, _ = tree_attribution(ready, classifier.model, classifier.features)
    reasons = found.withColumn("reasons", explain.top_reasons(3)).select(
        "session_id", explain.explanation_text("reasons").alias("sentence"))
    joined = scored.join(reasons, "session_id")
    return decision_log(joined, limits, F.col("sentence"), stamped=False)


@query("tree_attribution")
def tree_attribution_query(spark, folder):
    train, test = _parts(spark, folder)
    classifier = supervised.train_classifier("random_forest", train, SMALL, calibrate=False)
    found, _ = tree_attribution(classifier.inputs.transform(test), classifier.model,
                                classifier.features)
    return found.select("session_id", F.inline("attribution"))


@query("forest_rank_disagreement")
def forest_rank_disagreement(spark, folder):
    """Attribution rank against the forest's own importances."""
    train, test = _parts(spark, folder)
    classifier = supervised.train_classifier("random_forest", train, SMALL, calibrate=False)
    found, _ = tree_attribution(classifier.inputs.transform(test), classifier.model,
                                classifier.features)
    builtin = spark.createDataFrame(
        list(zip(classifier.features, map(float, classifier.model.featureImportances.toArray()))),
        "feature string, builtin_importance double")
    return explain.rank_disagreement(explain.global_importance(found), builtin)


@query("sampled_attribution")
def sampled_attribution_query(spark, folder):
    train, test = _parts(spark, folder)
    classifier = supervised.train_classifier("logistic_regression", train, SMALL, calibrate=False)
    return sampled_attribution(
        classifier.inputs.transform(test), classifier.inputs.transform(train), classifier.model,
        classifier.features)


@query("tier_ablation")
def tier_ablation(spark, folder):
    train, test = _parts(spark, folder)
    return runs.tier_ablation(train, test, SMALL)


@query("model_comparison")
def model_comparison(spark, folder):
    train, test = _parts(spark, folder, "temporal")
    return runs.model_comparison(train, test, SMALL)


@query("cross_dataset_eval")
def cross_dataset_eval(spark, folder):
    """Train on two captures' sessions, score those of the third."""
    matrix = runs.session_matrix(kept_flows(spark, folder))
    other = F.col("capture_id") == "capture-2"
    return runs.cross_dataset(matrix.where(~other), matrix.where(other), SMALL)


@query("model_jitter_curve")
def model_jitter_curve(spark, folder):
    """Recall of a trained model as the positive flows are blurred."""
    flows = kept_flows(spark, folder)
    matrix = runs.session_matrix(flows)
    parts = materialise(splits.stratified_split(matrix, SMALL))
    classifier = supervised.train_classifier(
        "random_forest", parts.where("split = 'train'").drop("split"), SMALL, calibrate=False)
    return sweeps.jitter_curve(flows, runs.scored_with(classifier), 0.5, SMALL)


@query("hardening_round")
def hardening_round(spark, folder):
    return runs.hardening_round(kept_flows(spark, folder), SMALL)


@query("model_roundtrip")
def model_roundtrip(spark, folder):
    """A saved and reloaded calibrated classifier gives the same scores."""
    train, test = _parts(spark, folder)
    model = supervised.train_classifier("random_forest", train, SMALL.with_(forest_trees=(20,)))
    path = scratch_path(spark, "model")
    supervised.save_classifier(model, spark, path)
    loaded = supervised.load_classifier(spark, path, model.features)
    before = model.score(test, "before").select("session_id", "before")
    after = loaded.score(test, "after").select("session_id", "after")
    return before.join(after, "session_id").agg(
        F.count("*").alias("n_rows"), F.max(F.abs(F.col("before") - F.col("after"))).alias("max_gap")
    ).withColumn("n_features", F.lit(len(loaded.features)))


@query("full_run")
def full_run(spark, folder):
    """All deliverables of one run; the result is its report."""
    settings = SMALL.with_(forest_trees=(10,), forest_depth=(5,))
    return runs.full_run(kept_flows(spark, folder), scratch_path(spark, "run"), settings)
