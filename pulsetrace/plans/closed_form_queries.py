"""Model steps on two inputs or given scores, where SQL can state the fitted result."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS
from pulsetrace.models import anomaly, focal
from pulsetrace.models.supervised import calibrate_scores
from pulsetrace.operators import decision, encode
from pulsetrace.operators.smote import smote
from pulsetrace.plans import runs, sql
from pulsetrace.plans.inputs import rounded, scored_sessions
from pulsetrace.plans.registry import query
from pulsetrace.plans.score_queries import ACTION_SQL, FAMILY_SQL, SPLIT_HASH, TEMPORAL_SQL
from pulsetrace.session import materialise, scratch_path
from pulsetrace.sources import sinks

PAIR = ("session_flow_count", "iat_cv")
RIDGE = 0.05


def _pair_sessions(spark, folder):
    """All scored sessions with two inputs under their feature names."""
    return materialise(scored_sessions(spark, folder).select(
        "session_id", "target", "iat_cv", F.col("n_flows").cast("double").alias("session_flow_count")))


# Inputs standardised by the benign rows, and the benign correlation.
PAIR_SQL = """
ab AS (SELECT session_id, target, CAST(n_flows AS DOUBLE) AS a, iat_cv AS b FROM scored),
st AS (SELECT AVG(a) AS am, STDDEV_POP(a) AS s_a, AVG(b) AS bm, STDDEV_POP(b) AS s_b FROM ab WHERE target = 0),
z AS (SELECT session_id, target, (a - am) / s_a AS x, (b - bm) / s_b AS y FROM ab, st),
rho AS (SELECT AVG(x * y) AS r FROM z WHERE target = 0)"""


def _threshold_sql(error: str) -> str:
    return f"""
er AS (SELECT session_id, target, {error} AS error FROM z, rho),
th AS (SELECT QUANTILE_CONT(error, {DEFAULTS.benign_percentile / 100}) AS t FROM er WHERE target = 0)"""


ERRORS = """SELECT session_id, target, ROUND(error, 6) AS error,
  ROUND(1 / (1 + EXP(-(error - t) / (t + 1e-9))), 6) AS anomaly_score FROM er, th"""


def _errors(rows, model):
    errors = materialise(model.error(rows))
    limit = anomaly.benign_threshold(errors, percentile=DEFAULTS.benign_percentile)
    return errors.select("session_id", "target", F.round("error", 6).alias("error"),
                         F.round(anomaly.normalised("error", limit), 6).alias("anomaly_score"))


@query("mahalanobis_pair", sql.over_scores(ERRORS, PAIR_SQL, _threshold_sql(
    f"(x * x + y * y - 2 * (1 - {RIDGE}) * r * x * y) / (1 - POW((1 - {RIDGE}) * r, 2)) / 2")))
def mahalanobis_pair(spark, folder):
    """Distance to the benign mean over two inputs, threshold and score: the inverse matrix has a closed form."""
    rows = _pair_sessions(spark, folder)
    return _errors(rows, anomaly.train_distance(rows.where("target = 0"), RIDGE, PAIR))


@query("components_pair", sql.over_scores(ERRORS, PAIR_SQL, _threshold_sql(
    "POW(x - CASE WHEN r < 0 THEN -1 ELSE 1 END * y, 2) / 4")))
def components_pair(spark, folder):
    """Reconstruction error of two inputs from one component, which lies on a diagonal of the standardised plane."""
    rows = _pair_sessions(spark, folder)
    return _errors(rows, anomaly.train_components(rows.where("target = 0"), 1, PAIR))


# Largest mean that some start gives, where each start takes the smallest over all ends: monotone regression.
@query("isotonic_scores", sql.over_scores("""
SELECT session_id, target, ROUND(most, 6) AS calibrated
FROM scored JOIN (SELECT place, MAX(least) AS most FROM fitted GROUP BY place) ON place = supervised_score""", """
vals AS (SELECT supervised_score AS v, SUM(target) AS y, COUNT(*) AS n FROM scored GROUP BY v),
sums AS (SELECT v, y, n, SUM(y) OVER w AS sy, SUM(n) OVER w AS sn FROM vals
         WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
spans AS (SELECT a.v AS lo, b.v AS place, (b.sy - a.sy + a.y) / CAST(b.sn - a.sn + a.n AS DOUBLE) AS mean
          FROM sums a JOIN sums b ON b.v >= a.v),
fitted AS (SELECT place, MIN(mean) OVER (PARTITION BY lo ORDER BY place DESC ROWS UNBOUNDED PRECEDING) AS least
           FROM spans)"""))
def isotonic_scores(spark, folder):
    """Scores calibrated by the monotone regression of the target on them."""
    rows = scored_sessions(spark, folder, stored=True).select("session_id", "target", "supervised_score")
    out = calibrate_scores(rows, rows, "supervised_score", "isotonic", "calibrated")
    return out.select("session_id", "target", F.round("calibrated", 6).alias("calibrated"))


@query("smote_balance", sql.over_scores("""
SELECT target, CAST(CASE WHEN target = 1 THEN GREATEST(n, other) ELSE n END AS BIGINT) AS n_rows,
  CAST(CASE WHEN target = 1 THEN GREATEST(other - n, 0) ELSE 0 END AS BIGINT) AS n_synthetic, TRUE AS inside
FROM (SELECT target, COUNT(*) AS n, SUM(COUNT(*)) OVER () - COUNT(*) AS other FROM scored GROUP BY target)"""))
def smote_balance(spark, folder):
    """Classes after balancing; synthetic rows lie within the minority's extent in every input."""
    ready = encode.assembler(PAIR).transform(_pair_sessions(spark, folder)).select("session_id", "target", "features")
    made = materialise(smote(ready).withColumn("x", vector_to_array("features")))
    synthetic = F.col("session_id").contains("#")
    extent = made.where(~synthetic).groupBy("target").agg(*[
        f(F.col("x")[i]).alias(f"{n}{i}") for i in range(len(PAIR)) for n, f in (("lo", F.min), ("hi", F.max))])
    within = [F.col("x")[i].between(F.col(f"lo{i}"), F.col(f"hi{i}")) for i in range(len(PAIR))]
    return made.join(extent, "target").groupBy("target").agg(
        F.count("*").alias("n_rows"), F.count_if(synthetic).alias("n_synthetic"),
        F.every(within[0] & within[1]).alias("inside"))


GAMMA, PENALTY = DEFAULTS.focal_gamma, 0.01
# Where the step starts: intercept and both coefficients.
START = (-0.4, 0.6, -0.8)


def _focal_sql() -> str:
    """One second-order step of the focal loss on two standardised inputs: sums, then Cramer's rule."""
    names = ("CAST(1 AS DOUBLE)", "x", "y")
    gradient = ", ".join(f"AVG(s * slope * {n}) + {0 if i == 0 else PENALTY * START[i]} AS g{i}" for i, n in enumerate(names))
    bends = ", ".join(f"AVG(bend * {a} * {b}) + {PENALTY if i == j and i else 0} AS h{i}{j}"
                      for i, a in enumerate(names) for j, b in enumerate(names))

    def det(*columns):
        a, b, c = columns
        return (f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {b[0]} * ({a[1]} * {c[2]} - {a[2]} * {c[1]})"
                f" + {c[0]} * ({a[1]} * {b[2]} - {a[2]} * {b[1]}))")

    h = [[f"h{i}{j}" for i in range(3)] for j in range(3)]
    g = [f"g{i}" for i in range(3)]
    solved = ", ".join(f"{START[k]} - {det(*[g if k == j else h[j] for j in range(3)])} / {det(*h)} AS b{k}" for k in range(3))
    return f"""
ab AS (SELECT session_id, target, CAST(n_flows AS DOUBLE) AS a, iat_cv AS b FROM scored),
st AS (SELECT AVG(a) AS am, STDDEV_SAMP(a) AS s_a, AVG(b) AS bm, STDDEV_SAMP(b) AS s_b FROM ab),
z AS (SELECT session_id, 2 * target - 1 AS s, (a - am) / s_a AS x, (b - bm) / s_b AS y FROM ab, st),
m AS (SELECT *, 1 / (1 + EXP(-s * ({START[0]} + {START[1]} * x + {START[2]} * y))) AS p FROM z),
d AS (SELECT *, POW(1 - p, {GAMMA}) * ({GAMMA} * p * LN(p) - (1 - p)) AS slope, GREATEST(1e-6,
        POW(1 - p, {GAMMA}) * p * ((1 - p) * (1 + 2 * {GAMMA}) + {GAMMA} * LN(p) * (1 - p - {GAMMA} * p))) AS bend FROM m),
sm AS (SELECT {gradient}, {bends} FROM d),
nb AS (SELECT {solved} FROM sm)"""


@query("focal_step", sql.over_scores(
    "SELECT session_id, ROUND(1 / (1 + EXP(-(b0 + b1 * x + b2 * y))), 6) AS score FROM z, nb", _focal_sql()))
def focal_step(spark, folder):
    """Scores after one full second-order step of the focal loss from given coefficients, on two inputs."""
    rows = _pair_sessions(spark, folder)
    x = F.array(*[F.col(c) for c in PAIR])
    table, centre, scale, total = focal.standardised(rows.select(x.alias("x"), F.col("target").alias("y"), F.lit(1.0).alias("a")))
    start = np.array(START)
    _, gradient, curvature = focal.derivatives(table, start, GAMMA)
    beta = start + focal.direction(gradient / total, curvature / total, start, PENALTY)
    margin = F.lit(float(beta[0]))
    for c, mean, size, b in zip(PAIR, centre, scale, beta[1:]):
        margin = margin + F.lit(float(b)) * (F.col(c) - F.lit(float(mean))) / F.lit(float(size))
    return rows.select("session_id", F.round(1 / (1 + F.exp(-margin)), 6).alias("score"))


# ------------------------------------------------------------------ runs over given scores

TESTS_SQL = f"""
strat AS (
  SELECT *, CASE WHEN r <= round_even(n * CAST(0.7 AS DOUBLE), 0) THEN 'train'
    WHEN r <= round_even(n * CAST(0.85 AS DOUBLE), 0) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY target) AS n,
          ROW_NUMBER() OVER (PARTITION BY target ORDER BY {SPLIT_HASH}, session_id) AS r
        FROM scored)),{TEMPORAL_SQL},{FAMILY_SQL},
tests AS (SELECT 'random' AS split, target, risk_score, anomaly_score FROM strat WHERE split = 'test'
  UNION ALL SELECT 'temporal', target, risk_score, anomaly_score FROM timed_split WHERE split = 'test'
  UNION ALL SELECT 'held_out_family', target, risk_score, anomaly_score FROM family_split WHERE split = 'test')"""


def _ranking_sql(source: str, by: str) -> str:
    """Average precision, ROC-AUC and recall at precision 0.9 for each value of ``by``, as table ``rk``."""
    return f"""
ds AS (SELECT {by}, score, SUM(target) AS pos, SUM(1 - target) AS neg FROM {source} GROUP BY ALL),
pt AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY {by}) AS np,
         SUM(neg) OVER (PARTITION BY {by}) AS nn FROM ds WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)),
rk AS (SELECT {by}, ROUND(SUM(pos / CAST(np AS DOUBLE) * (tp / CAST(tp + fp AS DOUBLE))), 6) AS pr_auc,
         ROUND(SUM(neg * (tp - pos / CAST(2 AS DOUBLE))) / (CAST(MAX(np) AS DOUBLE) * MAX(nn)), 6) AS roc_auc,
         ROUND(COALESCE(MAX(tp / CAST(np AS DOUBLE)) FILTER (
           WHERE tp / CAST(tp + fp AS DOUBLE) >= CAST(0.9 AS DOUBLE)), 0), 6) AS recall
       FROM pt GROUP BY {by})"""


REPORT = ("split string, branch string, pr_auc double, roc_auc double, precision_at_threshold double, "
          "recall_at_threshold double, f1_at_threshold double, accuracy double, false_positives_per_day double, "
          "threshold double, tp bigint, fp bigint, fn bigint, tn bigint")
EXACT = ("split", "branch", "tp", "fp", "fn", "tn")


@query("given_scores_report", sql.over_scores("""
SELECT split, branch, pr_auc, roc_auc, tp, fp, fn, tn, ROUND(limit_, 6) AS threshold,
  ROUND(COALESCE(tp / CAST(NULLIF(tp + fp, 0) AS DOUBLE), 0), 6) AS precision_at_threshold,
  ROUND(COALESCE(tp / CAST(NULLIF(tp + fn, 0) AS DOUBLE), 0), 6) AS recall_at_threshold,
  ROUND(COALESCE(2 * tp / CAST(NULLIF(2 * tp + fp + fn, 0) AS DOUBLE), 0), 6) AS f1_at_threshold,
  ROUND((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy,
  ROUND(fp / CAST(GREATEST(1, fp + tn) AS DOUBLE) * 1000, 6) AS false_positives_per_day
FROM cm JOIN rk USING (split, branch)""", TESTS_SQL, """
long AS (SELECT split, 'fused' AS branch, target, risk_score AS score,
    QUANTILE_CONT(risk_score, 0.95) OVER (PARTITION BY split) AS limit_ FROM tests
  UNION ALL SELECT split, 'anomaly', target, anomaly_score, CAST(0.5 AS DOUBLE) FROM tests),
cm AS (SELECT split, branch, MAX(limit_) AS limit_, COUNT(*) FILTER (WHERE score >= limit_ AND target = 1) AS tp,
         COUNT(*) FILTER (WHERE score >= limit_ AND target = 0) AS fp,
         COUNT(*) FILTER (WHERE score < limit_ AND target = 1) AS fn,
         COUNT(*) FILTER (WHERE score < limit_ AND target = 0) AS tn FROM long GROUP BY split, branch)""",
    _ranking_sql("long", "split, branch")))
def given_scores_report(spark, folder):
    """Thresholds and metrics of all three splits and both branches over given scores, saved as JSON and read back."""
    scored = scored_sessions(spark, folder, stored=True)
    report = None
    for name, assign in runs.SPLITS.items():
        rows, _ = runs.branch_metrics(assign(scored).where("split = 'test'").drop("split"), name)
        report = rows if report is None else report.unionByName(rows)
    path = scratch_path(spark, "report")
    sinks.save_report(report, path)
    places = {c.split()[0]: None if c.split()[0] in EXACT else 6 for c in REPORT.split(", ")}
    return rounded(sinks.read_report(spark, path, REPORT), places)


@query("given_scores_comparison", sql.over_scores("SELECT model, pr_auc, roc_auc, recall FROM rk", """
long AS (SELECT 'supervised_score' AS model, target, supervised_score AS score FROM scored
  UNION ALL SELECT 'anomaly_score', target, anomaly_score FROM scored
  UNION ALL SELECT 'risk_score', target, risk_score FROM scored)""", _ranking_sql("long", "model")))
def given_scores_comparison(spark, folder):
    """Both branches and their fusion side by side over given scores."""
    scored = scored_sessions(spark, folder, stored=True)
    return rounded(runs.compare_scores(scored, ("supervised_score", "anomaly_score", "risk_score")),
                   {"model": None, "pr_auc": 6, "roc_auc": 6, "recall": 6})


@query("saved_thresholds", sql.over_scores(f"SELECT session_id, {ACTION_SQL} FROM scored, tau", sql.TAU))
def saved_thresholds(spark, folder):
    """Verdicts from thresholds that were saved and read back."""
    scored, path = scored_sessions(spark, folder, stored=True), scratch_path(spark, "thresholds")
    sinks.save_thresholds(scored, decision.calibrate_thresholds(scored), path)
    return scored.select("session_id", decision.decide("risk_score", sinks.read_thresholds(spark, path)).alias("action"))
