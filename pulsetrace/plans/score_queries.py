"""Queries over scored sessions: splits, metrics, fusion, thresholds, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS
from pulsetrace.operators import curves, decision, fusion, splits
from pulsetrace.operators.hosts import host_risk as aggregate
from pulsetrace.operators.anomaly_scores import benign_threshold, normalised
from pulsetrace.plans import sql
from pulsetrace.plans.inputs import rounded, scored_sessions
from pulsetrace.plans.registry import query
from pulsetrace.session import scratch_path
from pulsetrace.sources import sinks
from pulsetrace.sources.views import table

MIDDLE = 0.5  # operating point of the metric queries

# ------------------------------------------------------------------ splits

SPLIT_HASH = sql.hash60("session_id")


@query("stratified_split", sql.over_scores(f"""
SELECT session_id, target, CASE WHEN r <= round_even(n * CAST(0.7 AS DOUBLE), 0) THEN 'train'
  WHEN r <= round_even(n * CAST(0.85 AS DOUBLE), 0) THEN 'val' ELSE 'test' END AS split
FROM (SELECT session_id, target, COUNT(*) OVER (PARTITION BY target) AS n,
        ROW_NUMBER() OVER (PARTITION BY target ORDER BY {SPLIT_HASH}, session_id) AS r
      FROM scored)"""))
def stratified_split(spark, folder):
    return splits.stratified_split(scored_sessions(spark, folder, stored=True)).select(
        "session_id", "target", "split")


TEMPORAL_SQL = f"""
ordered AS (SELECT *, COUNT(*) OVER () AS total,
              ROW_NUMBER() OVER (ORDER BY first_us, {SPLIT_HASH}) AS r FROM scored),
timed_split AS (
  SELECT *, CASE WHEN r <= FLOOR(total * CAST(0.7 AS DOUBLE)) THEN 'train'
    WHEN r <= FLOOR(total * CAST(0.7 AS DOUBLE)) + FLOOR(total * CAST(0.15 AS DOUBLE)) THEN 'val'
    ELSE 'test' END AS split FROM ordered)"""


@query("temporal_split", sql.over_scores(
    "SELECT session_id, first_us, split FROM timed_split", TEMPORAL_SQL))
def temporal_split(spark, folder):
    return splits.temporal_split(scored_sessions(spark, folder, stored=True)).select(
        "session_id", "first_us", "split")


FAMILY_SQL = f"""
families AS (
  SELECT detailed_label, ROW_NUMBER() OVER (ORDER BY md5(concat('42|family', detailed_label))) AS r,
    COUNT(*) OVER () AS total
  FROM (SELECT DISTINCT detailed_label FROM scored WHERE target = 1)),
held AS (SELECT detailed_label FROM families
         WHERE r <= GREATEST(1, round_even(total * CAST(0.3 AS DOUBLE), 0))),
family_split AS (
  SELECT *, CASE WHEN target = 1 AND detailed_label IN (SELECT detailed_label FROM held) THEN 'test'
    WHEN target = 0 AND r <= CEIL(n * CAST(0.3 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY target) AS n,
          ROW_NUMBER() OVER (PARTITION BY target ORDER BY {SPLIT_HASH}, session_id) AS r
        FROM scored))"""


@query("held_out_family_split", sql.over_scores(
    "SELECT session_id, target, detailed_label, split FROM family_split", FAMILY_SQL))
def held_out_family_split(spark, folder):
    return splits.held_out_family_split(scored_sessions(spark, folder, stored=True)).select(
        "session_id", "target", "detailed_label", "split")


# ------------------------------------------------------------------ metrics


def totals_sql(source: str, score: str) -> str:
    """Running totals per distinct score, as table ``pt``."""
    return f"""
ds AS (SELECT {score} AS score, SUM(target) AS pos, SUM(1 - target) AS neg FROM {source} GROUP BY 1),
pt AS (SELECT score, pos, neg, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp,
         SUM(pos) OVER () AS np, SUM(neg) OVER () AS nn,
         LEAD(pos) OVER w AS pos2, LEAD(neg) OVER w AS neg2
       FROM ds WINDOW w AS (ORDER BY score DESC))"""


AP = "SUM(pos / CAST(np AS DOUBLE) * (tp / CAST(tp + fp AS DOUBLE)))"
AUC = "SUM(neg * (tp - pos / CAST(2 AS DOUBLE))) / (CAST(MAX(np) AS DOUBLE) * MAX(nn))"
RISK_POINTS = totals_sql("scored", "risk_score")


@query("average_precision", sql.over_scores(f"SELECT ROUND({AP}, 6) AS pr_auc FROM pt", RISK_POINTS))
def average_precision(spark, folder):
    return rounded(curves.average_precision(scored_sessions(spark, folder), "risk_score"),
                   {"pr_auc": 6})


@query("roc_auc", sql.over_scores(f"SELECT ROUND({AUC}, 6) AS roc_auc FROM pt", RISK_POINTS))
def roc_auc(spark, folder):
    return rounded(curves.roc_auc(scored_sessions(spark, folder), "risk_score"), {"roc_auc": 6})


@query("pr_curve", sql.over_scores("""
SELECT score AS threshold, ROUND(tp / CAST(tp + fp AS DOUBLE), 6) AS "precision",
  ROUND(tp / CAST(np AS DOUBLE), 6) AS recall FROM pt
UNION ALL SELECT NULL, 1.0, 0.0""", RISK_POINTS))
def pr_curve(spark, folder):
    return rounded(curves.pr_curve(scored_sessions(spark, folder), "risk_score"),
                   {"threshold": None, "precision": 6, "recall": 6})


@query("roc_curve", sql.over_scores("""
SELECT score AS threshold, ROUND(fp / CAST(nn AS DOUBLE), 6) AS fpr,
  ROUND(tp / CAST(np AS DOUBLE), 6) AS tpr FROM pt
WHERE tp + fp = pos + neg OR pos2 IS NULL OR pos2 <> pos OR neg2 <> neg
UNION ALL SELECT NULL, 0.0, 0.0""", RISK_POINTS))
def roc_curve(spark, folder):
    return rounded(curves.roc_curve(scored_sessions(spark, folder), "risk_score"),
                   {"threshold": None, "fpr": 6, "tpr": 6})


@query("recall_at_precision", sql.over_scores("""
SELECT ROUND(COALESCE(MAX(tp / CAST(np AS DOUBLE)) FILTER (
  WHERE tp / CAST(tp + fp AS DOUBLE) >= CAST(0.9 AS DOUBLE)), 0), 6) AS recall FROM pt""",
                                              RISK_POINTS))
def recall_at_precision(spark, folder):
    return rounded(curves.recall_at_precision(scored_sessions(spark, folder), 0.9, "risk_score"),
                   {"recall": 6})


def counts_sql(source: str, score: str, threshold: str, group: str = "") -> str:
    """Confusion counts at a threshold, as table ``cm``."""
    head = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""
cm AS (SELECT {head}COUNT(*) FILTER (WHERE {score} >= {threshold} AND target = 1) AS tp,
         COUNT(*) FILTER (WHERE {score} >= {threshold} AND target = 0) AS fp,
         COUNT(*) FILTER (WHERE {score} < {threshold} AND target = 1) AS fn,
         COUNT(*) FILTER (WHERE {score} < {threshold} AND target = 0) AS tn
       FROM {source} {tail})"""


METRICS_SQL = """tp, fp, fn, tn,
  ROUND(COALESCE(tp / CAST(NULLIF(tp + fp, 0) AS DOUBLE), 0), 6) AS precision_at_threshold,
  ROUND(COALESCE(tp / CAST(NULLIF(tp + fn, 0) AS DOUBLE), 0), 6) AS recall_at_threshold,
  ROUND(COALESCE(2 * tp / CAST(NULLIF(2 * tp + fp + fn, 0) AS DOUBLE), 0), 6) AS f1_at_threshold,
  ROUND((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy"""
METRIC_PLACES = {"tp": None, "fp": None, "fn": None, "tn": None, "precision_at_threshold": 6,
                 "recall_at_threshold": 6, "f1_at_threshold": 6, "accuracy": 6}
AT_MIDDLE = counts_sql("scored", "risk_score", "CAST(0.5 AS DOUBLE)")


@query("threshold_metrics", sql.over_scores(f"SELECT {METRICS_SQL} FROM cm", AT_MIDDLE))
def threshold_metrics(spark, folder):
    return rounded(curves.threshold_metrics(scored_sessions(spark, folder), MIDDLE, "risk_score"),
                   METRIC_PLACES)


@query("fp_per_day", sql.over_scores("""
SELECT ROUND(fp / CAST(GREATEST(1, fp + tn) AS DOUBLE) * 1000, 6) AS false_positives_per_day
FROM cm""", AT_MIDDLE))
def fp_per_day(spark, folder):
    return rounded(curves.false_positives_per_day(
        scored_sessions(spark, folder), MIDDLE, DEFAULTS.flows_per_day, "risk_score"),
        {"false_positives_per_day": 6})


@query("confusion_matrix", sql.over_scores("""
SELECT 0 AS actual, 0 AS predicted, tn AS n FROM cm UNION ALL SELECT 0, 1, fp FROM cm
UNION ALL SELECT 1, 0, fn FROM cm UNION ALL SELECT 1, 1, tp FROM cm""", AT_MIDDLE))
def confusion_matrix(spark, folder):
    return curves.confusion_matrix(scored_sessions(spark, folder), MIDDLE, "risk_score")


@query("recall_at_threshold", sql.over_scores("""
SELECT ROUND(AVG(CASE WHEN risk_score >= 0.9 THEN 1 ELSE 0 END), 6) AS recall_at_threshold
FROM scored WHERE target = 1"""))
def recall_at_threshold(spark, folder):
    return rounded(curves.recall_at_threshold(scored_sessions(spark, folder), 0.9, "risk_score"),
                   {"recall_at_threshold": 6})


@query("split_comparison", sql.over_scores(f"""
SELECT split, {METRICS_SQL} FROM cm""", f"""
strat AS (
  SELECT *, CASE WHEN r <= round_even(n * CAST(0.7 AS DOUBLE), 0) THEN 'train'
    WHEN r <= round_even(n * CAST(0.85 AS DOUBLE), 0) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY target) AS n,
          ROW_NUMBER() OVER (PARTITION BY target ORDER BY {SPLIT_HASH}, session_id) AS r
        FROM scored))""", TEMPORAL_SQL, FAMILY_SQL, """
tests AS (SELECT 'random' AS split, target, risk_score FROM strat WHERE split = 'test'
  UNION ALL SELECT 'temporal', target, risk_score FROM timed_split WHERE split = 'test'
  UNION ALL SELECT 'held_out_family', target, risk_score FROM family_split WHERE split = 'test')""",
    counts_sql("tests", "risk_score", "CAST(0.5 AS DOUBLE)", "split")))
def split_comparison(spark, folder):
    """Metrics of the three test sets side by side."""
    scored = scored_sessions(spark, folder, stored=True)
    parts = {"random": splits.stratified_split, "temporal": splits.temporal_split,
             "held_out_family": splits.held_out_family_split}
    tests = None
    for name, assign in parts.items():
        one = assign(scored).where("split = 'test'").select(
            F.lit(name).alias("split"), "target", "risk_score")
        tests = one if tests is None else tests.unionByName(one)
    return rounded(curves.threshold_metrics(tests, MIDDLE, "risk_score", by=["split"]),
                   {"split": None, **METRIC_PLACES})


# ------------------------------------------------------------------ fusion and verdicts


@query("fuse_weighted", sql.over_scores("SELECT session_id, risk_score FROM scored"))
def fuse_weighted(spark, folder):
    scored = scored_sessions(spark, folder)
    return scored.select("session_id", F.round(fusion.fuse(), 6).alias("risk_score"))


@query("fuse_max", sql.over_scores("""
SELECT session_id, GREATEST(supervised_score, anomaly_score) AS risk_score FROM scored"""))
def fuse_max(spark, folder):
    settings = DEFAULTS.with_(fusion_method="max_score")
    scored = scored_sessions(spark, folder)
    return scored.select("session_id", fusion.fuse(settings=settings).alias("risk_score"))


def _fusion_sql(name: str, score: str) -> str:
    return f"""
SELECT '{name}' AS method, ROUND({AP}, 6) AS pr_auc FROM (
  SELECT pos, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER () AS np
  FROM (SELECT {score} AS score, SUM(target) AS pos, SUM(1 - target) AS neg FROM scored GROUP BY 1)
  WINDOW w AS (ORDER BY score DESC))"""


@query("fusion_comparison", sql.over_scores(
    _fusion_sql("weighted_average", "risk_score") + " UNION ALL "
    + _fusion_sql("max_score", "GREATEST(supervised_score, anomaly_score)")))
def fusion_comparison(spark, folder):
    scored = scored_sessions(spark, folder)
    return rounded(fusion.compare_fusion(scored, places=6), {"method": None, "pr_auc": 6})


@query("calibrate_thresholds", sql.over_scores(
    "SELECT ROUND(tau_low, 6) AS tau_low, ROUND(tau_high, 6) AS tau_high FROM tau", sql.TAU))
def calibrate_thresholds(spark, folder):
    scored = scored_sessions(spark, folder, stored=True)
    return rounded(decision.thresholds_frame(scored, decision.calibrate_thresholds(scored)),
                   {"tau_low": 6, "tau_high": 6})


ACTION_SQL = """CASE WHEN risk_score >= tau_high THEN 'BLOCK' WHEN risk_score >= tau_low THEN 'ALERT'
  ELSE 'ALLOW' END AS action"""


@query("decide", sql.over_scores(
    f"SELECT session_id, risk_score, {ACTION_SQL} FROM scored, tau", sql.TAU))
def decide(spark, folder):
    scored = scored_sessions(spark, folder, stored=True)
    verdict = decision.decide("risk_score", decision.calibrate_thresholds(scored))
    return scored.select("session_id", "risk_score", verdict.alias("action"))


@query("flagship", sql.over_scores(f"""
SELECT session_id, ROUND(iat_cv, 6) AS iat_cv, ROUND(silent, 6) AS resp_bytes_is_zero, risk_score,
  {ACTION_SQL} FROM scored, tau""", sql.TAU))
def flagship(spark, folder):
    """Riskiest sessions first: flows -> sessions -> scores -> budgeted verdicts."""
    scored = scored_sessions(spark, folder, stored=True)
    verdict = decision.decide("risk_score", decision.calibrate_thresholds(scored))
    return scored.select(
        "session_id", F.round("iat_cv", 6).alias("iat_cv"),
        F.round("resp_bytes_is_zero", 6).alias("resp_bytes_is_zero"), "risk_score",
        verdict.alias("action")).orderBy(F.desc("risk_score"), "session_id")


LOG_SCHEMA = ("session_id string, flow_id string, capture_id string, risk_score double, "
              "supervised_score double, anomaly_score double, action string")


@query("decision_log", sql.over_scores(f"""
SELECT session_id, last_uid AS flow_id, capture_id, risk_score, supervised_score, anomaly_score,
  {ACTION_SQL} FROM scored, tau""", sql.TAU))
def decision_log(spark, folder):
    """The log is written by action and read back."""
    scored = scored_sessions(spark, folder, stored=True)
    log = decision.decision_log(scored, decision.calibrate_thresholds(scored), stamped=False)
    path = scratch_path(spark, "decisions")
    sinks.save_decision_log(log, path)
    return sinks.read_decision_log(spark, path, LOG_SCHEMA)


@query("top_risk", sql.over_scores(
    "SELECT session_id, risk_score FROM scored ORDER BY risk_score DESC, session_id LIMIT 10"))
def top_risk(spark, folder):
    return (scored_sessions(spark, folder).select("session_id", "risk_score")
            .orderBy(F.desc("risk_score"), "session_id").limit(10))


@query("block_cap", sql.over_scores(f"""
SELECT session_id, CASE WHEN action = 'BLOCK' AND r > 2 THEN 'ALERT' ELSE action END AS action
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY CAST(FLOOR(first_us / 86400000000) AS BIGINT), action
        ORDER BY risk_score DESC, session_id) AS r
      FROM (SELECT session_id, first_us, risk_score, {ACTION_SQL} FROM scored, tau))""", sql.TAU))
def block_cap(spark, folder):
    """No more than two BLOCK verdicts per day."""
    scored = scored_sessions(spark, folder, stored=True)
    verdict = decision.decide("risk_score", decision.calibrate_thresholds(scored))
    log = scored.select("session_id", "first_us", "risk_score", verdict.alias("action"))
    day = F.floor(F.col("first_us") / F.lit(86_400_000_000))
    return decision.cap_blocks(log, 2, day).select("session_id", "action")


# ------------------------------------------------------------------ anomaly score shaping


@query("benign_threshold", sql.over_scores("""
SELECT ROUND(QUANTILE_CONT(iat_cv, 0.95), 6) AS threshold FROM scored WHERE target = 0"""))
def benign_threshold_query(spark, folder):
    scored = scored_sessions(spark, folder, stored=True)
    value = benign_threshold(scored, "iat_cv")
    return spark.createDataFrame([(value,)], "threshold double").select(
        F.round("threshold", 6).alias("threshold"))


@query("normalise_score", sql.over_scores("""
SELECT session_id, ROUND(1 / (1 + EXP(-(iat_cv - t) / (t + 1e-9))), 6) AS anomaly_score
FROM scored, (SELECT QUANTILE_CONT(iat_cv, 0.95) AS t FROM scored WHERE target = 0)"""))
def normalise_score(spark, folder):
    scored = scored_sessions(spark, folder, stored=True)
    limit = benign_threshold(scored, "iat_cv")
    return scored.select("session_id", F.round(normalised("iat_cv", limit), 6).alias("anomaly_score"))


@query("host_risk", sql.over_scores("""
SELECT orig_h, MAX(risk_score) AS max_risk, ROUND(AVG(risk_score), 5) AS mean_risk,
  COUNT(*) AS n_sessions, COUNT(*) FILTER (WHERE risk_score >= 0.5) AS n_risky,
  n_name AS site
FROM scored JOIN (SELECT DISTINCT orig_h, user_id FROM flows) USING (orig_h)
LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey
GROUP BY orig_h, n_name"""))
def host_risk(spark, folder):
    """Risk per inside host, with the site from the host inventory."""
    scored = scored_sessions(spark, folder)
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    address = F.concat(F.lit("10.0."), F.floor(F.col("c_custkey") / 256).cast("string"), F.lit("."),
                       (F.col("c_custkey") % 256).cast("string"))
    inventory = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        address.alias("orig_h"), F.col("n_name").alias("site"))
    return rounded(aggregate(scored, inventory), {
        "orig_h": None, "max_risk": None, "mean_risk": 5, "n_sessions": None, "n_risky": None,
        "site": None})
