"""Queries over perturbed flows, encodings and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS, STATE_CATEGORIES
from pulsetrace.operators import encode, explain, splits, sweeps
from pulsetrace.operators.features import add_context, session_features
from pulsetrace.operators.sessions import session_id
from pulsetrace.plans import sql
from pulsetrace.plans.feature_queries import MATRIX_JOIN
from pulsetrace.plans.inputs import kept_flows, rounded, scored_sessions
from pulsetrace.plans.registry import query
from pulsetrace.plans.score_queries import SPLIT_HASH
from pulsetrace.session import materialise

U = sql.hash_uniform("uid")
LEVELS = "(VALUES (0), (10), (20), (30), (40), (50)) AS lv(jitter_pct)"

JITTER = f"""
paced AS (SELECT *, (MAX(ts_us) OVER s - MIN(ts_us) OVER s)
            / CAST(NULLIF(COUNT(*) OVER s - 1, 0) AS DOUBLE) AS pace
          FROM kept WHERE target = 1 WINDOW s AS (PARTITION BY {sql.KEYS})),
jit AS (SELECT * REPLACE (CASE WHEN pace > 0 THEN ts_us + CAST(FLOOR(
            (CAST(2 AS DOUBLE) * {U} - CAST(1 AS DOUBLE)) * (jitter_pct / CAST(100 AS DOUBLE)) * pace)
            AS BIGINT) ELSE ts_us END AS ts_us)
        FROM paced, {LEVELS}),
jn AS (SELECT *, ts_us - LAG(ts_us) OVER (PARTITION BY jitter_pct, {sql.KEYS} ORDER BY ts_us, uid)
         AS iat_us, COUNT(*) OVER (PARTITION BY jitter_pct, {sql.KEYS}) AS n FROM jit)"""


@query("inject_jitter", sql.script("SELECT uid, ts_us FROM jit WHERE jitter_pct = 30", sql.TARGET,
                                   JITTER))
def inject_jitter(spark, folder):
    positives = kept_flows(spark, folder).where("target = 1")
    return sweeps.inject_jitter(positives, [30]).select("uid", "ts_us")


def _regular(table, settings):
    return table.select("target", "jitter_pct",
                        F.round(1 / (1 + F.col("iat_cv")), 6).alias("score"))


@query("jitter_curve", sql.script("""
SELECT jitter_pct, ROUND(AVG(CASE WHEN score >= CAST(0.85 AS DOUBLE) THEN 1 ELSE 0 END), 6)
    AS recall_at_threshold, CAST(0.85 AS DOUBLE) AS threshold
FROM js GROUP BY jitter_pct""", sql.TARGET, JITTER, f"""
js AS (SELECT jitter_pct, ROUND(1 / (1 + STDDEV_POP(iat_us) / AVG(iat_us)), 6) AS score
       FROM jn WHERE n >= 4 GROUP BY jitter_pct, {sql.KEYS})"""))
def jitter_curve(spark, folder):
    curve = sweeps.jitter_curve(kept_flows(spark, folder), _regular, 0.85, blocks=("timing",))
    return rounded(curve, {"jitter_pct": None, "recall_at_threshold": 6, "threshold": None})


def padding_sql(levels: str) -> str:
    factor = f"(1 + {U} * (padding_factor - 1))"
    return f"""
pad AS (SELECT * REPLACE (
          CAST(round_even(COALESCE(orig_bytes, 0) * {factor}, 0) AS BIGINT) AS orig_bytes,
          CAST(round_even(COALESCE(orig_ip_bytes, 0) * {factor}, 0) AS BIGINT) AS orig_ip_bytes)
        FROM (SELECT *, COUNT(*) OVER (PARTITION BY {sql.KEYS}) AS n FROM kept WHERE target = 1),
          (SELECT CAST(f AS DOUBLE) AS padding_factor FROM (VALUES {levels}) AS x(f)))"""


@query("inject_padding", sql.script("SELECT uid, orig_bytes, orig_ip_bytes FROM pad", sql.TARGET,
                                    padding_sql("(1.5)")))
def inject_padding(spark, folder):
    positives = kept_flows(spark, folder).where("target = 1")
    return sweeps.inject_padding(positives, [1.5]).select("uid", "orig_bytes", "orig_ip_bytes")


def _quiet(table, settings):
    return table.select("target", "padding_factor",
                        F.round(1 / (1 + F.col("orig_resp_byte_ratio")), 6).alias("score"))


@query("padding_curve", sql.script("""
SELECT padding_factor, ROUND(AVG(CASE WHEN score >= CAST(0.25 AS DOUBLE) THEN 1 ELSE 0 END), 6)
    AS recall_at_threshold, CAST(0.25 AS DOUBLE) AS threshold
FROM ps GROUP BY padding_factor""", sql.TARGET, padding_sql("(1.0), (1.25), (1.5), (2.0)"), f"""
ps AS (SELECT padding_factor, ROUND(1 / (1 + CAST(SUM(orig_ip_bytes) AS DOUBLE)
         / (CAST(SUM(COALESCE(resp_ip_bytes, 0)) AS DOUBLE) + 1)), 6) AS score
       FROM pad WHERE n >= 4 GROUP BY padding_factor, {sql.KEYS})"""))
def padding_curve(spark, folder):
    curve = sweeps.padding_curve(kept_flows(spark, folder), _quiet, 0.25, blocks=("volume",))
    return rounded(curve, {"padding_factor": None, "recall_at_threshold": 6, "threshold": None})


def _regular_sql(mean: str, spread: str) -> str:
    return (f"ROUND(1 / (1 + CASE WHEN {mean} > 0 THEN {spread} / {mean} "
            "ELSE CAST(0 AS DOUBLE) END), 6)")


@query("prefix_stability", sql.over_sessions(f"""
SELECT prefix, COUNT(*) AS n_sessions, ROUND(AVG(ABS(early - whole)), 5) AS mean_gap,
  ROUND(AVG(CASE WHEN ABS(early - whole) <= CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END), 6)
    AS stable_share
FROM (SELECT {sql.KEYS}, prefix, {_regular_sql('AVG(iat_us)', 'STDDEV_POP(iat_us)')} AS early
      FROM iv, (VALUES (4), (6), (8)) AS p(prefix) WHERE flow_no < prefix
      GROUP BY {sql.KEYS}, prefix HAVING COUNT(*) = prefix)
JOIN (SELECT {sql.KEYS}, {_regular_sql('AVG(iat_us)', 'STDDEV_POP(iat_us)')} AS whole
      FROM iv GROUP BY {sql.KEYS}) USING ({sql.KEYS})
GROUP BY prefix"""))
def prefix_stability(spark, folder):
    return rounded(sweeps.prefix_stability(kept_flows(spark, folder), [4, 6, 8]), {
        "prefix": None, "n_sessions": None, "mean_gap": 5, "stable_share": 6})


# ------------------------------------------------------------------ encodings

RANDOM_TRAIN = f"""
strat AS (
  SELECT session_id, target, r <= round_even(n * CAST(0.7 AS DOUBLE), 0) AS in_train
  FROM (SELECT session_id, target, COUNT(*) OVER (PARTITION BY target) AS n,
          ROW_NUMBER() OVER (PARTITION BY target ORDER BY {SPLIT_HASH}, session_id) AS r
        FROM (SELECT {sql.SID} AS session_id, MAX(target) AS target FROM iv GROUP BY {sql.KEYS})))"""


@query("one_hot", sql.over_sessions("""
SELECT session_id, column_name, category, CAST(1 AS DOUBLE) AS value FROM (
  SELECT session_id, column_name,
    CASE WHEN v <> 'unknown' AND v IN (SELECT v FROM lg JOIN strat USING (session_id)
      WHERE in_train AND lg.column_name = o.column_name) THEN v ELSE 'unknown' END AS category
  FROM lg o)""", sql.STATE, RANDOM_TRAIN, """
lg AS (SELECT session_id, 'conn_state_mode' AS column_name, conn_state_mode AS v FROM cf
  UNION ALL SELECT session_id, 'proto_mode', proto_mode FROM cf
  UNION ALL SELECT session_id, 'service_mode', service_mode FROM cf)"""))
def one_hot(spark, folder):
    """Categories learned on the training part, applied to all rows; the set slots in long form."""
    table = materialise(session_features(kept_flows(spark, folder), blocks=("state",)).withColumn(
        "session_id", session_id()))
    parts = splits.stratified_split(table)
    words = encode.vocabulary(parts.where("split = 'train'"))
    coded = encode.one_hot(words).transform(parts)
    slots = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(v).alias("category"),
                               F.col(f"`{c}_{v}`").alias("value"))
                      for c in STATE_CATEGORIES for v in [*words[c], "unknown"]])
    return coded.select("session_id", F.inline(slots)).where("value = 1")


SCALED = ("iat_cv", "session_flow_count", "duration_sum")


@query("standardise", sql.over_sessions(f"""
SELECT session_id, {', '.join(f'ROUND(({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER (), 5) AS {c}_z'
                              for c in SCALED)}, CAST(0 AS DOUBLE) AS constant_z
FROM tf""", sql.timing()))
def standardise(spark, folder):
    table = materialise(session_features(kept_flows(spark, folder), blocks=("timing",)).withColumn(
        "constant", F.lit(3.0)))
    stage = encode.standardise(encode.scaling(table, [*SCALED, "constant"]))
    return rounded(stage.transform(table.withColumn("session_id", session_id())), {
        "session_id": None, **{f"{c}_z": 5 for c in SCALED}, "constant_z": 5})


@query("class_weights", sql.over_scores("""
SELECT target, COUNT(*) AS n_rows,
  ROUND((SELECT COUNT(*) FROM scored) / CAST(2 * COUNT(*) AS DOUBLE), 6) AS weight
FROM scored GROUP BY target"""))
def class_weights(spark, folder):
    scored = scored_sessions(spark, folder, stored=True)
    weighted = encode.add_weight(scored, encode.class_weights(scored))
    return weighted.groupBy("target", F.round("weight", 6).alias("weight")).agg(
        F.count("*").alias("n_rows"))


# ------------------------------------------------------------------ explanations

# Weights of a small linear score, fixed so that SQL can state the same attribution.
WEIGHTS = {"iat_cv": -2.0, "resp_bytes_is_zero": 1.5, "dest_fanin": 0.01,
           "periodicity_score": 0.5, "orig_resp_byte_ratio": 0.25, "pkt_ratio": -0.125,
           "session_span_hours": 0.002}
HOME = {"iat_cv": "tf", "resp_bytes_is_zero": "vf", "dest_fanin": "xf", "periodicity_score": "sf",
        "orig_resp_byte_ratio": "vf", "pkt_ratio": "vf", "session_span_hours": "tf"}

ATTRIBUTED = f"""
wide AS (SELECT session_id, {', '.join(f'{HOME[c]}.{c}' for c in WEIGHTS)} FROM {MATRIX_JOIN}),
att AS (""" + "UNION ALL ".join(f"""
  SELECT session_id, '{c}' AS feature, {c} AS value,
    CAST({w} AS DOUBLE) * ({c} - AVG({c}) OVER ()) AS attribution FROM wide """
                                for c, w in WEIGHTS.items()) + """),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id
             ORDER BY ROUND(ABS(attribution), 6) DESC, feature) AS place FROM att)"""
ATTRIBUTION_PARTS = (sql.timing(), sql.SPECTRAL, sql.VOLUME, sql.STATE, sql.CONTEXT, sql.META,
                     ATTRIBUTED)


def _attributed(spark, folder):
    table = add_context(materialise(session_features(
        kept_flows(spark, folder), blocks=("timing", "periodicity", "volume"))))
    wide = materialise(table.select(session_id().alias("session_id"), *WEIGHTS))
    return explain.linear_attribution(wide, WEIGHTS, explain.feature_means(wide, list(WEIGHTS)))


@query("linear_attribution", sql.over_sessions("""
SELECT session_id, feature, ROUND(attribution, 5) AS attribution FROM att""", *ATTRIBUTION_PARTS))
def linear_attribution(spark, folder):
    return _attributed(spark, folder).select("session_id", F.inline("attribution")).select(
        "session_id", "feature", F.round("attribution", 5).alias("attribution"))


@query("top3_reasons", sql.over_sessions("""
SELECT session_id, place, feature, ROUND(attribution, 5) AS attribution FROM ranked WHERE place <= 3
""", *ATTRIBUTION_PARTS))
def top3_reasons(spark, folder):
    reasons = explain.top_reasons(3, places=6)
    return _attributed(spark, folder).select(
        "session_id", F.posexplode(reasons).alias("place", "reason")).select(
        "session_id", (F.col("place") + 1).cast("bigint").alias("place"), "reason.feature",
        F.round("reason.attribution", 5).alias("attribution"))


@query("global_importance", sql.over_sessions("""
SELECT feature, ROUND(AVG(ABS(attribution)), 5) AS importance FROM att GROUP BY feature
ORDER BY importance DESC LIMIT 15""", *ATTRIBUTION_PARTS))
def global_importance(spark, folder):
    """First fifteen features by mean absolute attribution."""
    return rounded(explain.global_importance(_attributed(spark, folder)).limit(15),
                   {"feature": None, "importance": 5})


def _text_sql() -> str:
    words = {
        "iat_cv": "concat('interval CV ', format('{:.2f}', value), CASE WHEN value < 0.15 "
                  "THEN ' (highly regular)' ELSE ' (irregular)' END)",
        "resp_bytes_is_zero": "concat('response bytes ', CASE WHEN value > 0.5 THEN '0' "
                              "ELSE 'nonzero' END)",
        "dest_fanin": "concat('destination fan-in ', "
                      "CAST(CAST(round_even(value, 0) AS BIGINT) AS VARCHAR))",
        "periodicity_score": "concat('periodicity score ', format('{:.2f}', value))",
        "orig_resp_byte_ratio": "concat('upload/download ratio ', format('{:.1f}', value))",
    }
    cases = " ".join(f"WHEN '{c}' THEN " + words.get(
        c, f"concat('{c.replace('_', ' ')} ', format('{{:.3g}}', value))") for c in WEIGHTS)
    return f"CASE feature {cases} END"


@query("explanation_text", sql.over_sessions(f"""
SELECT session_id, string_agg({_text_sql()}, ' · ' ORDER BY place) AS explanation
FROM ranked WHERE place <= 3 GROUP BY session_id""", *ATTRIBUTION_PARTS))
def explanation_text(spark, folder):
    reasoned = _attributed(spark, folder).withColumn("reasons", explain.top_reasons(3, places=6))
    return reasoned.select("session_id", explain.explanation_text("reasons").alias("explanation"))


@query("rank_disagreement", sql.over_sessions("""
SELECT feature, arank AS attribution_rank, brank AS builtin_rank,
  ABS(arank - brank) AS rank_disagreement
FROM (SELECT feature,
        RANK() OVER (ORDER BY i DESC) + (COUNT(*) OVER (PARTITION BY i) - 1) / 2 AS arank,
        RANK() OVER (ORDER BY b DESC) + (COUNT(*) OVER (PARTITION BY b) - 1) / 2 AS brank
      FROM (SELECT feature, ROUND(AVG(ABS(attribution)), 6) AS i,
              CAST(STDDEV_POP(value) > 1 AS DOUBLE) AS b
            FROM att GROUP BY feature))""", *ATTRIBUTION_PARTS))
def rank_disagreement(spark, folder):
    """Attribution rank against a coarse second importance with many ties."""
    rows = materialise(_attributed(spark, folder).select("session_id", F.inline("attribution")))
    importance = rows.groupBy("feature").agg(
        F.round(F.avg(F.abs("attribution")), 6).alias("importance"))
    builtin = rows.groupBy("feature").agg(
        (F.stddev_pop("value") > 1).cast("double").alias("builtin_importance"))
    return explain.rank_disagreement(importance, builtin).select(
        "feature", "attribution_rank", "builtin_rank", "rank_disagreement")
