"""Queries over session features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsetrace.config import (
    CONTEXT_FEATURES, DEFAULTS, STATE_CATEGORIES, STATE_FEATURES, TIMING_FEATURES, VOLUME_FEATURES,
)
from pulsetrace.operators import features
from pulsetrace.operators.labels import binary_target
from pulsetrace.operators.sessions import session_id
from pulsetrace.plans import sql
from pulsetrace.plans.inputs import kept_flows, rounded
from pulsetrace.plans.registry import query
from pulsetrace.sources import views

SPECTRAL = ("periodicity_score", "fft_dominant_power")
SECONDS = ("iat_mean", "iat_std", "iat_median", "iat_min", "iat_max", "iat_mad")
LARGE = ("session_byte_variance", "bytes_per_second")


def places(columns):
    """Second- and byte-scale values to 2 places, ratios and logs to 6."""
    # Mean durations have up to 8 exact places, so 6 would meet rounding ties.
    return {c: 2 if c in SECONDS or c in LARGE else 8 if c == "duration" else 6 for c in columns}


TIMING_PLAIN = [c for c in TIMING_FEATURES if c not in SPECTRAL]


def _named(table):
    return table.withColumn("session_id", session_id())


@query("timing_features", sql.over_sessions(
    f"SELECT session_id, {sql.rounded(places(TIMING_FEATURES))} FROM tf JOIN sf USING (session_id)",
    sql.timing(), sql.SPECTRAL))
def timing_features(spark, folder):
    table = features.session_features(kept_flows(spark, folder), blocks=("timing", "periodicity"))
    return rounded(_named(table), {"session_id": None, **places(TIMING_FEATURES)})


LONG_PARTS = ("""
iv AS (SELECT *, ts_us - LAG(ts_us) OVER (PARTITION BY orig_h, resp_h, resp_p ORDER BY ts_us, uid)
         AS iat_us FROM flows_long)""", sql.timing())
LONG_COLUMNS = [c for c in TIMING_PLAIN if c != "duty_cycle"]


@query("timing_long", "WITH " + ",\n".join(p.strip() for p in (sql.LONG, *LONG_PARTS)) + f"""
SELECT session_id, ROUND(duty_cycle, 8) AS duty_cycle, {sql.rounded(places(LONG_COLUMNS))}
FROM tf WHERE n_flows >= 4""")
def timing_long(spark, folder):
    """The timing block on long sessions with many equal timestamps."""
    flows = binary_target(views.flows_long(spark, folder))
    table = features.session_features(flows, blocks=("timing",))
    return rounded(_named(table), {"session_id": None, "duty_cycle": 8, **places(LONG_COLUMNS)})


@query("iat_mad", sql.over_sessions(
    "SELECT session_id, ROUND(iat_median, 2) AS iat_median, ROUND(iat_mad, 2) AS iat_mad FROM tf",
    sql.timing()))
def iat_mad(spark, folder):
    table = features.session_features(kept_flows(spark, folder), blocks=("timing",))
    return rounded(_named(table), {"session_id": None, "iat_median": 2, "iat_mad": 2})


@query("periodicity", sql.over_sessions(
    "SELECT session_id, ROUND(periodicity_score, 6) AS periodicity_score FROM sf", sql.SPECTRAL))
def periodicity(spark, folder):
    table = features.session_features(kept_flows(spark, folder), blocks=("periodicity",))
    return rounded(_named(table), {"session_id": None, "periodicity_score": 6})


@query("spectral_power", sql.over_sessions(
    "SELECT session_id, ROUND(fft_dominant_power, 6) AS fft_dominant_power FROM sf", sql.SPECTRAL))
def spectral_power(spark, folder):
    table = features.session_features(kept_flows(spark, folder), blocks=("periodicity",))
    return rounded(_named(table), {"session_id": None, "fft_dominant_power": 6})


@query("hot_session_timing", sql.over_sessions(
    f"SELECT session_id, {sql.rounded(places(TIMING_FEATURES))} FROM tf JOIN sf USING (session_id)",
    sql.timing(), sql.SPECTRAL))
def hot_session_timing(spark, folder):
    """The timing block with every session above twelve flows on the distributed path."""
    settings = DEFAULTS.with_(hot_session_flows=12)
    table = features.session_features(kept_flows(spark, folder), settings,
                                      ("timing", "periodicity"))
    return rounded(_named(table), {"session_id": None, **places(TIMING_FEATURES)})


@query("volume_features", sql.over_sessions(
    f"SELECT session_id, {sql.rounded(places(VOLUME_FEATURES))} FROM vf", sql.VOLUME))
def volume_features(spark, folder):
    table = features.session_features(kept_flows(spark, folder), blocks=("volume",))
    return rounded(_named(table), {"session_id": None, **places(VOLUME_FEATURES)})


@query("log_transform", sql.script("""
SELECT uid, ROUND(LN(1 + GREATEST(CAST(orig_bytes AS DOUBLE) - 50, 0)), 6) AS orig_bytes,
  ROUND(LN(1 + GREATEST(duration, 0)), 6) AS duration FROM flows WHERE duration IS NOT NULL"""))
def log_transform(spark, folder):
    flows = views.flows(spark, folder).where("duration IS NOT NULL").select(
        "uid", (F.col("orig_bytes").cast("double") - 50).alias("orig_bytes"), "duration")
    return rounded(features.log_transform(flows, ["orig_bytes", "duration"]),
                   {"uid": None, "orig_bytes": 6, "duration": 6})


@query("connstate_features", sql.over_sessions(
    f"""SELECT session_id, {', '.join(STATE_CATEGORIES)},
    {', '.join(f'ROUND("{c}", 6) AS "{c}"' for c in STATE_FEATURES)} FROM cf""", sql.STATE))
def connstate_features(spark, folder):
    table = features.session_features(kept_flows(spark, folder), blocks=("state",))
    return rounded(_named(table), {"session_id": None, **dict.fromkeys(STATE_CATEGORIES),
                                   **places(STATE_FEATURES)})


@query("context_features", sql.over_sessions(
    "SELECT session_id, dest_fanin, src_fanout, dest_flow_count FROM xf", sql.CONTEXT))
def context_features(spark, folder):
    table = features.session_features(kept_flows(spark, folder), blocks=())
    return _named(features.add_context(table)).select("session_id", *CONTEXT_FEATURES)


@query("capture_context", sql.over_sessions("""
SELECT DISTINCT session_id, dest_fanin, src_fanout, dest_flow_count FROM iv
JOIN (SELECT resp_h, CAST(COUNT(DISTINCT orig_h) AS DOUBLE) AS dest_fanin,
        CAST(COUNT(*) AS DOUBLE) AS dest_flow_count FROM flows GROUP BY resp_h) USING (resp_h)
JOIN (SELECT orig_h, CAST(COUNT(DISTINCT resp_h) AS DOUBLE) AS src_fanout FROM flows
      GROUP BY orig_h) USING (orig_h)"""))
def capture_context(spark, folder):
    """The context block counted over the whole capture, dropped labels and short sessions included."""
    table = features.session_features(kept_flows(spark, folder), blocks=())
    return _named(features.context_from(table, views.flows(spark, folder), DEFAULTS.session_keys)
                  ).select("session_id", *CONTEXT_FEATURES)


ALL_PARTS = (sql.timing(), sql.SPECTRAL, sql.VOLUME, sql.STATE, sql.CONTEXT, sql.META)
MATRIX = {**places(TIMING_FEATURES), **places(VOLUME_FEATURES), **places(STATE_FEATURES),
          **places(CONTEXT_FEATURES)}
MATRIX_JOIN = """tf JOIN sf USING (session_id) JOIN vf USING (session_id) JOIN cf USING (session_id)
  JOIN xf USING (session_id) JOIN mt USING (session_id)"""


def matrix_columns(names):
    home = {**dict.fromkeys(TIMING_PLAIN, "tf"), **dict.fromkeys(SPECTRAL, "sf"),
            **dict.fromkeys(VOLUME_FEATURES, "vf"), **dict.fromkeys(STATE_FEATURES, "cf"),
            **dict.fromkeys(CONTEXT_FEATURES, "xf")}
    return ", ".join(f'ROUND({home[c]}."{c}", {MATRIX[c]}) AS "{c}"' for c in names)


@query("feature_matrix", sql.over_sessions(
    f"""SELECT session_id, mt.target, mt.last_uid, {', '.join('cf.' + c for c in STATE_CATEGORIES)},
    {matrix_columns(MATRIX)} FROM {MATRIX_JOIN}""", *ALL_PARTS))
def feature_matrix(spark, folder):
    matrix = features.feature_matrix(kept_flows(spark, folder))
    return rounded(matrix, {"session_id": None, "target": None, "last_uid": None,
                            **dict.fromkeys(STATE_CATEGORIES), **MATRIX})


TIER1 = [*STATE_FEATURES, *TIMING_FEATURES]


@query("select_tiers", sql.over_sessions(
    f"""SELECT session_id, mt.target, {', '.join('cf.' + c for c in STATE_CATEGORIES)},
    {matrix_columns(TIER1)} FROM {MATRIX_JOIN}""", *ALL_PARTS))
def select_tiers(spark, folder):
    chosen = features.select_tiers(features.feature_matrix(kept_flows(spark, folder)),
                                   ["tier1", "no-such-tier"])
    return rounded(chosen, {"session_id": None, "target": None, **dict.fromkeys(STATE_CATEGORIES),
                            **{c: MATRIX[c] for c in TIER1}})


SUMMARISED = (*TIMING_FEATURES, *VOLUME_FEATURES, *CONTEXT_FEATURES)
#: Places in which sums of large numbers agree whatever their order.
COARSE = {"session_byte_variance": -4, "bytes_per_second": 0, "resp_bytes": 3, "orig_bytes": 3}
STATISTICS = ("mean", "std", "min", "q25", "q50", "q75", "max")


def _summary_sql() -> str:
    home = {**dict.fromkeys(TIMING_PLAIN, "tf"), **dict.fromkeys(SPECTRAL, "sf"),
            **dict.fromkeys(VOLUME_FEATURES, "vf"), **dict.fromkeys(CONTEXT_FEATURES, "xf")}
    terms = ("AVG(v)", "STDDEV_SAMP(v)", "MIN(v)", "QUANTILE_CONT(v, 0.25)", "QUANTILE_CONT(v, 0.5)", "QUANTILE_CONT(v, 0.75)", "MAX(v)")
    return " UNION ALL ".join(f"""
SELECT mt.target, '{c}' AS feature, COUNT(*) AS n, {', '.join(
        f'ROUND({t}, {COARSE.get(c, 4)}) AS "{name}"' for t, name in zip(terms, STATISTICS))}
FROM (SELECT session_id, {home[c]}."{c}" AS v FROM {home[c]})
JOIN mt USING (session_id) GROUP BY mt.target""" for c in SUMMARISED)


@query("feature_summary", sql.over_sessions(
    _summary_sql(), sql.timing(), sql.SPECTRAL, sql.VOLUME, sql.CONTEXT, sql.META))
def feature_summary(spark, folder):
    """Every timing, volume and context feature per class."""
    table = features.materialise(features.feature_matrix(kept_flows(spark, folder)))
    found = features.feature_summary(table, SUMMARISED)
    return found.select("target", "feature", "n", *[
        F.coalesce(*[F.when(F.col("feature") == c, F.round(x, p)) for c, p in COARSE.items()], F.round(x, 4)).alias(x)
        for x in STATISTICS])
