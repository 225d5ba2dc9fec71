"""Queries over single flows and over sessions as sequences of flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS, NATIVE_LOG_COLUMNS, NUMERIC_TYPES, REQUIRED_COLUMNS
from pulsetrace.operators import labels, quality, sessions
from pulsetrace.operators.features import session_features
from pulsetrace.plans import sql
from pulsetrace.plans.inputs import kept_flows
from pulsetrace.plans.registry import query
from pulsetrace.session import scratch_path
from pulsetrace.sources import views
from pulsetrace.sources.flow_logs import (
    canonical_name, load_captures, prepare_flows, read_csv_export, read_native_log,
)

LOGGED = ("uid", "ts_us", "orig_h", "orig_p", "resp_h", "resp_p", "proto", "service", "duration",
          "orig_bytes", "resp_bytes", "conn_state", "history", "orig_pkts", "resp_ip_bytes",
          "detailed_label", "capture_id")
LOGGED_SQL = sql.script(f"""
SELECT {', '.join('ROUND(duration, 6) AS duration' if c == 'duration' else c for c in LOGGED)}
FROM flows""")


def _logged(df):
    return df.select(*[F.round(c, 6).alias(c) if c == "duration" else F.col(c) for c in LOGGED])


def _as_text(flows):
    """Every native column as text, nulls as the log's token."""
    known = set(flows.columns)
    return [F.coalesce(F.col(c).cast("string"), F.lit("-")) if c in known else F.lit("-")
            for c in map(canonical_name, NATIVE_LOG_COLUMNS)]


def write_native_log(flows, path):
    """Tab-separated lines, one folder per capture; the last three values share a field."""
    cells = _as_text(flows)
    line = F.concat(F.concat_ws("\t", *cells[:-2]), F.lit("   "), cells[-2], F.lit("   "), cells[-1])
    flows.select(line.alias("value"), "capture_id").write.partitionBy("capture_id").text(path)


def write_csv_export(flows, path):
    """Gzipped export with an unnamed index column and a single label column."""
    names = NATIVE_LOG_COLUMNS[:-2]
    cells = _as_text(flows)
    flows.select(
        F.monotonically_increasing_id().alias("Unnamed: 0"),
        *[cell.alias(n) for cell, n in zip(cells[:-2], names)], cells[-1].alias("label"),
        "capture_id",
    ).write.partitionBy("capture_id").option("header", True).option("compression", "gzip").csv(path)


@query("read_flow_log", LOGGED_SQL)
def read_flow_log(spark, folder):
    path = scratch_path(spark, "native")
    write_native_log(views.flows(spark, folder), path)
    return _logged(read_native_log(spark, path))


@query("read_flow_csv", LOGGED_SQL)
def read_flow_csv(spark, folder):
    path = scratch_path(spark, "csv")
    write_csv_export(views.flows(spark, folder), path)
    return _logged(read_csv_export(spark, path))


@query("load_captures", LOGGED_SQL)
def load_captures_query(spark, folder):
    """One capture comes as native logs, the others as CSV; both are appended."""
    flows = views.flows(spark, folder)
    native, export = scratch_path(spark, "native"), scratch_path(spark, "csv")
    first = F.col("capture_id") == "capture-0"
    write_native_log(flows.where(first), native)
    write_csv_export(flows.where(~first), export)
    return _logged(load_captures(spark, [("native", native), ("csv", export)]))


@query("null_token", sql.script("""
SELECT uid, NULLIF(service, '-') AS service, NULLIF(history, '-') AS history FROM raw""", """
raw AS (SELECT uid, COALESCE(service, '-') AS service, COALESCE(history, '-') AS history
        FROM flows)"""))
def null_token(spark, folder):
    raw = views.flows(spark, folder).select(
        "uid", F.coalesce("service", F.lit("-")).alias("service"),
        F.coalesce("history", F.lit("-")).alias("history"))
    return quality.null_token(raw)


@query("schema_check", sql.script(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS n_null FROM flows"
    for c in REQUIRED_COLUMNS)))
def schema_check(spark, folder):
    return quality.schema_report(views.flows(spark, folder))


#: Every column of the test view.
PROFILED = ("ts", "ts_us", "uid", "orig_h", "orig_p", "resp_h", "resp_p", "proto", "service", "duration", "orig_bytes",
            "resp_bytes", "conn_state", "history", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
            "detailed_label", "capture_id", "k", "user_id")
NUMBERS = {c: k for c, k in NUMERIC_TYPES.items() if c in PROFILED}


def _spoiled_sql(name: str, kind: str) -> str:
    text = f"CASE WHEN orig_p % {3 + len(name) % 4} = 0 THEN '-' ELSE CAST({name} AS VARCHAR) END"
    return (f"ROUND(TRY_CAST({text} AS DOUBLE), 6) AS {name}" if kind == "double" else f"TRY_CAST({text} AS BIGINT) AS {name}")


@query("coerce_numeric", sql.script(f"""
SELECT uid, {', '.join(_spoiled_sql(c, k) for c, k in NUMBERS.items())} FROM flows"""))
def coerce_numeric(spark, folder):
    """Every numeric column, read from text that holds the null token in some rows."""
    flows = views.flows(spark, folder)
    raw = flows.select("uid", *[
        F.when(F.col("orig_p") % (3 + len(c) % 4) == 0, "-").otherwise(F.col(c).cast("string")).alias(c) for c in NUMBERS])
    found = quality.coerce_numeric(raw)
    return found.select("uid", *[F.round(c, 6).alias(c) if k == "double" else F.col(c).cast("bigint").alias(c)
                                 for c, k in NUMBERS.items()])


@query("data_profile", sql.script(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS n_rows, "
    f"ROUND((COUNT(*) - COUNT({c})) / CAST(COUNT(*) AS DOUBLE), 4) AS null_fraction FROM flows"
    for c in PROFILED)))
def data_profile(spark, folder):
    return quality.data_profile(views.flows(spark, folder))


@query("label_distribution", sql.script("""
SELECT detailed_label, COUNT(*) AS n_rows,
  ROUND(COUNT(*) / CAST((SELECT COUNT(*) FROM flows) AS DOUBLE), 6) AS fraction
FROM flows GROUP BY detailed_label"""))
def label_distribution(spark, folder):
    return quality.label_distribution(views.flows(spark, folder))


@query("stratified_sample", sql.script(f"""
SELECT uid, detailed_label FROM (
  SELECT uid, detailed_label, COUNT(*) OVER (PARTITION BY detailed_label) AS n,
    (SELECT COUNT(*) FROM flows) AS total,
    ROW_NUMBER() OVER (PARTITION BY detailed_label ORDER BY {sql.hash60('uid')}, uid) AS r
  FROM flows)
WHERE r <= round_even(n * (500 / CAST(total AS DOUBLE)), 0)"""))
def stratified_sample(spark, folder):
    return quality.stratified_sample(views.flows(spark, folder), 500).select("uid", "detailed_label")


@query("binary_target", sql.script("SELECT uid, detailed_label, target FROM kept", sql.TARGET))
def binary_target(spark, folder):
    return kept_flows(spark, folder).select("uid", "detailed_label", "target")


@query("unrecognised_labels", sql.script(f"""
SELECT detailed_label, COUNT(*) AS n_rows FROM flows WHERE detailed_label NOT IN {sql.KNOWN}
GROUP BY detailed_label"""))
def unrecognised_labels(spark, folder):
    return labels.unrecognised_labels(views.flows(spark, folder))


@query("target_accounting", sql.script(f"""
SELECT COUNT(*) FILTER (WHERE detailed_label IN {sql.POSITIVE}) AS n_positive,
  COUNT(*) FILTER (WHERE detailed_label IN {sql.NEGATIVE}) AS n_negative,
  COUNT(*) FILTER (WHERE detailed_label NOT IN {sql.KEPT}) AS n_excluded, COUNT(*) AS n_total
FROM flows"""))
def target_accounting(spark, folder):
    return labels.target_accounting(views.flows(spark, folder))


@query("fold_rare_classes", sql.script("""
SELECT uid, detailed_label, CASE WHEN detailed_label LIKE 'C&C%' AND n < 102 THEN 'other-C&C'
                                 ELSE detailed_label END AS multiclass_label
FROM (SELECT *, COUNT(*) OVER (PARTITION BY detailed_label) AS n FROM kept)""", sql.TARGET))
def fold_rare_classes(spark, folder):
    settings = DEFAULTS.with_(rare_class_min_count=102)
    return labels.fold_rare_classes(kept_flows(spark, folder), settings).select(
        "uid", "detailed_label", "multiclass_label")


@query("multiclass_target", sql.script("""
SELECT uid, target, CASE WHEN detailed_label = 'Benign' THEN 'benign'
  WHEN contains(detailed_label, 'HeartBeat') THEN 'heartbeat' ELSE 'other' END AS analysis_class
FROM kept""", sql.TARGET))
def multiclass_target(spark, folder):
    return labels.multiclass_target(views.flows(spark, folder)).select(
        "uid", "target", "analysis_class")


@query("prepare_flows", sql.script("""
SELECT uid, target, ROUND(duration, 6) AS duration,
  CASE WHEN detailed_label LIKE 'C&C%' AND n < 50 THEN 'other-C&C' ELSE detailed_label END
    AS multiclass_label
FROM (SELECT *, COUNT(*) OVER (PARTITION BY detailed_label) AS n FROM kept)""", sql.TARGET))
def prepare_flows_query(spark, folder):
    return prepare_flows(views.flows(spark, folder)).select(
        "uid", "target", F.round("duration", 6).alias("duration"), "multiclass_label")


@query("session_id", sql.script(f"SELECT uid, {sql.SID} AS session_id FROM flows"))
def session_id(spark, folder):
    return views.flows(spark, folder).select("uid", sessions.session_id().alias("session_id"))


@query("short_session_filter", sql.over_sessions("SELECT uid, target FROM iv"))
def short_session_filter(spark, folder):
    return sessions.filter_short_sessions(kept_flows(spark, folder)).select("uid", "target")


@query("short_session_semi", sql.over_sessions("SELECT uid, target FROM iv"))
def short_session_semi(spark, folder):
    return sessions.filter_short_sessions_semi(kept_flows(spark, folder)).select("uid", "target")


@query("discard_rate", sql.script(f"""
SELECT COUNT(*) AS sessions_total, COUNT(*) FILTER (WHERE n >= 4) AS sessions_kept,
  CAST(SUM(n) AS BIGINT) AS flows_total,
  CAST(SUM(n) FILTER (WHERE n >= 4) AS BIGINT) AS flows_kept,
  ROUND(1 - SUM(n) FILTER (WHERE n >= 4) / CAST(SUM(n) AS DOUBLE), 6) AS discard_rate
FROM (SELECT COUNT(*) AS n FROM kept GROUP BY {sql.KEYS})""", sql.TARGET))
def discard_rate(spark, folder):
    return sessions.discard_rate(kept_flows(spark, folder)).withColumn(
        "discard_rate", F.round("discard_rate", 6))


@query("inter_arrival", sql.script(f"""
SELECT uid, ts_us - LAG(ts_us) OVER (PARTITION BY {sql.KEYS} ORDER BY ts_us, uid) AS iat_us,
  ROW_NUMBER() OVER (PARTITION BY {sql.KEYS} ORDER BY ts_us, uid) - 1 AS flow_no FROM kept
""", sql.TARGET))
def inter_arrival(spark, folder):
    return sessions.intervals(kept_flows(spark, folder)).select("uid", "iat_us", "flow_no")


@query("sessionize", sql.over_sessions(
    "SELECT uid, session_id, flow_no, iat_us, target FROM iv"))
def sessionize(spark, folder):
    return sessions.sessionize(kept_flows(spark, folder)).select(
        "uid", "session_id", "flow_no", "iat_us", "target")


@query("session_meta", sql.over_sessions("""
SELECT session_id, target, first_us, last_us, last_uid, detailed_label, capture_id FROM mt""",
                                         sql.META))
def session_meta(spark, folder):
    table = session_features(kept_flows(spark, folder), blocks=("meta",))
    return table.select(sessions.session_id().alias("session_id"), "target", "first_us", "last_us",
                        "last_uid", "detailed_label", "capture_id")
