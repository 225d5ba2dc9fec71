"""SQL texts the registered queries are checked against (DuckDB dialect)."""

from __future__ import annotations

from pulsetrace.config import (
    COMMON_SERVICE_PORTS, EPHEMERAL_PORT_FLOOR, EXCLUDED_LABELS, NEGATIVE_LABELS, POSITIVE_LABELS,
)
from pulsetrace.sources.views import flows_cte, flows_long_cte


def listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


POSITIVE, NEGATIVE, EXCLUDED = map(listed, (POSITIVE_LABELS, NEGATIVE_LABELS, EXCLUDED_LABELS))
KEPT = listed((*POSITIVE_LABELS, *NEGATIVE_LABELS))
KNOWN = listed((*POSITIVE_LABELS, *NEGATIVE_LABELS, *EXCLUDED_LABELS))
KEYS = "orig_h, resp_h, resp_p"
SID = "concat(orig_h, '|', resp_h, '|', CAST(resp_p AS VARCHAR))"


def hash60(key: str, seed: int = 42, salt: str = "") -> str:
    return (f"CAST(('0x' || substr(md5(concat('{seed}|{salt}', CAST({key} AS VARCHAR))), 1, 15)) "
            "AS BIGINT)")


def hash_uniform(key: str, seed: int = 42, salt: str = "") -> str:
    return (f"(CAST(('0x' || substr(md5(concat('{seed}|{salt}', CAST({key} AS VARCHAR))), 1, 8)) "
            "AS BIGINT) / CAST(4294967296 AS DOUBLE))")


FLOWS = flows_cte("duckdb").strip()
LONG = flows_long_cte("duckdb").strip()

TARGET = f"""
kept AS (SELECT *, CASE WHEN detailed_label IN {POSITIVE} THEN 1 ELSE 0 END AS target
         FROM flows WHERE detailed_label IN {KEPT})"""

# Flows of sessions with at least four flows, with the interval to the previous flow.
SESSIONS = f"""
sized AS (SELECT *, COUNT(*) OVER (PARTITION BY {KEYS}) AS n FROM kept),
iv AS (SELECT *, {SID} AS session_id,
         ts_us - LAG(ts_us) OVER (PARTITION BY {KEYS} ORDER BY ts_us, uid) AS iat_us,
         ROW_NUMBER() OVER (PARTITION BY {KEYS} ORDER BY ts_us, uid) - 1 AS flow_no
       FROM sized WHERE n >= 4)"""


def timing(source: str = "iv", extra: str = "") -> str:
    """Timing block (without the spectral scores) from a table of intervals."""
    return f"""
med AS (SELECT *, MEDIAN(iat_us) OVER (PARTITION BY {extra}{KEYS}) AS mid FROM {source}),
tm AS (
  SELECT {extra}{KEYS}, {SID} AS session_id, COUNT(*) AS n_flows,
    AVG(iat_us) / 1e6 AS iat_mean, STDDEV_POP(iat_us) / 1e6 AS iat_std,
    MEDIAN(iat_us) / 1e6 AS iat_median, MIN(iat_us) / 1e6 AS iat_min, MAX(iat_us) / 1e6 AS iat_max,
    MEDIAN(ABS(iat_us - mid)) / 1e6 AS iat_mad,
    MIN(ts_us) AS first_us, MAX(ts_us) AS last_us,
    (MAX(ts_us) - MIN(ts_us)) / 1e6 AS span, SUM(COALESCE(duration, 0)) AS duration_sum
  FROM med GROUP BY {extra}{KEYS}),
tf AS (
  SELECT *, CASE WHEN iat_mean > 0 THEN iat_std / iat_mean ELSE CAST(0 AS DOUBLE) END AS iat_cv,
    CAST(n_flows AS DOUBLE) AS session_flow_count, span / 3600 AS session_span_hours,
    CASE WHEN span > 0 THEN duration_sum / span ELSE CAST(0 AS DOUBLE) END AS duty_cycle,
    CAST(hour(make_timestamp(first_us)) AS DOUBLE) AS hour_of_day,
    CAST(isodow(make_timestamp(first_us)) >= 6 AS DOUBLE) AS is_weekend
  FROM tm)"""


VOLUME = f"""
vs AS (
  SELECT {KEYS}, {SID} AS session_id, COUNT(*) AS n_flows,
    CAST(SUM(COALESCE(orig_ip_bytes, 0)) AS DOUBLE) AS sent,
    CAST(SUM(COALESCE(resp_ip_bytes, 0)) AS DOUBLE) AS received,
    CAST(SUM(COALESCE(orig_pkts, 0)) AS DOUBLE) AS pout,
    CAST(SUM(COALESCE(resp_pkts, 0)) AS DOUBLE) AS pin,
    SUM(COALESCE(duration, 0)) AS dsum,
    AVG(CASE WHEN COALESCE(resp_bytes, 0) = 0 THEN 1 ELSE 0 END) AS silent,
    VAR_POP(COALESCE(orig_ip_bytes, 0) + COALESCE(resp_ip_bytes, 0)) AS bvar
  FROM iv GROUP BY {KEYS}),
vf AS (
  SELECT *, sent / (received + 1) AS orig_resp_byte_ratio, LN(1 + sent + received) AS total_bytes,
    LN(1 + sent) AS orig_bytes, LN(1 + received) AS resp_bytes, pout AS orig_pkts, pin AS resp_pkts,
    pout / (pin + 1) AS pkt_ratio, sent / (pout + 1) AS mean_pkt_size_orig,
    received / (pin + 1) AS mean_pkt_size_resp,
    (sent + received) / (dsum + 1e-6) AS bytes_per_second, silent AS resp_bytes_is_zero,
    bvar AS session_byte_variance, dsum / n_flows AS duration
  FROM vs)"""


def mode(column: str) -> str:
    return f"""
{column}_m AS (
  SELECT {KEYS}, {column} AS {column}_mode FROM (
    SELECT {KEYS}, {column}, ROW_NUMBER() OVER (PARTITION BY {KEYS}
      ORDER BY COUNT(*) DESC, {column}) AS r
    FROM iv WHERE {column} IS NOT NULL GROUP BY {KEYS}, {column}) WHERE r = 1)"""


STATE = ",".join(mode(c) for c in ("conn_state", "proto", "service")) + f""",
cs AS (
  SELECT {KEYS}, AVG(LENGTH(COALESCE(history, ''))) AS history_len,
    AVG(CASE WHEN contains(COALESCE(history, ''), 'S') THEN 1 ELSE 0 END) AS "history_has_S",
    AVG(CASE WHEN contains(COALESCE(history, ''), 'D') THEN 1 ELSE 0 END) AS "history_has_D",
    CAST(resp_p AS DOUBLE) AS resp_port,
    AVG(CASE WHEN COALESCE(orig_p >= {EPHEMERAL_PORT_FLOOR}, FALSE) THEN 1 ELSE 0 END)
      AS is_ephemeral_orig_port,
    CASE WHEN resp_p IN {listed(COMMON_SERVICE_PORTS)} THEN CAST(1 AS DOUBLE)
         ELSE CAST(0 AS DOUBLE) END AS is_common_service_port
  FROM iv GROUP BY {KEYS}),
cf AS (
  SELECT cs.*, {SID.replace('orig_h', 'cs.orig_h').replace('resp_h', 'cs.resp_h')
               .replace('resp_p', 'cs.resp_p')} AS session_id,
    COALESCE(conn_state_mode, 'unknown') AS conn_state_mode,
    COALESCE(proto_mode, 'unknown') AS proto_mode,
    COALESCE(service_mode, 'unknown') AS service_mode
  FROM cs LEFT JOIN conn_state_m USING ({KEYS}) LEFT JOIN proto_m USING ({KEYS})
  LEFT JOIN service_m USING ({KEYS}))"""

CONTEXT = f"""
de AS (SELECT resp_h, CAST(COUNT(DISTINCT orig_h) AS DOUBLE) AS dest_fanin,
         CAST(COUNT(*) AS DOUBLE) AS dest_flow_count FROM iv GROUP BY resp_h),
so AS (SELECT orig_h, CAST(COUNT(DISTINCT resp_h) AS DOUBLE) AS src_fanout FROM iv GROUP BY orig_h),
xf AS (SELECT {KEYS}, {SID} AS session_id, dest_fanin, src_fanout, dest_flow_count
       FROM (SELECT DISTINCT {KEYS} FROM iv) JOIN de USING (resp_h) JOIN so USING (orig_h))"""

META = f"""
mt AS (
  SELECT {KEYS}, {SID} AS session_id, MAX(target) AS target, MIN(ts_us) AS first_us,
    MAX(ts_us) AS last_us, ARG_MAX(uid, (ts_us, uid)) AS last_uid,
    ARG_MIN(detailed_label, (ts_us, uid)) AS detailed_label,
    ARG_MIN(capture_id, (ts_us, uid)) AS capture_id
  FROM iv GROUP BY {KEYS})"""

# The spectral scores in closed form: autocorrelation by a self-join on the lag, power by sums of
# sines and cosines.
SPECTRAL = f"""
pts AS (SELECT session_id, flow_no - 1 AS i, iat_us / 1e6 AS x,
          AVG(iat_us / 1e6) OVER (PARTITION BY session_id) AS m,
          COUNT(*) OVER (PARTITION BY session_id) AS len
        FROM iv WHERE iat_us IS NOT NULL),
flat AS (SELECT session_id, MIN(len) AS len, BOOL_AND(ABS(x - m) <= 1e-8 + 1e-5 * ABS(m)) AS same
         FROM pts GROUP BY session_id),
acf AS (SELECT session_id, MAX(ABS(s)) FILTER (WHERE lag > 0) / MAX(s) FILTER (WHERE lag = 0) AS peak
        FROM (SELECT a.session_id, b.i - a.i AS lag, SUM((a.x - a.m) * (b.x - b.m)) AS s
              FROM pts a JOIN pts b ON a.session_id = b.session_id AND b.i >= a.i GROUP BY ALL)
        GROUP BY session_id),
pow AS (SELECT session_id, MAX(p) FILTER (WHERE k > 0) / SUM(p) AS share
        FROM (SELECT session_id, k, POW(SUM((x - m) * COS(2 * PI() * k * i / len)), 2)
                   + POW(SUM((x - m) * SIN(2 * PI() * k * i / len)), 2) AS p
              FROM (SELECT *, UNNEST(generate_series(0, CAST(FLOOR(len / 2) AS BIGINT))) AS k FROM pts)
              GROUP BY session_id, k)
        GROUP BY session_id),
sf AS (SELECT session_id,
         CASE WHEN len < 3 THEN 0 WHEN same THEN 1 ELSE peak END AS periodicity_score,
         CASE WHEN len < 3 THEN 0 WHEN same THEN 1 ELSE share END AS fft_dominant_power
       FROM flat JOIN acf USING (session_id) JOIN pow USING (session_id))"""

# Scores that SQL can state: regular timing for the supervised branch, silent responses for the
# anomaly branch.
SCORED = f"""
sc0 AS (
  SELECT {KEYS}, {SID} AS session_id, MAX(target) AS target, MIN(ts_us) AS first_us,
    MAX(ts_us) AS last_us, ARG_MAX(uid, (ts_us, uid)) AS last_uid,
    ARG_MIN(detailed_label, (ts_us, uid)) AS detailed_label,
    ARG_MIN(capture_id, (ts_us, uid)) AS capture_id, COUNT(*) AS n_flows,
    STDDEV_POP(iat_us) AS sd, AVG(iat_us) AS av,
    AVG(CASE WHEN COALESCE(resp_bytes, 0) = 0 THEN 1 ELSE 0 END) AS silent
  FROM iv GROUP BY {KEYS}),
sc1 AS (SELECT *, CASE WHEN av > 0 THEN sd / av ELSE CAST(0 AS DOUBLE) END AS iat_cv FROM sc0),
sc2 AS (SELECT *, ROUND(1 / (1 + iat_cv), 6) AS supervised_score,
          ROUND(silent, 6) AS anomaly_score FROM sc1),
scored AS (SELECT *, ROUND((CAST(0.6 AS DOUBLE) * supervised_score
                     + CAST(0.4 AS DOUBLE) * anomaly_score) / CAST(1.0 AS DOUBLE), 6) AS risk_score
           FROM sc2)"""

TAU = """
tau AS (SELECT QUANTILE_CONT(risk_score, 0.95) AS tau_high,
          LEAST(QUANTILE_CONT(risk_score, 0.9), QUANTILE_CONT(risk_score, 0.95)) AS tau_low
        FROM scored)"""


def script(body: str, *parts: str) -> str:
    """A statement over the flow view with the named parts in front."""
    return "WITH " + ",\n".join([FLOWS, *(p.strip() for p in parts)]) + "\n" + body.strip()


def over_sessions(body: str, *parts: str) -> str:
    return script(body, TARGET, SESSIONS, *parts)


def over_scores(body: str, *parts: str) -> str:
    return script(body, TARGET, SESSIONS, SCORED, *parts)


def rounded(columns: dict[str, int | None]) -> str:
    """Select list rounding each column to its number of places."""
    return ", ".join(c if p is None else f"ROUND({c}, {p}) AS {c}" for c, p in columns.items())
