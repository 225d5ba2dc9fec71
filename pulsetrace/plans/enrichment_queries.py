"""Queries over joined facts, drift, feedback and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsetrace.functions.hashing import hash60
from pulsetrace.functions.text import entropy
from pulsetrace.operators import drift, enrich, hosts
from pulsetrace.operators.order_stats import exact_quantiles
from pulsetrace.operators.sessions import session_id
from pulsetrace.plans import sql
from pulsetrace.plans.inputs import kept_flows, rounded, scored_sessions
from pulsetrace.plans.registry import query
from pulsetrace.session import materialise, scratch_path
from pulsetrace.sources import views
from pulsetrace.streaming import live

# Handshake records of the TLS flows; the same text serves both engines.
TLS = """
SELECT uid, CASE k % 3 WHEN 0 THEN 'TLSv12' WHEN 1 THEN 'TLSv13' ELSE 'TLSv10' END AS tls_version,
  CASE k % 4 WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'a' WHEN 2 THEN 'a,b,c,d,e' ELSE NULL END AS ciphers,
  CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 'x,y,z,w' END AS extensions,
  ts_us - k * 86400000000 AS not_before_us, ts_us + k * 7 * 86400000000 AS not_after_us,
  concat('O=Org,CN=host', k, '.example') AS subject,
  CASE WHEN k % 6 = 0 THEN concat('O=Org,CN=host', k, '.example') ELSE 'CN=Example CA' END AS issuer,
  md5(concat('client', k % 10)) AS ja3
FROM {flows} WHERE service = 'ssl'"""
ALLOWED = "SELECT DISTINCT md5(concat('client', k % 10)) AS ja3 FROM {flows} WHERE k % 10 < 3"
DNS = """
SELECT ts_us, orig_h, concat('d', k % 20, '.example') AS query,
  concat('203.0.113.', 20 + k % 3) AS answer
FROM {flows} WHERE service = 'http'"""
DOMAINS = """
SELECT concat('d', n_nationkey, '.example') AS domain,
  1577836800000000 + n_nationkey * 30 * 86400000000 AS registered_us, n_regionkey AS reputation
FROM {nation}"""


def entropy_sql(rows: str, key: str, text: str) -> str:
    """Table ``en`` of key and entropy, by exploding the characters."""
    return f"""
en AS (SELECT {key}, 0 - SUM(p * LOG2(p)) AS entropy FROM (
         SELECT {key}, ch, COUNT(*) / CAST(MAX(len) AS DOUBLE) AS p FROM (
           SELECT {key}, LENGTH({text}) AS len, UNNEST(string_split({text}, '')) AS ch FROM {rows})
         WHERE ch <> '' GROUP BY {key}, ch)
       GROUP BY {key})"""


def _tls(spark, flows):
    return spark.sql(TLS, flows=flows)


TLS_SQL = f"tls AS ({TLS.format(flows='flows')})"


@query("tls_features", sql.script("""
SELECT f.uid, CASE WHEN t.uid IS NULL THEN NULL ELSE t.ja3 IN (SELECT ja3 FROM allowed) END
    AS ja3_known_client,
  CASE WHEN t.uid IS NULL THEN NULL WHEN COALESCE(ciphers, '') = '' THEN 0
       ELSE CAST(LEN(string_split(ciphers, ',')) AS INT) END AS cipher_suite_count,
  tls_version,
  CASE WHEN t.uid IS NULL THEN NULL WHEN COALESCE(extensions, '') = '' THEN 0
       ELSE CAST(LEN(string_split(extensions, ',')) AS INT) END AS extension_count,
  CAST(FLOOR((not_after_us - not_before_us) / CAST(86400000000 AS DOUBLE)) AS INT)
    AS cert_validity_days,
  subject = issuer AS cert_is_self_signed, ROUND(entropy, 6) AS cert_subject_cn_entropy
FROM flows f LEFT JOIN tls t ON f.uid = t.uid LEFT JOIN en ON en.uid = f.uid""", TLS_SQL,
    f"allowed AS ({ALLOWED.format(flows='flows')})",
    "cn AS (SELECT uid, regexp_extract(subject, 'CN=([^,]*)', 1) AS name FROM tls)",
    entropy_sql("cn", "uid", "name")))
def tls_features(spark, folder):
    flows = views.flows(spark, folder)
    table = enrich.tls_features(flows, _tls(spark, flows), spark.sql(ALLOWED, flows=flows))
    return table.withColumn("cert_subject_cn_entropy", F.round("cert_subject_cn_entropy", 6))


@query("string_entropy", sql.script("""
SELECT n.history, ROUND(COALESCE(entropy, 0), 6) AS entropy FROM names n LEFT JOIN en USING (history)
""", "names AS (SELECT DISTINCT COALESCE(history, '') AS history FROM flows)",
    entropy_sql("names", "history", "history")))
def string_entropy(spark, folder):
    names = views.flows(spark, folder).select(F.coalesce("history", F.lit("")).alias("history"))
    return names.distinct().withColumn("entropy", F.round(entropy(F.col("history")), 6))


DNS_SQL = f"dns AS ({DNS.format(flows='flows')})"
ASOF_SQL = """
matched AS (
  SELECT f.uid, f.ts_us, ARG_MAX(d.query, (d.ts_us, d.query)) AS query, MAX(d.ts_us) AS dns_us
  FROM flows f LEFT JOIN dns d ON d.orig_h = f.orig_h AND d.answer = f.resp_h AND d.ts_us <= f.ts_us
  WHERE f.service = 'ssl' GROUP BY f.uid, f.ts_us),
near AS (SELECT uid, ts_us, CASE WHEN ts_us - dns_us <= 864000000000 THEN query END AS query,
           CASE WHEN ts_us - dns_us <= 864000000000 THEN ts_us - dns_us END AS answer_age_us
         FROM matched)"""


def _resolved(spark, folder):
    flows = views.flows(spark, folder)
    return enrich.latest_answer(flows.where("service = 'ssl'"), spark.sql(DNS, flows=flows),
                                max_gap_us=10 * enrich.DAY_US)


@query("dns_asof", sql.script("SELECT uid, query, answer_age_us FROM near", DNS_SQL, ASOF_SQL))
def dns_asof(spark, folder):
    """Last answer within ten days before each TLS flow."""
    return _resolved(spark, folder).select("uid", "query", "answer_age_us")


@query("reputation_join", sql.script("""
SELECT uid, query, reputation,
  CAST(FLOOR((ts_us - registered_us) / CAST(86400000000 AS DOUBLE)) AS INT) AS domain_age_days
FROM near LEFT JOIN domains ON domain = query""", DNS_SQL, ASOF_SQL,
    f"domains AS ({DOMAINS.format(nation='nation')})"))
def reputation_join(spark, folder):
    domains = spark.sql(DOMAINS, nation=views.table(spark, folder, "nation"))
    return enrich.domain_facts(_resolved(spark, folder), domains).select(
        "uid", "query", "reputation", "domain_age_days")


LEXICAL_SQL = """
names AS (SELECT DISTINCT concat(detailed_label, uid, '.example') AS query FROM flows),
parts AS (SELECT query, lower(regexp_replace(query, '[.][^.]*$', '')) AS name FROM names)"""


@query("domain_lexical", sql.script("""
SELECT query, name_length, ROUND(ds, 6) AS digit_share, ROUND(vs, 6) AS vowel_share,
  ROUND(entropy, 6) AS char_entropy,
  ROUND(1 / (1 + EXP(-(entropy - 3 + 4 * ds - 2 * vs))), 6) AS dga_score
FROM (SELECT query, CAST(LENGTH(name) AS INT) AS name_length, entropy,
        LENGTH(regexp_replace(name, '[^0-9]', '', 'g')) / CAST(LENGTH(name) AS DOUBLE) AS ds,
        LENGTH(regexp_replace(name, '[^aeiou]', '', 'g')) / CAST(LENGTH(name) AS DOUBLE) AS vs
      FROM parts JOIN en USING (query))""", LEXICAL_SQL, entropy_sql("parts", "query", "name")))
def domain_lexical(spark, folder):
    names = views.flows(spark, folder).select(
        F.concat("detailed_label", "uid", F.lit(".example")).alias("query")).distinct()
    return rounded(enrich.domain_lexical(names), {
        "query": None, "name_length": None, "digit_share": 6, "vowel_share": 6, "char_entropy": 6,
        "dga_score": 6})


DRIFTING = ("iat_cv", "n_flows", "resp_bytes_is_zero")
DRIFT_SQL = """
cut AS (SELECT QUANTILE_CONT(first_us, 0.5) AS mid_us FROM scored),
dl AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({'silent' if c == 'resp_bytes_is_zero' else c} AS DOUBLE) AS v, "
    "first_us > mid_us AS late FROM scored, cut" for c in DRIFTING) + """),
bd AS (SELECT feature, QUANTILE_CONT(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS b
       FROM dl WHERE NOT late GROUP BY feature),
bc AS (SELECT feature, LEN(list_filter(b, lambda x: x < v)) AS bin,
         COUNT(*) FILTER (WHERE NOT late) AS n0, COUNT(*) FILTER (WHERE late) AS n1
       FROM dl JOIN bd USING (feature) GROUP BY 1, 2),
sh AS (SELECT feature, GREATEST(n0 / CAST(SUM(n0) OVER f AS DOUBLE), 1e-6) AS q,
         GREATEST(n1 / CAST(SUM(n1) OVER f AS DOUBLE), 1e-6) AS p
       FROM bc WINDOW f AS (PARTITION BY feature))"""


def _drift(spark, folder):
    scored = scored_sessions(spark, folder, stored=True)
    middle = exact_quantiles(scored, "first_us", [0.5])[None][0]
    late = F.col("first_us") > F.lit(middle)
    return drift.drift(scored.where(~late), scored.where(late), DRIFTING)


@query("psi_drift", sql.over_scores("""
SELECT feature, ROUND(SUM((p - q) * LN(p / q)), 5) AS psi FROM sh GROUP BY feature""", DRIFT_SQL))
def psi_drift(spark, folder):
    return rounded(_drift(spark, folder), {"feature": None, "psi": 5})


@query("kl_drift", sql.over_scores("""
SELECT feature, ROUND(SUM(p * LN(p / q)), 5) AS kl FROM sh GROUP BY feature""", DRIFT_SQL))
def kl_drift(spark, folder):
    return rounded(_drift(spark, folder), {"feature": None, "kl": 5})


@query("merge_feedback", sql.over_scores(f"""
SELECT session_id, CASE WHEN h % 10 = 0 THEN CAST((h // 10) % 2 AS INT) ELSE target END AS target,
  h % 10 = 0 AS overridden
FROM (SELECT *, {sql.hash60('session_id', salt='feedback')} AS h FROM scored)"""))
def merge_feedback(spark, folder):
    """Two overrides for every tenth session; the later one counts."""
    scored = scored_sessions(spark, folder, stored=True)
    h = hash60(42, "session_id", "feedback")
    label = F.expr("pmod(_h div 10, 2)")
    overrides = scored.withColumn("_h", h).where("_h % 10 = 0").select("session_id", F.inline(F.array(
        F.struct((1 - label).cast("int").alias("analyst_label"), F.lit(1).alias("at")),
        F.struct(label.cast("int").alias("analyst_label"), F.lit(2).alias("at")))))
    return hosts.merge_feedback(scored, overrides).select("session_id", "target", "overridden")


# ------------------------------------------------------------------ streams

STREAMED = ("orig_h", "resp_h", "resp_p", "ts_us", "orig_ip_bytes", "resp_ip_bytes")


@query("windowed_sessions", sql.script(f"""
SELECT {sql.KEYS}, window_us, COUNT(*) AS n_flows, CAST(SUM(orig_ip_bytes) AS BIGINT) AS sent,
  CAST(SUM(resp_ip_bytes) AS BIGINT) AS received, MIN(ts_us) AS first_us, MAX(ts_us) AS last_us,
  ROUND((MAX(ts_us) - MIN(ts_us)) / CAST(NULLIF(COUNT(*) - 1, 0) AS DOUBLE) / 1e6, 2) AS mean_interval
FROM (SELECT *, CAST(FLOOR(ts_us / 10800000000) AS BIGINT) * 10800000000 - 10800000000 * x AS window_us
      FROM kept, (VALUES (0), (1)) AS v(x))
WHERE window_us + 21600000000 <= (SELECT MAX(ts_us) FROM kept) - 3600000000
GROUP BY {sql.KEYS}, window_us""", sql.TARGET))
def windowed_sessions(spark, folder):
    """Six-hour windows every three hours over a stream; only closed windows are emitted."""
    source, out = scratch_path(spark, "arrivals"), scratch_path(spark, "windows")
    kept_flows(spark, folder).select(*STREAMED).write.parquet(source)
    schema = spark.read.parquet(source).schema
    live.write_stream(live.windowed_sessions(live.flow_stream(spark, source, schema)), out,
                      scratch_path(spark, "offsets"))
    done = spark.read.parquet(out)
    return done.withColumn("mean_interval", F.round("mean_interval", 2))


@query("partial_sessions", sql.script(f"""
SELECT {sql.SID} AS session_id, COUNT(*) FILTER (NOT late) AS n_flows,
  ROUND(COALESCE(AVG(iat_us), 0) / 1e6, 4) AS iat_mean,
  ROUND(COALESCE(STDDEV_POP(iat_us), 0) / 1e6, 4) AS iat_std,
  COUNT(*) FILTER (late) AS late, COUNT(*) FILTER (NOT late) >= 4 AS assessable
FROM (SELECT *, CASE WHEN NOT late THEN ts_us - LAG(ts_us) OVER (
        PARTITION BY {sql.KEYS}, late ORDER BY ts_us, uid) END AS iat_us
      FROM (SELECT *, COALESCE(ts_us < mark, FALSE) AS late FROM arrivals JOIN marks USING (part)))
GROUP BY {sql.KEYS}""", sql.TARGET, f"""
arrivals AS (SELECT *, CAST(FLOOR((ts_us + ({sql.hash60('uid', salt='order')} % 12) * 900000000)
                             / 432000000000) AS BIGINT) AS part FROM kept),
marks AS (SELECT part, MAX(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            - 3600000000 AS mark
          FROM (SELECT part, MAX(ts_us // 1000) * 1000 AS top FROM arrivals GROUP BY part))"""))
def partial_sessions(spark, folder):
    """Running statistics over five-day micro-batches, as after the last one.

    A flow arrives up to 165 minutes after it happened, so batches overlap and some flows are later
    than the hour the watermark waits.
    """
    flows = kept_flows(spark, folder)
    arrival = F.col("ts_us") + (hash60(42, "uid", "order") % 12) * F.lit(900_000_000)
    stored = materialise(flows.select(*STREAMED, F.floor(arrival / F.lit(432_000_000_000)).alias("part")))
    source, out, offsets = (scratch_path(spark, n) for n in ("arrivals", "sessions", "offsets"))
    # One batch per five days: the stream is resumed after each one has arrived.
    for row in stored.select("part").distinct().orderBy("part").collect():
        stored.where(F.col("part") == row.part).drop("part").write.mode("append").parquet(source)
        updates = live.partial_sessions(live.flow_stream(spark, source, stored.drop("part").schema))
        live.keep_latest(updates, out, offsets)
    return rounded(live.current_sessions(spark, out).withColumn("session_id", session_id()), {
        "session_id": None, "n_flows": None, "iat_mean": 4, "iat_std": 4, "late": None,
        "assessable": None})


@query("late_rows", sql.script(f"""
SELECT slice, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE ts_us < mark) AS n_late
FROM arrivals JOIN (
  SELECT slice, MAX(top) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    - 21600000000 AS mark
  FROM (SELECT slice, MAX(ts_us) AS top FROM arrivals GROUP BY slice)) USING (slice)
GROUP BY slice""", f"""
arrivals AS (SELECT *, CAST(FLOOR((ts_us + ({sql.hash60('uid', salt='late')} % 10) * 14400000000)
                             / 86400000000) AS BIGINT) AS slice FROM flows)"""))
def late_rows(spark, folder):
    """Flows arrive up to a day and a half after they happened, in daily slices."""
    shifted = F.col("ts_us") + (hash60(42, "uid", "late") % 10) * F.lit(14_400_000_000)
    return live.late_rows(views.flows(spark, folder), F.floor(shifted / F.lit(86_400_000_000)),
                          21_600_000_000)
