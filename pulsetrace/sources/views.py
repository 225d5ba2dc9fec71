"""Connection-flow views over the driver tables, as one SQL text for two engines.

The driver tables hold no connection logs, so flows are derived from ``events`` (and long sessions
from ``lineitem``). The text has a few tokens that differ between Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIALECTS = {
    "spark": {
        "STR": "STRING",
        "EPOCH_US": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})",
        "JSON_K": "get_json_object(props, '$.k')",
        "HASH": "CAST(conv(substr(md5(concat('42|', CAST(event_id AS STRING))), 1, 8), 16, 10) "
                "AS BIGINT) / CAST(4294967296 AS DOUBLE)",
    },
    "duckdb": {
        "STR": "VARCHAR",
        "EPOCH_US": "epoch_us({})",
        "JSON_K": "json_extract_string(props, '$.k')",
        "HASH": "CAST(('0x' || substr(md5(concat('42|', CAST(event_id AS VARCHAR))), 1, 8)) "
                "AS BIGINT) / CAST(4294967296 AS DOUBLE)",
    },
}

# Flows of a positive session are re-timed to hourly beacons with up to 100 s of jitter. Only those
# few flows need an ordering, so the window runs over them alone.
FLOWS = """
e AS (
  SELECT event_id, user_id, event_type, value, {HASH} AS u, CAST({JSON_K} AS INT) AS k,
    CAST(FLOOR({EVENT_US} / 1000000) AS BIGINT) * 1000000 AS raw_us
  FROM events),
f AS (
  SELECT raw_us, u, event_id,
    concat('C', CAST(event_id AS {STR})) AS uid,
    concat('10.0.', CAST(CAST(FLOOR(user_id / 256) AS INT) AS {STR}), '.',
           CAST(user_id % 256 AS {STR})) AS orig_h,
    CAST(32768 + (event_id * 7919) % 32768 AS INT) AS orig_p,
    concat('203.0.113.', CAST(k % 3 + CASE event_type WHEN 'error' THEN 10 WHEN 'click' THEN 20
           WHEN 'view' THEN 30 WHEN 'signup' THEN 40 ELSE 50 END AS {STR})) AS resp_h,
    CASE event_type WHEN 'error' THEN 23 WHEN 'click' THEN 443 WHEN 'view' THEN 80
                    WHEN 'signup' THEN 8443 ELSE 6667 END AS resp_p,
    CASE WHEN k % 5 = 0 THEN 'udp' ELSE 'tcp' END AS proto,
    CASE event_type WHEN 'click' THEN 'ssl' WHEN 'view' THEN 'http' ELSE NULL END AS service,
    CASE WHEN k % 4 = 0 THEN NULL ELSE value / 100 END AS duration,
    CAST(FLOOR(value) AS BIGINT) AS orig_bytes,
    CASE WHEN k % 7 = 0 THEN NULL WHEN event_type = 'error' THEN 0
         ELSE CAST(FLOOR(value) AS BIGINT) * 3 END AS resp_bytes,
    CASE k % 3 WHEN 0 THEN 'SF' WHEN 1 THEN 'S0' ELSE 'REJ' END AS conn_state,
    CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'S' WHEN 2 THEN 'ShADadFf' ELSE 'Dd' END AS history,
    CAST(1 + k % 6 AS BIGINT) AS orig_pkts, CAST(k % 5 AS BIGINT) AS resp_pkts,
    CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN
           CASE user_id % 4 WHEN 0 THEN 'C&C-HeartBeat' WHEN 1 THEN 'C&C'
                            WHEN 2 THEN 'C&C-Torii' ELSE 'C&C-FileDownload' END
         WHEN event_type = 'purchase' AND user_id % 7 = 0 THEN 'DDoS'
         WHEN event_type = 'signup' AND user_id % 11 = 0 THEN 'NovelLabel'
         ELSE 'Benign' END AS detailed_label,
    user_id, k
  FROM e),
beacons AS (
  SELECT *, MIN(raw_us) OVER (PARTITION BY orig_h, resp_h, resp_p) AS first_us,
         ROW_NUMBER() OVER (PARTITION BY orig_h, resp_h, resp_p ORDER BY raw_us, uid) AS rn
  FROM f WHERE detailed_label LIKE 'C&C%'),
timed AS (
  SELECT *, raw_us AS ts_us FROM f WHERE NOT (detailed_label LIKE 'C&C%')
  UNION ALL
  SELECT * EXCEPT_COLUMNS,
    first_us + (rn - 1) * 3600000000 + CAST(FLOOR(u * 100) AS BIGINT) * 1000000 AS ts_us
  FROM beacons),
flows AS (
  SELECT ts_us, CAST(ts_us AS DOUBLE) / 1000000 AS ts, uid, orig_h, orig_p, resp_h, resp_p, proto,
    service, duration, orig_bytes, resp_bytes, conn_state, history, orig_pkts,
    orig_bytes + 40 * orig_pkts AS orig_ip_bytes, resp_pkts,
    COALESCE(resp_bytes, 0) + 40 * resp_pkts AS resp_ip_bytes, detailed_label,
    concat('capture-', CAST(event_id % 3 AS {STR})) AS capture_id, user_id, k
  FROM timed)
"""

FLOWS_LONG = """
flows_long AS (
  SELECT {SHIP_US} AS ts_us, CAST({SHIP_US} AS DOUBLE) / 1000000 AS ts,
    concat('L', CAST(l_orderkey AS {STR}), '-', CAST(l_linenumber AS {STR})) AS uid,
    concat('s', CAST(l_suppkey AS {STR})) AS orig_h,
    concat('d', l_returnflag, l_linestatus) AS resp_h, 443 AS resp_p,
    CAST(l_quantity AS BIGINT) AS orig_ip_bytes,
    CAST(FLOOR(l_extendedprice) AS BIGINT) AS resp_ip_bytes,
    l_discount AS duration, 'Benign' AS detailed_label,
    CAST(32768 + l_partkey % 32768 AS INT) AS orig_p, 'tcp' AS proto,
    CASE WHEN l_linenumber = 1 THEN 'ssl' ELSE NULL END AS service,
    CASE l_linenumber % 3 WHEN 0 THEN 'SF' WHEN 1 THEN 'S0' ELSE 'REJ' END AS conn_state,
    CASE WHEN l_linenumber % 2 = 0 THEN 'ShADadFf' ELSE 'S' END AS history,
    CAST(l_linenumber AS BIGINT) AS orig_pkts, CAST(l_linenumber % 4 AS BIGINT) AS resp_pkts,
    CAST(FLOOR(l_extendedprice) AS BIGINT) * (l_linenumber % 2) AS resp_bytes,
    CAST(l_quantity AS BIGINT) AS orig_bytes, 'long' AS capture_id
  FROM lineitem)
"""


def _fill(text: str, dialect: str) -> str:
    tokens = DIALECTS[dialect]
    words = {
        "{STR}": tokens["STR"], "{JSON_K}": tokens["JSON_K"], "{HASH}": tokens["HASH"],
        "{EVENT_US}": tokens["EPOCH_US"].format("ts"),
        "{SHIP_US}": tokens["EPOCH_US"].format("l_shipdate"),
        "* EXCEPT_COLUMNS": "* EXCEPT (first_us, rn)" if dialect == "spark"
        else "* EXCLUDE (first_us, rn)",
    }
    for token, word in words.items():
        text = text.replace(token, word)
    return text


def flows_cte(dialect: str = "duckdb") -> str:
    """Common table expressions ending in ``flows``."""
    return _fill(FLOWS, dialect)


def flows_long_cte(dialect: str = "duckdb") -> str:
    """Common table expression ``flows_long``."""
    return _fill(FLOWS_LONG, dialect)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """Connection flows derived from ``events``."""
    text = flows_cte("spark").replace("FROM events)", "FROM {events})")
    return spark.sql(f"WITH {text} SELECT * FROM flows", events=table(spark, folder, "events"))


def flows_long(spark: SparkSession, folder: str) -> DataFrame:
    """Flows in long sessions with many equal timestamps, derived from ``lineitem``."""
    text = flows_long_cte("spark").replace("FROM lineitem)", "FROM {lineitem})")
    return spark.sql(f"WITH {text} SELECT * FROM flows_long",
                     lineitem=table(spark, folder, "lineitem"))
