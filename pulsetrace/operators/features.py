"""The 39 behavioural features of a session, from one grouping of the flows.

Everything additive is a partial aggregate. Timestamps of a session travel as one sorted array, from
which intervals, their median, deviation, autocorrelation and spectrum follow without a window or a
second shuffle. Hot sessions take the distributed path in ``long_series``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetrace.config import (
    COMMON_SERVICE_PORTS, CONTEXT_FEATURES, DEFAULTS, EPHEMERAL_PORT_FLOOR, NUMERIC_FEATURES,
    STATE_CATEGORIES, STATE_FEATURES, TIERS, TIMING_FEATURES, VOLUME_FEATURES, Settings,
)
from pulsetrace.functions.series import series_scores
from pulsetrace.operators.joins import counted_lookup, lookup_join
from pulsetrace.operators.long_series import hot_timing
from pulsetrace.operators.sessions import find_hot_sessions, session_id, session_sizes
from pulsetrace.session import materialise

BLOCKS = ("timing", "periodicity", "volume", "state", "meta")


# Expressions are SQL text: one text is one call into the JVM, however long the formula.

BASE_SUMS = (
    "count(*) AS n_flows",
    "min(ts_us) AS first_us",
    "max(ts_us) AS last_us",
    "sum(coalesce(duration, 0D)) AS duration_sum",
)

# A missing payload size counts as zero, so an unknown response looks silent.
VOLUME_SUMS = (
    "cast(sum(coalesce(orig_ip_bytes, 0)) AS double) AS sent",
    "cast(sum(coalesce(resp_ip_bytes, 0)) AS double) AS received",
    "cast(sum(coalesce(orig_pkts, 0)) AS double) AS pkts_out",
    "cast(sum(coalesce(resp_pkts, 0)) AS double) AS pkts_in",
    "avg(cast(coalesce(resp_bytes, 0) = 0 AS int)) AS silent_share",
    "var_pop(cast(coalesce(orig_ip_bytes, 0) + coalesce(resp_ip_bytes, 0) AS double)) AS bytes_var",
)

STATE_SUMS = (
    "coalesce(mode(conn_state, true), 'unknown') AS conn_state_mode",
    "coalesce(mode(proto, true), 'unknown') AS proto_mode",
    "coalesce(mode(service, true), 'unknown') AS service_mode",
    "avg(length(coalesce(history, ''))) AS history_len",
    "avg(cast(contains(coalesce(history, ''), 'S') AS int)) AS history_has_S",
    "avg(cast(contains(coalesce(history, ''), 'D') AS int)) AS history_has_D",
    f"avg(cast(coalesce(orig_p >= {EPHEMERAL_PORT_FLOOR}, false) AS int)) AS is_ephemeral_orig_port",
)


def first_value(name: str) -> str:
    """First non-null value by time, ties by uid."""
    return f"min_by({name}, CASE WHEN {name} IS NOT NULL THEN struct(ts_us, uid) END) AS {name}"


def _meta_picks(columns: Sequence[str]) -> list[str]:
    picks = ["max_by(uid, CASE WHEN uid IS NOT NULL THEN struct(ts_us, uid) END) AS last_uid",
             first_value("detailed_label")]
    return picks + ([first_value("capture_id")] if "capture_id" in columns else [])


def _middle(array: str) -> str:
    """Sum of the two middle entries of a sorted array of ``_m`` entries."""
    return (f"(get({array}, cast(floor((_m - 1) / 2) AS int))"
            f" + get({array}, cast(ceil((_m - 1) / 2) AS int)))")


def _interval_columns(df: DataFrame, keep_series: bool) -> DataFrame:
    """Interval statistics from the sorted array ``times``.

    The deviations are twice the distance from the median: whole numbers, so the two middle ones
    average exactly.
    """
    df = df.selectExpr(
        "* EXCEPT (times)",
        "CASE WHEN size(times) >= 2 THEN zip_with(slice(times, 2, size(times) - 1), "
        "slice(times, 1, size(times) - 1), (b, a) -> b - a) ELSE cast(array() AS array<bigint>) "
        "END AS iats")
    df = df.selectExpr("*", "sort_array(iats) AS _ranked", "size(iats) AS _m",
                       "try_divide(last_us - first_us, size(iats)) AS _mean")
    df = df.selectExpr("*", f"{_middle('_ranked')} AS _median2")
    df = df.selectExpr("*", "sort_array(transform(iats, x -> abs(2 * x - _median2))) AS _devs")
    spread = "aggregate(iats, 0D, (total, x) -> total + (x - _mean) * (x - _mean))"
    dropped = "_ranked, _m, _mean, _median2, _devs" + ("" if keep_series else ", iats")
    return df.selectExpr(
        f"* EXCEPT ({dropped})",
        "coalesce(_mean / 1e6, 0D) AS iat_mean",
        f"coalesce(sqrt(try_divide({spread}, _m)) / 1e6, 0D) AS iat_std",
        "coalesce(_median2 / 2 / 1e6, 0D) AS iat_median",
        "coalesce(get(_ranked, 0) / 1e6, 0D) AS iat_min",
        "coalesce(get(_ranked, _m - 1) / 1e6, 0D) AS iat_max",
        f"coalesce({_middle('_devs')} / 4 / 1e6, 0D) AS iat_mad")


# Day 0 of the epoch was a Thursday, i.e. weekday 3 with Monday as 0.
DERIVED_TIMING = (
    "CASE WHEN iat_mean > 0 THEN iat_std / iat_mean ELSE 0D END AS iat_cv",
    "cast(n_flows AS double) AS session_flow_count",
    "coalesce((last_us - first_us) / 1e6 / 3600, 0D) AS session_span_hours",
    "CASE WHEN last_us > first_us THEN duration_sum / ((last_us - first_us) / 1e6) ELSE 0D END "
    "AS duty_cycle",
    "coalesce(cast(pmod(floor(first_us / 3600000000), 24) AS double), -1D) AS hour_of_day",
    "coalesce(cast(pmod(floor(first_us / 86400000000) + 3, 7) >= 5 AS double), 0D) AS is_weekend",
)

DERIVED_VOLUME = (
    "sent / (received + 1) AS orig_resp_byte_ratio",
    "sent + received AS total_bytes",
    "sent AS orig_bytes",
    "received AS resp_bytes",
    "pkts_out AS orig_pkts",
    "pkts_in AS resp_pkts",
    "pkts_out / (pkts_in + 1) AS pkt_ratio",
    "sent / (pkts_out + 1) AS mean_pkt_size_orig",
    "received / (pkts_in + 1) AS mean_pkt_size_resp",
    "(sent + received) / (duration_sum + 1e-6) AS bytes_per_second",
    "silent_share AS resp_bytes_is_zero",
    "bytes_var AS session_byte_variance",
    "duration_sum / n_flows AS duration",
)

DERIVED_STATE = (
    "cast(resp_p AS double) AS resp_port",
    f"cast(coalesce(resp_p IN {COMMON_SERVICE_PORTS}, false) AS double) AS is_common_service_port",
)


def _log_scaled(expression: str, columns: Sequence[str]) -> str:
    value, name = expression.rsplit(" AS ", 1)
    return f"log1p(greatest({value}, 0D)) AS {name}" if name in columns else expression


def log_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """log1p of the named columns, negative values taken as zero."""
    return df.withColumns({c: F.log1p(F.greatest(F.col(c), F.lit(0.0)))
                           for c in columns if c in df.columns})


def add_context(sessions: DataFrame, per: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Fan-in, fan-out and destination flow count, within each value of the ``per`` columns.

    They follow from the session table alone: it already has one row per host pair and port, with
    its flow count, so the flows are not read again.
    """
    dest = sessions.groupBy(*per, "resp_h").agg(*map(F.expr, (
        "cast(count(DISTINCT orig_h) AS double) AS dest_fanin",
        "cast(sum(n_flows) AS double) AS dest_flow_count", "count(*) AS _dest_rows")))
    source = sessions.groupBy(*per, "orig_h").agg(*map(F.expr, (
        "cast(count(DISTINCT resp_h) AS double) AS src_fanout", "count(*) AS _source_rows")))
    out = lookup_join(sessions, dest, [*per, "resp_h"], "_dest_rows", ["orig_h", "resp_p"],
                      left_rows=rows)
    return lookup_join(out, source, [*per, "orig_h"], "_source_rows", ["resp_h", "resp_p"],
                       left_rows=rows)


def block_sums(flows: DataFrame, blocks: Sequence[str]) -> list[str]:
    """Aggregates of the wanted blocks, all combined before the shuffle but for the picks of ``meta``."""
    sums = list(BASE_SUMS)
    if "volume" in blocks:
        sums += VOLUME_SUMS
    if "state" in blocks:
        sums += STATE_SUMS
    if "meta" in blocks:
        sums += _meta_picks(flows.columns)
    if "target" in flows.columns:
        sums.append("max(target) AS target")
    return sums


def interval_features(table: DataFrame, spectral: bool) -> DataFrame:
    """Statistics of the intervals in the sorted array ``times``, and on demand the two spectral scores."""
    table = _interval_columns(table, spectral)
    return table if not spectral else table.select("*", series_scores("iats").alias("_s")).selectExpr(
        "* EXCEPT (iats, _s)", "_s.periodicity_score", "_s.fft_dominant_power")


def derived_features(table: DataFrame, settings: Settings, blocks: Sequence[str]) -> DataFrame:
    """The features that follow from a session's sums and interval statistics."""
    derived = []
    if "timing" in blocks or "periodicity" in blocks:
        derived += DERIVED_TIMING
    if "volume" in blocks:
        derived += [_log_scaled(e, settings.log_scaled) for e in DERIVED_VOLUME]
    if "state" in blocks:
        derived += DERIVED_STATE
    return table.selectExpr("*", *derived) if derived else table


def session_features(flows: DataFrame, settings: Settings = DEFAULTS,
                     blocks: Sequence[str] = BLOCKS) -> DataFrame:
    """One row per session of at least ``min_session_flows`` flows, with the wanted blocks.

    Output: session keys, ``n_flows``, ``first_us``, ``last_us``, ``target`` where the flows have
    one, and the features. The context block is separate, see ``add_context``.
    """
    keys, sums = list(settings.session_keys), block_sums(flows, blocks)
    timed, spectral = "timing" in blocks or "periodicity" in blocks, "periodicity" in blocks
    hot = find_hot_sessions(flows, keys, settings.hot_session_flows)
    normal = hot.outside(flows) if hot else flows
    series = ["sort_array(collect_list(ts_us)) AS times"] if timed else []
    table = (normal.groupBy(*keys).agg(*map(F.expr, sums + series))
             .where(f"n_flows >= {settings.min_session_flows}"))
    if timed:
        table = interval_features(table, spectral)
    if hot:
        few = hot.inside(flows).groupBy(*keys).agg(*map(F.expr, sums))
        if timed:
            few = hot_timing(few, flows, hot, spectral)
        table = table.unionByName(few)
    return derived_features(table, settings, blocks)


def context_from(sessions: DataFrame, flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Context features counted over other flows, such as the whole capture, joined to the sessions.

    Keys the other flows lack (a sweep's level) do not divide the counts.
    """
    known = [k for k in keys if k in flows.columns]
    per = [k for k in known if k not in ("orig_h", "resp_h", "resp_p")]
    sizes = session_sizes(flows, known)
    dest = sizes.groupBy(*per, "resp_h").agg(*map(F.expr, (
        "cast(count(DISTINCT orig_h) AS double) AS dest_fanin",
        "cast(sum(n_flows) AS double) AS dest_flow_count")))
    source = sizes.groupBy(*per, "orig_h").agg(
        F.expr("cast(count(DISTINCT resp_h) AS double) AS src_fanout"))
    out = counted_lookup(sessions, dest, [*per, "resp_h"], ["orig_h", "resp_p"])
    return counted_lookup(out, source, [*per, "orig_h"], ["resp_h", "resp_p"])


def feature_matrix(flows: DataFrame, settings: Settings = DEFAULTS,
                   context_flows: DataFrame | None = None) -> DataFrame:
    """Session id, target, provenance and all 39 features.

    The context counts the flows of the kept sessions, or ``context_flows`` where given.

    The flows are read once for the hot-session check and once for the features; the session rows are
    written before the context is taken from them.
    """
    return matrix_of(session_features(flows, settings), settings, context_flows)


def matrix_of(sessions: DataFrame, settings: Settings = DEFAULTS,
              context_flows: DataFrame | None = None) -> DataFrame:
    """The feature matrix of session rows that have all blocks but the context."""
    extra = [k for k in settings.session_keys if k not in ("orig_h", "resp_h", "resp_p")]
    stored = materialise(sessions)
    if context_flows is None:
        table = add_context(stored, extra, stored.count())
    else:
        table = context_from(stored, context_flows, settings.session_keys)
    carried = [c for c in ("target", "detailed_label", "capture_id", "last_uid") if c in table.columns]
    return table.select(
        session_id(settings.session_keys).alias("session_id"), "orig_h", "resp_h", "resp_p", *extra,
        *carried, "first_us", "last_us", "n_flows", *NUMERIC_FEATURES, *STATE_CATEGORIES)


def tier_columns(available: Sequence[str], tiers: Sequence[str]) -> list[str]:
    """Always-on connection columns, then those of the tiers; unknown tiers add nothing.

    The TLS tier is refused unless its columns are in the frame.
    """
    always = [c for c in STATE_FEATURES if c in available]
    always += [c for c in available
               if any(c.startswith(f"{cat}_") or c == cat for cat in STATE_CATEGORIES)]
    wanted = list(always)
    for tier in tiers:
        if tier == "tier3" and "tls_version" not in available:
            raise NotImplementedError("the TLS tier needs handshake records joined first")
        wanted += [c for c in TIERS.get(tier, ()) if c in available]
    return list(dict.fromkeys(wanted))


def select_tiers(matrix: DataFrame, tiers: Sequence[str],
                 carried: Sequence[str] = ("session_id", "target")) -> DataFrame:
    return matrix.select(*[c for c in carried if c in matrix.columns],
                         *tier_columns(matrix.columns, tiers))


def feature_summary(matrix: DataFrame, features: Sequence[str] = TIMING_FEATURES + VOLUME_FEATURES
                    + CONTEXT_FEATURES, by: str = "target") -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of each feature per class.

    Long form: the features become rows, so one grouping covers them all; quartiles come from
    (value, count) pairs combined before the shuffle.
    """
    from pulsetrace.operators.order_stats import quantile_table

    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in features)
    long = matrix.select(by, F.expr(f"stack({len(features)}, {pairs}) AS (feature, value)")).withColumn(
        "_g", F.concat_ws("|", F.col(by).cast("string"), "feature"))
    moments = long.groupBy("_g", by, "feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = quantile_table(long, "value", [0.25, 0.5, 0.75], "_g").toDF("_g", "q25", "q50", "q75")
    return moments.join(quartiles, "_g", "left").drop("_g")
