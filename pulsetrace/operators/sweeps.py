"""Robustness sweeps: timing jitter, byte padding, short observation.

All levels of a sweep run in one job, and each flow is shuffled once: for jitter a session's times travel with
their noise and are moved and sorted again per level; for padding every level is an expression of the same
aggregate. The level then becomes part of the session key. Noise is a hash of the flow id, so its direction is the
same at every level and no random state is involved.

``inject_jitter`` and ``inject_padding`` give the perturbed flows themselves, one copy per level; sweeps use them
only for sessions too large to be gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS, Settings
from pulsetrace.functions.hashing import hash_uniform
from pulsetrace.operators.curves import recall_at_threshold
from pulsetrace.operators.features import block_sums, derived_features, interval_features, session_features
from pulsetrace.operators.joins import lookup_join
from pulsetrace.operators.sessions import find_hot_sessions, intervals, renamed_keys, same_keys


def _at_levels(flows: DataFrame, levels: Sequence, name: str) -> DataFrame:
    return flows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))


def inject_jitter(flows: DataFrame, levels: Sequence[int], settings: Settings = DEFAULTS) -> DataFrame:
    """Move each flow by up to ``level`` percent of its session's mean interval, either way.

    Returns one copy of the flows per level, marked ``jitter_pct``. Sessions without a positive mean
    interval stay as they are.
    """
    keys = list(settings.session_keys)
    pace = flows.groupBy(*keys).agg(
        F.try_divide(F.max("ts_us") - F.min("ts_us"), F.count("ts_us") - 1).alias("_pace"),
        F.count("*").alias("_rows"))
    paced = lookup_join(flows, pace, keys, "_rows", ["uid"])
    side = F.lit(2.0) * hash_uniform(settings.seed, "uid") - F.lit(1.0)
    noise = side * (F.col("jitter_pct") / F.lit(100.0)) * F.col("_pace")
    moved = F.when(F.col("_pace") > 0, F.col("ts_us") + F.floor(noise).cast("bigint"))
    out = (_at_levels(paced, levels, "jitter_pct")
           .withColumn("ts_us", F.coalesce(moved, F.col("ts_us"))).drop("_pace"))
    return out.withColumn("ts", F.col("ts_us") / F.lit(1e6)) if "ts" in flows.columns else out


def inject_padding(flows: DataFrame, levels: Sequence[float],
                   settings: Settings = DEFAULTS) -> DataFrame:
    """Inflate sent bytes by a factor between 1 and ``padding_factor``; one copy per level."""
    factor = 1 + hash_uniform(settings.seed, "uid") * (F.col("padding_factor") - 1)
    padded = {c: F.bround(F.coalesce(F.col(c), F.lit(0)) * factor).cast("bigint")
              for c in ("orig_bytes", "orig_ip_bytes") if c in flows.columns}
    return _at_levels(flows, [float(v) for v in levels], "padding_factor").withColumns(padded)


def _key_settings(settings: Settings, level: str) -> Settings:
    return settings.with_(session_keys=(*settings.session_keys, level))


def _with_hot(flows: DataFrame, settings: Settings, level: str, blocks: Sequence[str], gathered: Callable,
              copied: Callable) -> DataFrame:
    """Session rows per level: ``gathered`` for sessions that fit a task, copies of the flows for the others."""
    hot = find_hot_sessions(flows, settings.session_keys, settings.hot_session_flows)
    table = gathered(hot.outside(flows) if hot else flows)
    if not hot:
        return table
    return table.unionByName(session_features(copied(hot.inside(flows)), _key_settings(settings, level), blocks))


def jittered_sessions(flows: DataFrame, levels: Sequence[int], settings: Settings = DEFAULTS,
                      blocks: Sequence[str] = ("timing",)) -> DataFrame:
    """``session_features`` of the flows moved by ``inject_jitter``, per level ``jitter_pct`` (any block but ``meta``)."""
    keys = list(settings.session_keys)
    timed, spectral = "timing" in blocks or "periodicity" in blocks, "periodicity" in blocks

    def gathered(rows: DataFrame) -> DataFrame:
        side = F.lit(2.0) * hash_uniform(settings.seed, "uid") - F.lit(1.0)
        pair = F.when(F.col("ts_us").isNotNull(), F.struct("ts_us", side.alias("side")))
        table = rows.groupBy(*keys).agg(*map(F.expr, block_sums(rows, blocks)), F.collect_list(pair).alias("_pairs"))
        table = table.where(F.col("n_flows") >= settings.min_session_flows).withColumn(
            "_pace", F.expr("try_divide(last_us - first_us, size(_pairs) - 1)"))
        noise = "cast(floor(p.side * (jitter_pct / 100D) * _pace) AS bigint)"
        table = _at_levels(table, levels, "jitter_pct").withColumn("times", F.expr(
            f"sort_array(transform(_pairs, p -> IF(_pace > 0, p.ts_us + {noise}, p.ts_us)))")).drop("_pairs", "_pace")
        table = table.withColumns({"first_us": F.get("times", 0), "last_us": F.expr("get(times, size(times) - 1)")})
        table = interval_features(table, spectral) if timed else table.drop("times")
        return derived_features(table, settings, blocks)

    return _with_hot(flows, settings, "jitter_pct", blocks, gathered, lambda rows: inject_jitter(rows, levels, settings))


def padded_sessions(flows: DataFrame, levels: Sequence[float], settings: Settings = DEFAULTS,
                    blocks: Sequence[str] = ("volume",)) -> DataFrame:
    """``session_features`` of the flows inflated by ``inject_padding``, per level ``padding_factor`` (any block but ``meta``)."""
    keys = list(settings.session_keys)
    timed, spectral = "timing" in blocks or "periodicity" in blocks, "periodicity" in blocks

    def gathered(rows: DataFrame) -> DataFrame:
        sums = list(map(F.expr, block_sums(rows, blocks)))
        if timed:
            sums.append(F.expr("sort_array(collect_list(ts_us)) AS times"))
        at_level = [F.lit(float(v)).alias("padding_factor") for v in levels]
        if "volume" in blocks:
            sent = [F.bround(F.coalesce("orig_ip_bytes", F.lit(0)) * (1 + hash_uniform(settings.seed, "uid") * (F.lit(float(v)) - 1)))
                    .cast("bigint") for v in levels]
            both = [(x + F.coalesce("resp_ip_bytes", F.lit(0))).cast("double") for x in sent]
            sums += [F.sum(x).cast("double").alias(f"_sent{i}") for i, x in enumerate(sent)]
            sums += [F.var_pop(x).alias(f"_var{i}") for i, x in enumerate(both)]
            at_level = [F.struct(v, F.col(f"_sent{i}").alias("sent"), F.col(f"_var{i}").alias("bytes_var"))
                        for i, v in enumerate(at_level)]
        else:
            at_level = [F.struct(v) for v in at_level]
        table = rows.groupBy(*keys).agg(*sums).where(F.col("n_flows") >= settings.min_session_flows)
        if timed:
            table = interval_features(table, spectral)
        own = [c for c in table.columns if c not in ("sent", "bytes_var") and not c.startswith(("_sent", "_var"))]
        return derived_features(table.select(*own, F.inline(F.array(*at_level))), settings, blocks)

    return _with_hot(flows, settings, "padding_factor", blocks, gathered, lambda rows: inject_padding(rows, levels, settings))


def sweep(sessions: DataFrame, level: str, score: Callable[[DataFrame, Settings], DataFrame],
          threshold: float, settings: Settings = DEFAULTS) -> DataFrame:
    """Recall at a fixed threshold per level.

    ``score`` takes session rows per level, and settings whose session key includes the level; it returns
    rows with ``target``, ``score`` and the level.
    """
    return recall_at_threshold(score(sessions, _key_settings(settings, level)), threshold, by=[level]).withColumn(
        "threshold", F.lit(float(threshold)))


def _positives(flows: DataFrame, sessions: DataFrame | None, settings: Settings) -> DataFrame:
    """Positive flows, of the given sessions (a test part, say) where there are any."""
    positives = flows.where("target = 1")
    if sessions is None:
        return positives
    keys = list(settings.session_keys)
    return positives.join(renamed_keys(sessions.select(*keys).distinct(), keys), same_keys(keys), "left_semi")


#: The blocks a model's matrix is made of.
ALL = ("timing", "periodicity", "volume", "state")


def jitter_curve(flows: DataFrame, score: Callable, threshold: float, settings: Settings = DEFAULTS,
                 sessions: DataFrame | None = None, blocks: Sequence[str] = ALL) -> DataFrame:
    """Recall of the positive sessions as their timing is blurred; ``blocks`` are those that ``score`` reads."""
    positives = _positives(flows, sessions, settings)
    return sweep(jittered_sessions(positives, settings.jitter_levels, settings, blocks), "jitter_pct", score,
                 threshold, settings)


def padding_curve(flows: DataFrame, score: Callable, threshold: float, settings: Settings = DEFAULTS,
                  sessions: DataFrame | None = None, blocks: Sequence[str] = ALL) -> DataFrame:
    """Recall of the positive sessions as their payloads are padded."""
    positives = _positives(flows, sessions, settings)
    return sweep(padded_sessions(positives, settings.padding_levels, settings, blocks), "padding_factor",
                 score, threshold, settings)


def regularity(mean: Column, deviation: Column) -> Column:
    """Score in (0, 1]: 1 for a perfectly regular series."""
    return F.round(1 / (1 + F.when(mean > 0, deviation / mean).otherwise(F.lit(0.0))), 6)


def prefix_stability(flows: DataFrame, lengths: Sequence[int],
                     settings: Settings = DEFAULTS) -> DataFrame:
    """How far the regularity seen in the first m flows is from that of the whole session.

    Only the first max(m) flows of a session enter the per-prefix groups; the whole-session side is
    a partial aggregate.
    """
    keys = list(settings.session_keys)
    series = intervals(flows.select(*keys, "ts_us", "uid"), settings)
    whole = series.groupBy(*keys).agg(
        F.count("*").alias("n"), regularity(F.avg("iat_us"), F.stddev_pop("iat_us")).alias("full"))
    head = (series.where(F.col("flow_no") < max(lengths))
            .withColumn("prefix", F.explode(F.array(*[F.lit(m) for m in lengths])))
            .where(F.col("flow_no") < F.col("prefix")))
    early = head.groupBy(*keys, "prefix").agg(
        F.count("*").alias("seen"),
        regularity(F.avg("iat_us"), F.stddev_pop("iat_us")).alias("early"))
    both = (early.where(F.col("seen") == F.col("prefix"))
            .join(whole.where(F.col("n") >= settings.min_session_flows), keys))
    gap = F.abs(F.col("early") - F.col("full"))
    return both.groupBy("prefix").agg(
        F.count("*").alias("n_sessions"), F.avg(gap).alias("mean_gap"),
        F.avg((gap <= 0.1).cast("int")).alias("stable_share"))
