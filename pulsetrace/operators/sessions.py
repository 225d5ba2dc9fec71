"""Sessions: flows between one pair of hosts on one destination port.

Sessions are grouped on the key columns themselves. A session with very many flows ("hot") is never
gathered in one task: its flows are range-partitioned by time into segments, and what crosses a
segment border is stitched from one summary row per segment.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS, SESSION_KEYS, Settings
from pulsetrace.session import materialise


def session_id(keys: Sequence[str] = SESSION_KEYS) -> Column:
    """Session text ``orig|resp|port``; a null key reads ``nan``."""
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("nan")) for k in keys])


def renamed_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The frame with its key columns prefixed, so that it can be joined without ambiguity."""
    return df.withColumnsRenamed({k: f"_key_{k}" for k in keys})


def same_keys(keys: Sequence[str]) -> Column:
    """Null-safe equality of the key columns with their prefixed counterparts."""
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return test


@dataclass(frozen=True)
class HotSessions:
    """The sessions too large for one task: a table of their keys, ``n_flows`` and a number ``_no``."""

    keys: tuple[str, ...]
    table: DataFrame

    def _split(self, df: DataFrame, how: str) -> DataFrame:
        # Spark broadcasts the table where its written size allows, else it splits the large keys.
        hot = renamed_keys(self.table.drop("n_flows", "_no"), self.keys)
        return df.join(hot, same_keys(self.keys), how)

    def inside(self, df: DataFrame) -> DataFrame:
        return self._split(df, "left_semi")

    def outside(self, df: DataFrame) -> DataFrame:
        return self._split(df, "left_anti")


def session_sizes(flows: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Flow count per session; counts are combined before the shuffle."""
    return flows.groupBy(*keys).agg(F.count("*").alias("n_flows"))


def find_hot_sessions(flows: DataFrame, keys: Sequence[str] = SESSION_KEYS,
                      limit: int = DEFAULTS.hot_session_flows) -> HotSessions | None:
    """The sessions above ``limit`` flows, however many, or None; reads the key columns only.

    No session can be larger than the whole, so the sizes are counted only where the flows exceed the limit.
    """
    if flows.count() <= limit:
        return None
    large = session_sizes(flows, keys).where(F.col("n_flows") > limit)
    table = materialise(large.withColumn("_no", F.monotonically_increasing_id()))
    return None if table.isEmpty() else HotSessions(tuple(keys), table)


def time_segments(flows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts_us", "uid"),
                  ranges: int | None = None) -> DataFrame:
    """Cut the flows into contiguous, evenly sized runs per session; the run number is ``_seg``.

    ``ranges`` fixes how many, else the session's settings and the data's size do. The numbering comes from sampled range borders, so it is written out once and read back.
    """
    number = [ranges] if ranges else []
    ranged = flows.repartitionByRange(*number, *[F.col(c) for c in (*keys, *order)])
    return materialise(ranged.withColumn("_seg", F.spark_partition_id()))


def _stitched(flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Position and interval of each flow in segmented sessions."""
    inside = Window.partitionBy(*keys, "_seg").orderBy(F.col("ts_us").asc_nulls_last(), "uid")
    local = (flows.withColumn("_at", F.row_number().over(inside))
             .withColumn("_before", F.lag("ts_us").over(inside)))
    edges = flows.groupBy(*keys, "_seg").agg(
        F.count("*").alias("_n"), F.max("ts_us").alias("_last"))
    # A session has at most one row per segment here, i.e. no more than there are tasks.
    over = Window.partitionBy(*keys).orderBy("_seg")
    edges = edges.select(
        *keys, "_seg",
        F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_offset"),
        F.lag("_last").over(over).alias("_carry"))
    edges = renamed_keys(edges, [*keys, "_seg"])
    # Where they are many, the join splits by session and segment, so even a hot session's flows stay apart.
    joined = local.join(edges, same_keys([*keys, "_seg"]))
    previous = F.coalesce(F.col("_before"), F.when(F.col("_at") == 1, F.col("_carry")))
    return joined.select(*[c for c in flows.columns if c != "_seg"],
                         (F.col("_offset") + F.col("_at") - 1).alias("flow_no"),
                         (F.col("ts_us") - previous).alias("iat_us"))


def hot_intervals(flows: DataFrame, hot: HotSessions) -> DataFrame:
    """Flows of the hot sessions with ``flow_no`` and ``iat_us``."""
    return _stitched(time_segments(hot.inside(flows), hot.keys), hot.keys)


def intervals(flows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Every flow with its zero-based position ``flow_no`` and the time since the previous flow."""
    keys = settings.session_keys
    hot = find_hot_sessions(flows, keys, settings.hot_session_flows)
    normal = hot.outside(flows) if hot else flows
    over = Window.partitionBy(*keys).orderBy(F.col("ts_us").asc_nulls_last(), "uid")
    result = (normal.withColumn("flow_no", (F.row_number().over(over) - 1).cast("bigint"))
              .withColumn("iat_us", F.col("ts_us") - F.lag("ts_us").over(over)))
    return result.unionByName(hot_intervals(flows, hot)) if hot else result


def filter_short_sessions(flows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Flows of sessions with at least ``min_session_flows`` flows.

    Hot sessions pass without a shuffle; the others are counted over their window.
    """
    keys = settings.session_keys
    hot = find_hot_sessions(flows, keys, settings.hot_session_flows)
    normal = hot.outside(flows) if hot else flows
    kept = (normal.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
            .where(F.col("_n") >= settings.min_session_flows).drop("_n"))
    return kept.unionByName(hot.inside(flows)) if hot else kept


def filter_short_sessions_semi(flows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The same filter as a semi-join against the session counts."""
    keys = settings.session_keys
    sizes = session_sizes(flows, keys).where(F.col("n_flows") >= settings.min_session_flows)
    hot = find_hot_sessions(flows, keys, settings.hot_session_flows)
    normal = hot.outside(flows) if hot else flows
    kept = normal.join(renamed_keys(sizes, keys), same_keys(keys), "left_semi")
    return kept.unionByName(hot.inside(flows)) if hot else kept


def discard_rate(flows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Share of flows the short-session filter drops, with session counts before and after."""
    kept = F.col("n_flows") >= settings.min_session_flows
    sizes = session_sizes(flows, settings.session_keys)
    return sizes.agg(
        F.count("*").alias("sessions_total"),
        F.count_if(kept).alias("sessions_kept"),
        F.coalesce(F.sum("n_flows"), F.lit(0)).alias("flows_total"),
        F.coalesce(F.sum(F.when(kept, F.col("n_flows"))), F.lit(0)).alias("flows_kept"),
    ).withColumn("discard_rate", F.coalesce(
        1 - F.try_divide(F.col("flows_kept"), F.col("flows_total")), F.lit(0.0)))


def sessionize(flows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Session id, order and intervals, short sessions dropped; one shuffle for all of it."""
    keys = settings.session_keys
    hot = find_hot_sessions(flows, keys, settings.hot_session_flows)
    normal = hot.outside(flows) if hot else flows
    whole = Window.partitionBy(*keys)
    over = whole.orderBy(F.col("ts_us").asc_nulls_last(), "uid")
    kept = (normal.withColumn("_n", F.count("*").over(whole))
            .withColumn("flow_no", (F.row_number().over(over) - 1).cast("bigint"))
            .withColumn("iat_us", F.col("ts_us") - F.lag("ts_us").over(over))
            .where(F.col("_n") >= settings.min_session_flows).drop("_n"))
    if hot:
        kept = kept.unionByName(hot_intervals(flows, hot))
    return kept.withColumn("session_id", session_id(keys))
