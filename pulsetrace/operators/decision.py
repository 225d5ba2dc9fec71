"""Thresholds from an alert budget, verdicts and the decision log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS, Settings
from pulsetrace.operators.order_stats import exact_quantiles


@dataclass(frozen=True)
class Thresholds:
    low: float
    high: float


def calibrate_thresholds(scores: DataFrame, score: str = "risk_score",
                         settings: Settings = DEFAULTS) -> Thresholds:
    """Quantiles that spend the daily budget on BLOCK and as much again on ALERT.

    The quantiles are exact at any size; only the two numbers reach the driver.
    """
    share = settings.alerts_per_day / settings.flows_per_day
    probs = [1 - min(1.0, share * 2)] + ([1 - share] if share < 1 else [])
    found = exact_quantiles(scores, score, probs)
    if None not in found:
        raise ValueError("no scores to calibrate on")
    low = found[None][0]
    high = found[None][1] if share < 1 else 0.0
    return Thresholds(min(low, high), high)


def thresholds_frame(scores: DataFrame, thresholds: Thresholds) -> DataFrame:
    return scores.sparkSession.createDataFrame(
        [(thresholds.low, thresholds.high)], "tau_low double, tau_high double")


def decide(score: str, thresholds: Thresholds) -> Column:
    value = F.col(score)
    return (F.when(value >= F.lit(thresholds.high), "BLOCK")
            .when(value >= F.lit(thresholds.low), "ALERT").otherwise("ALLOW"))


def decision_log(scored: DataFrame, thresholds: Thresholds, explanation: Column | None = None,
                 stamped: bool = True) -> DataFrame:
    """One row per session: provenance, scores, action, optional explanation and decision time."""
    log = scored.select(
        "session_id", F.col("last_uid").alias("flow_id"), "capture_id", "risk_score",
        "supervised_score", "anomaly_score", decide("risk_score", thresholds).alias("action"),
        *([explanation.alias("explanation")] if explanation is not None else []))
    if stamped:
        log = log.withColumn("decided_at", F.date_format(
            F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return log


def cap_blocks(log: DataFrame, cap: int, bucket: Column, salts: int = 64) -> DataFrame:
    """At most ``cap`` BLOCK verdicts per time bucket, the riskiest; the rest become ALERT.

    Only BLOCK rows are ranked, in salted parts first. Whatever is below the cap in its part cannot be
    among the first ``cap`` of the bucket, so the final ranking sees cap x salts rows per bucket at most.
    The ids that stay are joined back; rows of one id share a verdict.
    """
    order = [F.desc("risk_score"), F.asc("session_id")]
    blocked = F.col("action") == "BLOCK"
    parts = log.where(blocked).select("session_id", "risk_score", bucket.alias("_bucket"), F.pmod(
        F.xxhash64("session_id"), F.lit(salts)).cast("int").alias("_salt"))
    first = Window.partitionBy("_bucket", "_salt").orderBy(*order)
    final = Window.partitionBy("_bucket").orderBy(*order)
    kept = (parts.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= cap)
            .withColumn("_place", F.row_number().over(final)).where(F.col("_place") <= cap)
            .select(F.col("session_id").alias("_id"), F.col("_bucket").alias("_kept")).distinct())
    joined = log.withColumn("_bucket", bucket).join(
        kept, F.col("session_id").eqNullSafe(F.col("_id")) & F.col("_bucket").eqNullSafe(F.col("_kept")),
        "left").withColumn("_stays", F.col("_id").isNotNull())
    return joined.withColumn("action", F.when(blocked & ~F.col("_stays"), "ALERT").otherwise(F.col("action"))
                             ).drop("_bucket", "_id", "_kept", "_stays")
