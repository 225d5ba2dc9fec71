"""Frames the registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS, Settings
from pulsetrace.operators import labels
from pulsetrace.operators.features import session_features
from pulsetrace.operators.fusion import weighted_average
from pulsetrace.operators.sessions import session_id
from pulsetrace.session import materialise
from pulsetrace.sources import views


def kept_flows(spark: SparkSession, folder: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Flows with a usable label and their target."""
    return labels.binary_target(views.flows(spark, folder), settings)


def add_scores(table: DataFrame) -> DataFrame:
    """Scores stated without a model: regular timing and silent responses."""
    return table.withColumns({
        "supervised_score": F.round(1 / (1 + F.col("iat_cv")), 6),
        "anomaly_score": F.round("resp_bytes_is_zero", 6),
    }).withColumn("risk_score", F.round(weighted_average("supervised_score", "anomaly_score"), 6))


def scored_sessions(spark: SparkSession, folder: str, settings: Settings = DEFAULTS,
                    stored: bool = False) -> DataFrame:
    """One row per session with provenance and the three scores."""
    table = session_features(kept_flows(spark, folder, settings), settings,
                             ("timing", "volume", "meta"))
    scored = add_scores(table).select(
        session_id(settings.session_keys).alias("session_id"), "orig_h", "resp_h", "resp_p",
        "target", "first_us", "last_us", "last_uid", "detailed_label", "capture_id", "n_flows",
        "iat_cv", "resp_bytes_is_zero", "supervised_score", "anomaly_score", "risk_score")
    return materialise(scored) if stored else scored


def rounded(df: DataFrame, columns: dict[str, int | None]) -> DataFrame:
    """The named columns, rounded where a number of places is given."""
    return df.select(*[F.col(c) if p is None else F.round(F.col(c), p).alias(c)
                       for c, p in columns.items()])
