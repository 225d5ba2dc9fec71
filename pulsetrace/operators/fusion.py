"""One risk score from the supervised and the anomaly score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS, Settings
from pulsetrace.operators.curves import average_precision


def weighted_average(supervised: str, anomaly: str, settings: Settings = DEFAULTS) -> Column:
    a, b = settings.supervised_weight, settings.anomaly_weight
    return ((F.lit(float(a)) * F.col(supervised) + F.lit(float(b)) * F.col(anomaly))
            / F.lit(float(a + b)))


def max_score(supervised: str, anomaly: str) -> Column:
    return F.greatest(F.col(supervised), F.col(anomaly))


def fuse(supervised: str = "supervised_score", anomaly: str = "anomaly_score",
         settings: Settings = DEFAULTS) -> Column:
    """Risk by the configured method; an unknown method is an error."""
    if settings.fusion_method == "weighted_average":
        return weighted_average(supervised, anomaly, settings)
    if settings.fusion_method == "max_score":
        return max_score(supervised, anomaly)
    raise ValueError(f"unknown fusion method: {settings.fusion_method}")


def compare_fusion(df: DataFrame, supervised: str = "supervised_score",
                   anomaly: str = "anomaly_score", settings: Settings = DEFAULTS,
                   target: str = "target", places: int | None = None) -> DataFrame:
    """Average precision of both methods, from one job over (method, score) rows."""
    average = weighted_average(supervised, anomaly, settings)
    pairs = F.array(
        F.struct(F.lit("weighted_average").alias("method"),
                 (average if places is None else F.round(average, places)).alias("score")),
        F.struct(F.lit("max_score").alias("method"),
                 max_score(supervised, anomaly).alias("score")))
    return average_precision(df.select(target, F.inline(pairs)), by=["method"], target=target)
