"""Turning raw reconstruction errors into anomaly scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetrace.operators.order_stats import exact_quantiles


def benign_threshold(errors: DataFrame, error: str = "error", target: str = "target",
                     percentile: float = 95.0) -> float:
    """Percentile of the errors of all benign rows, exact at any size."""
    benign = errors.where(F.col(target) == 0)
    return exact_quantiles(benign, error, [percentile / 100])[None][0]


def normalised(error: str, threshold: float) -> Column:
    """Logistic squashing with the threshold as midpoint."""
    scaled = (F.col(error) - F.lit(threshold)) / F.lit(threshold + 1e-9)
    return 1 / (1 + F.exp(-scaled))
