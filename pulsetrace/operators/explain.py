"""Attribution of scores to features, its ranking and its wording."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsetrace.functions.text import sentence


def feature_means(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Background mean of each feature: one aggregate row."""
    row = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    return {c: row[c] for c in features}


def linear_attribution(df: DataFrame, weights: Mapping[str, float],
                       means: Mapping[str, float]) -> DataFrame:
    """Add ``attribution``: per feature its value and weight x (value - mean), exact for a linear model."""
    parts = [F.struct(
        F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
        (F.lit(float(w)) * (F.col(c) - F.lit(float(means[c])))).alias("attribution"))
        for c, w in weights.items()]
    return df.withColumn("attribution", F.array(*parts))


def top_reasons(k: int = 3, attribution: str = "attribution", places: int | None = None) -> Column:
    """The k strongest entries by absolute attribution, ties by name; the sign is kept."""
    def size(e):
        strength = F.abs(e["attribution"])
        return strength if places is None else F.round(strength, places)

    ordered = F.array_sort(attribution, lambda a, b: F.when(size(a) > size(b), -1)
                           .when(size(a) < size(b), 1)
                           .when(a["feature"] < b["feature"], -1).otherwise(1))
    return F.slice(ordered, 1, k)


def explanation_text(reasons: str) -> Column:
    """The reasons as one line of text."""
    return sentence(F.col(f"{reasons}.feature"), F.col(f"{reasons}.value"))


def global_importance(df: DataFrame, attribution: str = "attribution") -> DataFrame:
    """Mean absolute attribution per feature, strongest first."""
    return (df.select(F.inline(attribution))
            .groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"))
            .orderBy(F.desc("importance"), "feature"))


def average_rank(column: str) -> Column:
    """Descending rank, equal values sharing their mean rank."""
    everything = Window.partitionBy().orderBy(F.desc(column))
    ties = F.count("*").over(Window.partitionBy(column))
    return F.rank().over(everything) + (ties - 1) / 2


def rank_disagreement(importance: DataFrame, builtin: DataFrame) -> DataFrame:
    """Attribution rank against the model's own importance rank, largest gap first.

    Both inputs have one row per feature, so ranking them in one task is fine.
    """
    both = importance.join(builtin, "feature")
    ranked = both.withColumn("attribution_rank", average_rank("importance")).withColumn(
        "builtin_rank", average_rank("builtin_importance"))
    return ranked.withColumn(
        "rank_disagreement", F.abs(F.col("attribution_rank") - F.col("builtin_rank"))
    ).orderBy(F.desc("rank_disagreement"), "feature")
