"""Label handling: binary target, class folding, label reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS, Settings


def clean_label(label: str = "detailed_label", fallback: str | None = None) -> Column:
    """Trimmed label, or the coarse label of the ``fallback`` column where it is missing.

    A label missing altogether reads as the text ``nan``, which no list contains.
    """
    names = [label] if fallback is None else [label, fallback]
    return F.coalesce(*[F.trim(F.col(n)) for n in names], F.lit("nan"))


def _known(settings: Settings) -> list[str]:
    return [*settings.positive_labels, *settings.negative_labels, *settings.excluded_labels]


def binary_target(df: DataFrame, settings: Settings = DEFAULTS,
                  label: str = "detailed_label") -> DataFrame:
    """Keep positive and negative flows, add ``target``; everything else is dropped."""
    value = clean_label(label, settings.label_fallback)
    kept = [*settings.positive_labels, *settings.negative_labels]
    positive = value.isin(*settings.positive_labels)
    return df.where(value.isin(*kept)).withColumn("target", positive.cast("int"))


def unrecognised_labels(df: DataFrame, settings: Settings = DEFAULTS,
                        label: str = "detailed_label") -> DataFrame:
    """Labels named in no list, with their row counts."""
    value = clean_label(label, settings.label_fallback)
    return (df.where(~value.isin(*_known(settings)))
            .groupBy(value.alias(label)).agg(F.count("*").alias("n_rows")))


def target_accounting(df: DataFrame, settings: Settings = DEFAULTS,
                      label: str = "detailed_label") -> DataFrame:
    """Positive, negative and excluded row counts; unrecognised rows count as excluded."""
    value = clean_label(label, settings.label_fallback)
    positive = value.isin(*settings.positive_labels)
    negative = value.isin(*settings.negative_labels)
    return df.agg(
        F.count_if(positive).alias("n_positive"),
        F.count_if(negative).alias("n_negative"),
        F.count_if(~(positive | negative)).alias("n_excluded"),
        F.count("*").alias("n_total"),
    )


def fold_rare_classes(df: DataFrame, settings: Settings = DEFAULTS, label: str = "detailed_label",
                      fold_into: str = "other-C&C") -> DataFrame:
    """Add ``multiclass_label``, with rare beacon families folded into one bucket.

    The rare families are a table joined to the flows; Spark broadcasts it where it is small, else it
    splits the flows of a very common label over several tasks.
    """
    families = df.where(F.col(label).startswith("C&C")).groupBy(label).count()
    rare = families.where(F.col("count") < settings.rare_class_min_count).select(
        F.col(label).alias("_rare"))
    joined = df.join(rare, F.col(label) == F.col("_rare"), "left")
    folded = F.when(F.col("_rare").isNotNull(), F.lit(fold_into)).otherwise(F.col(label))
    return joined.withColumn("multiclass_label", folded).drop("_rare")


def multiclass_target(df: DataFrame, settings: Settings = DEFAULTS,
                      label: str = "detailed_label") -> DataFrame:
    """Three analysis classes: benign, heartbeat beacons, other beacons."""
    value = clean_label(label, settings.label_fallback)
    kept = binary_target(df, settings, label)
    return kept.withColumn(
        "analysis_class",
        F.when(value.isin(*settings.negative_labels), "benign")
        .when(value.contains("HeartBeat"), "heartbeat").otherwise("other"))
