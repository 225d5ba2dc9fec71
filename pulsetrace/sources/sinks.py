"""Where results go: decision log, thresholds, evaluation report, models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from pulsetrace.operators.decision import Thresholds, thresholds_frame


def save_decision_log(log: DataFrame, path: str, kind: str = "csv") -> None:
    """Written in parallel, one folder per action."""
    writer = log.write.mode("overwrite").partitionBy("action")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(kind).save(path)


def read_decision_log(spark: SparkSession, path: str, schema: str | None = None,
                      kind: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).format(kind).load(path)


def save_thresholds(scores: DataFrame, thresholds: Thresholds, path: str) -> None:
    thresholds_frame(scores, thresholds).coalesce(1).write.mode("overwrite").json(path)


def read_thresholds(spark: SparkSession, path: str) -> Thresholds:
    row = spark.read.schema("tau_low double, tau_high double").json(path).first()
    return Thresholds(row["tau_low"], row["tau_high"])


def save_report(report: DataFrame, path: str) -> None:
    """A report is a few metric rows, so one file is enough."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_model(model: PipelineModel, spark: SparkSession, path: str, metadata: dict) -> None:
    """Model and its metadata (at least ``feature_list``) under one version folder."""
    model.write().overwrite().save(f"{path}/model")
    (spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string")
     .coalesce(1).write.mode("overwrite").json(f"{path}/metadata"))


def load_model(spark: SparkSession, path: str,
               features: list[str] | None = None) -> tuple[PipelineModel, dict]:
    """Load a model; a differing feature list is refused."""
    row = spark.read.schema("metadata string").json(f"{path}/metadata").first()
    metadata = json.loads(row["metadata"])
    if features is not None and list(metadata["feature_list"]) != list(features):
        raise ValueError("the model was trained on other features")
    return PipelineModel.load(f"{path}/model"), metadata
