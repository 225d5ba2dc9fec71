"""Readers for connection logs, all ending in the canonical flow columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pulsetrace.config import DEFAULTS, NATIVE_LOG_COLUMNS, NUMERIC_TYPES, Settings
from pulsetrace.operators.labels import binary_target, fold_rare_classes
from pulsetrace.operators.quality import check_schema, coerce_numeric, stratified_sample

# Texts read as null besides the log's own null token.
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def canonical_name(name: str) -> str:
    """``id.orig_h`` -> ``orig_h``, ``detailed-label`` -> ``detailed_label``."""
    return name.removeprefix("id.").replace("-", "_")


def _null_texts_to_null(df: DataFrame, token: str) -> DataFrame:
    """Null texts of the text columns; in number columns they fail the cast and end as null anyway."""
    texts = [n for n, kind in df.dtypes
             if kind == "string" and n != "capture_id" and n not in NUMERIC_TYPES]
    empty = [token, *NULL_TEXTS]
    return df.withColumns({c: F.when(~F.col(c).isin(*empty), F.col(c)) for c in texts})


def _capture_id(path: Column) -> Column:
    """Folder and file name without its last suffix, so equal file names stay apart."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*/[^/]*)$", 1), r"\.[^./]*$", "")


def _one_label_column(df: DataFrame) -> DataFrame:
    """Some exports put the detailed value in ``label`` and have no second column."""
    if "detailed_label" not in df.columns and "label" in df.columns:
        return df.withColumnRenamed("label", "detailed_label")
    return df


def _typed(df: DataFrame) -> DataFrame:
    df = coerce_numeric(df, NUMERIC_TYPES)
    if "ts" in df.columns:
        df = df.withColumn("ts_us", F.round(F.col("ts") * F.lit(1e6)).cast("bigint"))
    return df


def read_native_log(spark: SparkSession, paths: str | Sequence[str], token: str = "-") -> DataFrame:
    """The sensor's own text log: ``#`` comments, 23 values separated by white space."""
    raw = spark.read.text(paths)
    partitioned = "capture_id" in raw.columns
    capture = F.col("capture_id").cast("string") if partitioned else _capture_id(
        F.col("_metadata.file_path"))
    text = F.trim(F.substring_index("value", "#", 1))
    cells = raw.select(capture.alias("capture_id"), text.alias("line")).where("line <> ''").select(
        "capture_id", F.split("line", r"\s+").alias("cell"))
    named = cells.select(*[F.get("cell", F.lit(i)).alias(canonical_name(n))
                           for i, n in enumerate(NATIVE_LOG_COLUMNS)], "capture_id")
    return _typed(_one_label_column(_null_texts_to_null(named, token)))


def read_csv_export(spark: SparkSession, paths: str | Sequence[str], token: str = "-") -> DataFrame:
    """CSV export with a header, plain or gzipped; all files of one call share a layout.

    Unnamed index columns are dropped. Types are stated, never inferred; what does not fit is null.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    header = reader.csv(paths)
    # The header names the columns; only then can each be given its type.
    for field in header.schema.fields:
        # Whole numbers are read as text, as a double does not hold all of them.
        if NUMERIC_TYPES.get(canonical_name(field.name)) == "double":
            field.dataType = DoubleType()
    raw = reader.schema(header.schema).option("nullValue", token).csv(paths)
    names = [n for n in raw.columns if n != "capture_id"]
    unnamed = [n for n in names if n.startswith("_c") and n[2:].isdigit()
               or n.startswith("Unnamed: ")]
    capture = (F.col("capture_id").cast("string") if "capture_id" in raw.columns
               else _capture_id(F.col("_metadata.file_path")))
    named = raw.select(*[F.col(f"`{n}`").alias(canonical_name(n)) for n in names
                         if n not in unnamed], capture.alias("capture_id"))
    return _typed(_one_label_column(_null_texts_to_null(named, token)))


READERS = {"native": read_native_log, "csv": read_csv_export}


def load_captures(spark: SparkSession, sources: Sequence[tuple[str, str]],
                  token: str = "-") -> DataFrame:
    """Append captures given as (format, path); the format is stated, not guessed from the name."""
    if not sources:
        raise ValueError("no capture paths given")
    frames = [READERS[kind](spark, path, token) for kind, path in sources]
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return check_schema(joined)


def prepare_flows(flows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Checked, coerced and labelled flows, rare families folded, sampled if a size is set."""
    ready = (flows.transform(check_schema).transform(coerce_numeric)
             .transform(binary_target, settings).transform(fold_rare_classes, settings))
    return stratified_sample(ready, settings.working_sample_size, seed=settings.seed)
