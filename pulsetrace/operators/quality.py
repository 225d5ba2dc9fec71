"""Schema checks, type coercion, profile and exact stratified sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsetrace.config import NUMERIC_TYPES, REQUIRED_COLUMNS
from pulsetrace.functions.hashing import hash60
from pulsetrace.operators.order_stats import ranks_by_group


class MissingColumnsError(ValueError):
    """A source lacks a column that timing features cannot do without."""


def check_schema(df: DataFrame, required: tuple[str, ...] = REQUIRED_COLUMNS) -> DataFrame:
    """The frame unchanged, or an error naming the missing columns before any job runs."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise MissingColumnsError(f"required columns are missing: {missing}")
    return df


def schema_report(df: DataFrame, required: tuple[str, ...] = REQUIRED_COLUMNS) -> DataFrame:
    """One row per required column: is it present, and how many rows lack a value."""
    check_schema(df, required)
    counts = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in required])
    stack = ", ".join(f"'{c}', _n - `{c}`" for c in required)
    return counts.selectExpr(f"stack({len(required)}, {stack}) AS (column_name, n_null)")


def null_token(df: DataFrame, token: str = "-") -> DataFrame:
    """Turn the log's null token into null in every string column."""
    strings = {name for name, kind in df.dtypes if kind == "string"}
    return df.select(*[
        F.when(F.trim(F.col(c)) != token, F.col(c)).alias(c) if c in strings else F.col(c)
        for c in df.columns])


def coerce_numeric(df: DataFrame, types: dict[str, str] = NUMERIC_TYPES) -> DataFrame:
    """Cast the known numeric columns; unreadable text becomes null.

    Whole numbers are tried as such first, then as doubles, since exports write them as "12.0" when a
    column has gaps.
    """
    kinds, casts = dict(df.dtypes), {}
    for name, kind in types.items():
        if name not in kinds or (kinds[name] == kind and kind != "double"):
            continue
        number = f"`{name}`" if kinds[name] == "double" else f"try_cast(`{name}` AS double)"
        if kind == "double":
            casts[name] = F.expr(f"nullif({number}, double('NaN'))")
        else:
            casts[name] = F.expr(f"coalesce(try_cast(`{name}` AS {kind}), try_cast({number} AS {kind}))")
    return df.withColumns(casts)


def data_profile(df: DataFrame) -> DataFrame:
    """Row count and null fraction of every column, from one pass."""
    columns = df.columns
    counts = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.selectExpr(
        "_n", f"stack({len(columns)}, {stack}) AS (column_name, present)"
    ).select(
        "column_name", F.col("_n").alias("n_rows"),
        F.round(F.try_divide(F.col("_n") - F.col("present"), F.col("_n")), 4)
        .alias("null_fraction"))


def label_distribution(df: DataFrame, label: str = "detailed_label") -> DataFrame:
    """Count and share of each label, the missing one included."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    # One row per label: an enumeration, so the unpartitioned total is over few rows.
    total = F.sum("n_rows").over(Window.partitionBy())
    return counts.withColumn("fraction", F.round(F.col("n_rows") / total, 6))


def stratified_sample(df: DataFrame, size: int | None, label: str = "detailed_label",
                      key: str = "uid", seed: int = 42) -> DataFrame:
    """Exactly round(fraction * n) rows of every label, the lowest by hash.

    Rows stay where they are: per-label counts and cut points come from small aggregates, and the
    sample itself is a filter. Rows without a label vanish, as they belong to no stratum.
    """
    if size is None:
        return df
    total = df.count()
    if size >= total:
        return df
    drawn = df.where(F.col(label).isNotNull()).withColumn("_h", hash60(seed, key))
    share = F.lit(size / total) * F.col("n")
    # The last rank of the sample per label, however many labels there are.
    last = F.rint(share).cast("bigint") - 1
    cuts = ranks_by_group(drawn, "_h", label, F.when(last >= 0, F.array(last)).otherwise(F.expr("CAST(array() AS array<bigint>)")))
    cuts = cuts.select(F.col(label).alias("_label"), F.col("_h").alias("_cut"))
    return drawn.join(cuts, F.col(label) == F.col("_label")).where("_h <= _cut").drop("_h", "_label", "_cut")
