"""Model inputs: one-hot categories, standardised numbers, class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetrace.config import NUMERIC_FEATURES, STATE_CATEGORIES


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def vocabulary(train: DataFrame, columns: Sequence[str] = STATE_CATEGORIES) -> dict[str, list[str]]:
    """Known categories per column, from training rows only; ``unknown`` is always a slot of its own.

    Each one becomes a column, so the names are the driver's in any case, however many they are.
    """
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns])
    rows = train.select(F.inline(pairs)).distinct().collect()
    return {c: sorted(r["value"] for r in rows
                      if r["name"] == c and r["value"] not in (None, "unknown")) for c in columns}


def dummy_columns(words: dict[str, list[str]]) -> list[str]:
    return [f"{c}_{v}" for c, known in words.items() for v in [*known, "unknown"]]


def one_hot(words: dict[str, list[str]]) -> SQLTransformer:
    """A stage adding one 0/1 column per known category and one for everything else."""
    parts = []
    for c, known in words.items():
        for v in known:
            parts.append(f"CAST(COALESCE(`{c}` = {_quoted(v)}, FALSE) AS DOUBLE) AS `{c}_{v}`")
        hit = f"`{c}` IN ({', '.join(map(_quoted, known))})" if known else "FALSE"
        parts.append(f"CAST(NOT COALESCE({hit}, FALSE) AS DOUBLE) AS `{c}_unknown`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def scaling(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column is divided by one."""
    row = train.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns)
                      for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    out = {}
    for i, c in enumerate(columns):
        mean, spread = row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0
        tiny = 10 * 2.220446049250313e-16 * max(abs(mean), 1.0)
        out[c] = (mean, spread if spread > tiny else 1.0)
    return out


def standardise(stats: dict[str, tuple[float, float]], suffix: str = "_z") -> SQLTransformer:
    """A stage adding (value - mean) / deviation for each column."""
    parts = [f"(CAST(`{c}` AS DOUBLE) - {m!r}D) / {s!r}D AS `{c}{suffix}`"
             for c, (m, s) in stats.items()]
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def assembler(columns: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="error")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in NUMERIC_FEATURES if c in df.columns]


def class_weights(df: DataFrame, target: str = "target") -> dict[int, float]:
    """Balanced weight n / (classes x rows of the class); one row per class."""
    rows = df.groupBy(target).count().collect()
    total = sum(r["count"] for r in rows)
    return {r[target]: total / (len(rows) * r["count"]) for r in rows}


def add_weight(df: DataFrame, weights: dict[int, float], target: str = "target",
               output: str = "weight") -> DataFrame:
    value = None
    for key, w in weights.items():
        hit = F.col(target) == key
        value = F.when(hit, F.lit(w)) if value is None else value.when(hit, F.lit(w))
    return df.withColumn(output, value)
