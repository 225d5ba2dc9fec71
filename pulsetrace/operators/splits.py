"""Train, validation and test assignment as a column.

All three splits are exact and reproducible. Cut points are found by counting, so assigning a part
is a filter expression and no row is moved or ordered.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS, Settings
from pulsetrace.functions.hashing import hash60
from pulsetrace.operators.order_stats import (
    cut_at_fractions, cuts_by_group, kth_smallest, part_number,
)


def _named(part: Column, names: tuple[str, ...]) -> Column:
    out = None
    for i, name in enumerate(names):
        out = F.when(part == i, name) if out is None else out.when(part == i, name)
    return out


def stratified_split(matrix: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``split`` in train / val / test with the same shares in both classes."""
    train, val, _ = settings.split_ratios
    keyed = matrix.withColumn("_h", hash60(settings.seed, "session_id"))
    part = cut_at_fractions(keyed, "target", "_h", [train, train + val])
    return keyed.withColumn("split", _named(part, ("train", "val", "test"))).drop("_h")


def _ordered_cut(df: DataFrame, size: int, total: int) -> Column:
    """True for the ``size`` earliest sessions; equal times are ordered by hash."""
    if size <= 0:
        return F.lit(False)
    if size >= total:
        return F.lit(True)
    at = kth_smallest(df, "first_us", {None: [size - 1]})[None][0]
    earlier = df.where(F.col("first_us") < at).count()
    ties = df.where(F.col("first_us") == at)
    border = kth_smallest(ties, "_h", {None: [size - earlier - 1]})[None][0]
    return (F.col("first_us") < at) | ((F.col("first_us") == at) & (F.col("_h") <= border))


def temporal_split(matrix: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``split`` by time of the first flow: earlier sessions train, later ones test."""
    keyed = matrix.withColumn("_h", hash60(settings.seed, "session_id"))
    total = keyed.count()
    n_train = int(total * settings.split_ratios[0])
    n_val = int(total * settings.split_ratios[1])
    in_train = _ordered_cut(keyed, n_train, total)
    in_val = _ordered_cut(keyed, n_train + n_val, total)
    return keyed.withColumn(
        "split", F.when(in_train, "train").when(in_val, "val").otherwise("test")).drop("_h")


def _held_out(matrix: DataFrame, settings: Settings, family: str) -> DataFrame:
    """One row per family of the test side: the lowest by hash, a null family included."""
    names = matrix.where("target = 1").select(F.col(family).alias("_family")).distinct()
    wanted = max(1, round(names.count() * settings.held_out_fraction))
    text = F.concat(F.lit(f"{settings.seed}|family"), F.coalesce(F.col("_family").cast("string"), F.lit("None")))
    return names.orderBy(F.md5(text), "_family").limit(wanted)


def held_out_families(matrix: DataFrame, settings: Settings = DEFAULTS,
                      family: str = "detailed_label") -> list[str]:
    """The names of the families kept for the test side, for reports."""
    return sorted((r[0] for r in _held_out(matrix, settings, family).collect()), key=str)


def held_out_family_split(matrix: DataFrame, settings: Settings = DEFAULTS,
                          family: str = "detailed_label") -> DataFrame:
    """``split`` in train / test: some families are never seen in training, benign rows are shared."""
    chosen = _held_out(matrix, settings, family).withColumn("_chosen", F.lit(True))
    keyed = matrix.withColumn("_h", hash60(settings.seed, "session_id"))
    cuts = cuts_by_group(keyed.where("target = 0"), "target", "_h",
                         lambda n: [math.ceil(n * settings.held_out_fraction)])
    benign_test = F.coalesce(part_number("target", "_h", cuts) == 0, F.lit(False))
    positive_test = (F.col("target") == 1) & F.coalesce("_chosen", F.lit(False))
    joined = keyed.join(chosen, F.col(family).eqNullSafe(F.col("_family")), "left")
    return joined.withColumn("split", F.when(positive_test | benign_test, "test").otherwise(
        "train")).drop("_h", "_family", "_chosen")
