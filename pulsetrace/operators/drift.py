"""Shift of feature distributions between a reference and a current set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetrace.operators.order_stats import exact_quantiles

FLOOR = 1e-6  # share given to an empty bin


def _long(df: DataFrame, features: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in features)
    return df.select(F.expr(f"stack({len(features)}, {pairs}) AS (feature, value)")).where(
        "value is not null")


def drift(reference: DataFrame, current: DataFrame, features: Sequence[str],
          bins: int = 10) -> DataFrame:
    """Per feature: population stability index and the divergence of current from reference.

    Bins are the reference's quantiles; both sets are then counted in one aggregate.
    """
    base = _long(reference, features)
    cuts = exact_quantiles(base, "value", [i / bins for i in range(1, bins)], group="feature")
    place = None
    for name, values in cuts.items():
        borders = F.array(*[F.lit(v) for v in values])
        number = F.size(F.filter(borders, lambda b: b < F.col("value")))
        hit = F.col("feature") == name
        place = F.when(hit, number) if place is None else place.when(hit, number)
    both = base.withColumn("now", F.lit(0)).unionByName(
        _long(current, features).withColumn("now", F.lit(1)))
    counts = both.groupBy("feature", place.alias("bin")).agg(
        F.count_if(F.col("now") == 0).alias("n0"), F.count_if(F.col("now") == 1).alias("n1"))
    # features x bins rows from here on
    totals = counts.groupBy("feature").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    shares = counts.join(totals, "feature").select(
        "feature", F.greatest(F.try_divide("n0", "t0"), F.lit(FLOOR)).alias("q"),
        F.greatest(F.try_divide("n1", "t1"), F.lit(FLOOR)).alias("p"))
    ratio = F.log(F.col("p") / F.col("q"))
    return shares.groupBy("feature").agg(
        F.sum((F.col("p") - F.col("q")) * ratio).alias("psi"),
        F.sum(F.col("p") * ratio).alias("kl"))
