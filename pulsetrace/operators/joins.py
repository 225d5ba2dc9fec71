"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SLICE = 2_000_000


def lookup_join(left: DataFrame, lookup: DataFrame, on: Sequence[str], weight: str,
                spread_by: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE,
                left_rows: int | None = None) -> DataFrame:
    """Left join to a table with one row per key; ``weight`` is the key's row count on the left.

    A key with more rows than one slice should hold is cut into several: its lookup row is copied
    once per slice and its left rows are dealt out by hash. The list of such keys is at most
    (left rows / rows_per_slice) long, which is what makes broadcasting it safe. When the caller
    knows the left side to fit one slice, no key can be heavy and the plain join is used.
    """
    on = list(on)
    if left_rows is not None and left_rows <= rows_per_slice:
        return left.join(lookup.drop(weight), on, "left")
    slices = f"cast(ceil({weight} / {float(rows_per_slice)}D) AS int)"
    heavy = lookup.where(f"{weight} > {rows_per_slice}").selectExpr(*on, f"{slices} AS _slices")
    left = left.join(F.broadcast(heavy), on, "left").selectExpr(
        "* EXCEPT (_slices)",
        f"cast(pmod(xxhash64({', '.join(spread_by)}), coalesce(_slices, 1)) AS int) AS _slice")
    right = lookup.selectExpr(
        f"* EXCEPT ({weight})", f"explode(sequence(0, greatest({slices}, 1) - 1)) AS _slice")
    return left.join(right, [*on, "_slice"], "left").drop("_slice")


def counted_lookup(left: DataFrame, facts: DataFrame, on: Sequence[str], spread_by: Sequence[str],
                   rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``lookup_join`` to facts that do not know their row counts on the left.

    The counts are combined before their shuffle, and facts are first matched to distinct keys.
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("_rows"))
    return lookup_join(left, counts.join(facts, list(on), "left"), on, "_rows", spread_by,
                       rows_per_slice)
