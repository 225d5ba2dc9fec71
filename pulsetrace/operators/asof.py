"""Running facts in time order over ranges: no key, however busy, is ordered in one task.

Rows are range-partitioned by key and time. A range is swept on its own; what the ranges before it end with
reaches it as one carried value for the only key that can continue into it, the first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsetrace.operators.sessions import renamed_keys, same_keys, time_segments


def carried(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, output: str,
            combine: str = "last", ranges: int | None = None) -> DataFrame:
    """Each row with ``output``: the ``value`` of the rows before it in its key, combined.

    ``combine`` is ``last`` (the latest value that is not null) or ``max``. ``order`` must tell all rows of a key
    apart that have a value; a row does not see its own. Null keys are a key like any other, null times come first,
    without an earlier value the output is null. The carried values are at most one per range, which is what bounds
    their broadcast.
    """
    if combine not in ("last", "max"):
        raise ValueError(f"unknown combination: {combine}")
    keys, order = list(keys), list(order)
    before = (Window.unboundedPreceding, -1)
    cut = time_segments(rows, keys, order, ranges)
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(*before)
    near = F.last(value, ignorenulls=True) if combine == "last" else F.max(value)
    swept = cut.withColumn("_near", near.over(inside))
    seen = F.col(value).isNotNull()
    end = (F.max_by(value, F.when(seen, F.struct(*order))) if combine == "last" else F.max(value)).alias("_end")
    ends = cut.groupBy(*keys, "_seg").agg(end)
    # One row per key and range; the keys within one range leave before the join.
    over = Window.partitionBy(*keys).orderBy("_seg")
    so_far = F.last("_end", ignorenulls=True) if combine == "last" else F.max("_end")
    ends = ends.select(*keys, "_seg", so_far.over(over.rowsBetween(*before)).alias("_carry")).where("_carry IS NOT NULL")
    joined = swept.join(F.broadcast(renamed_keys(ends, [*keys, "_seg"])), same_keys([*keys, "_seg"]), "left")
    found: Column = F.coalesce("_near", "_carry") if combine == "last" else F.greatest("_near", "_carry")
    return joined.select(*rows.columns, found.alias(output))
