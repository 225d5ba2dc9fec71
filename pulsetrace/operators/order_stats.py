"""Exact order statistics of columns too large to sort in one task.

A rank is found by counting: the value range of each target is cut into equal bins, one partial
aggregate counts the bins, and the bin that holds the rank becomes the next range. Each round
narrows the range a thousandfold and sends at most targets x bins rows to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsetrace.session import materialise

BINS = 1024


def _bin(df: DataFrame, value: str) -> Column:
    """Bin of a value between ``_lo`` and ``_hi``; both ends always fall into different bins.

    Infinite and NaN values get bins of their own, so that the next range is finite.
    """
    low, high, at = F.col("_lo").cast("double"), F.col("_hi").cast("double"), F.col(value)
    width = high / F.lit(float(BINS)) - low / F.lit(float(BINS))
    offset = (at - F.col("_lo")).cast("double")
    plain = F.coalesce(F.least(F.floor(F.try_divide(offset, width)), F.lit(BINS - 1)),
                       F.when(at > F.col("_lo"), 1).otherwise(0))
    if dict(df.dtypes)[value] not in ("double", "float"):
        return plain
    far = F.lit(float("inf"))
    odd = (low == -far) | (high == far) | F.isnan("_hi")
    kind = F.when(F.isnan(value), 3).when(at == far, 2).when(at == -far, 0).otherwise(1)
    return F.when(odd, kind).otherwise(plain)


def _group_stats(df: DataFrame, group: str | None, value: str) -> dict:
    """Of few groups: classes or named columns. ``quantile_table`` takes any number."""
    grouped = df.groupBy(group) if group else df.groupBy()
    rows = grouped.agg(F.count(value).alias("n"), F.min(value).alias("lo"),
                       F.max(value).alias("hi")).collect()
    return {(r[group] if group else None): (r["n"], r["lo"], r["hi"]) for r in rows if r["n"]}


def kth_smallest(df: DataFrame, value: str, ranks: dict[Hashable, Sequence[int]],
                 group: str | None = None, stats: dict | None = None,
                 gather: int = 50_000) -> dict:
    """Per group the values at the given zero-based ranks, exactly.

    ``ranks`` maps a group to its ranks (key ``None`` without a group). ``gather`` bounds how many
    distinct values of all open ranges together may be listed in the last step.
    """
    stats = stats or _group_stats(df, group, value)
    found: dict[tuple, object] = {}
    # target -> (group, rank inside the range, low end, high end, rows in the range)
    targets = {}
    for key, wanted in ranks.items():
        if key in stats:
            n, lo, hi = stats[key]
            for k in wanted:
                k = min(max(int(k), 0), n - 1)
                targets[(key, int(k))] = (key, k, lo, hi, n)
    spark = df.sparkSession
    slim = df.select(*([group] if group else []), value).where(F.col(value).isNotNull())
    while targets:
        for name, (_, _, lo, hi, _) in list(targets.items()):
            if lo == hi or lo != lo:
                found[name] = lo
                del targets[name]
        if not targets:
            break
        names = sorted(targets, key=repr)
        last = sum(targets[n][4] for n in names) <= gather
        if group:
            # One row per open target: bounded by the caller's ranks, not by the data.
            rows = [(i, targets[n][0], targets[n][2], targets[n][3])
                    for i, n in enumerate(names)]
            kind = dict(df.dtypes)
            ranges = spark.createDataFrame(
                rows, f"_t int, _target {kind[group]}, _lo {kind[value]}, _hi {kind[value]}")
            hits = slim.join(F.broadcast(ranges), (
                F.col(group).eqNullSafe(F.col("_target"))
                & F.col(value).between(F.col("_lo"), F.col("_hi"))))
        else:
            ranges = F.array(*[F.struct(F.lit(i).alias("_t"), F.lit(targets[n][2]).alias("_lo"),
                                        F.lit(targets[n][3]).alias("_hi"))
                               for i, n in enumerate(names)])
            open_to = F.filter(ranges, lambda r: F.col(value).between(r["_lo"], r["_hi"]))
            hits = slim.select(value, F.inline(open_to))
        if last:
            counted = hits.groupBy("_t", F.col(value).alias("lo")).agg(F.count("*").alias("n"))
            counted = counted.withColumn("hi", F.col("lo"))
        else:
            counted = (hits.groupBy("_t", _bin(df, value).alias("_bin"))
                       .agg(F.count("*").alias("n"), F.min(value).alias("lo"),
                            F.max(value).alias("hi")))
        table: dict[int, list] = {}
        for r in counted.select("_t", "lo", "hi", "n").collect():
            table.setdefault(r["_t"], []).append((r["lo"], r["hi"], r["n"]))
        for i, name in enumerate(names):
            key, k, _, _, _ = targets[name]
            for lo, hi, n in sorted(table[i], key=lambda r: (r[0] != r[0], r[0])):
                if k < n:
                    targets[name] = (key, k, lo, hi, n)
                    break
                k -= n
    return {key: [found[(key, min(max(int(k), 0), stats[key][0] - 1))] for k in wanted]
            for key, wanted in ranks.items() if key in stats}


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    group: str | None = None) -> dict:
    """Linearly interpolated quantiles per group (key ``None`` without a group)."""
    stats = _group_stats(df, group, value)
    wanted, places = {}, {}
    for key, (n, _, _) in stats.items():
        places[key] = [p * (n - 1) for p in probs]
        wanted[key] = sorted({r for x in places[key] for r in (math.floor(x), math.ceil(x))})
    values = kth_smallest(df, value, wanted, group, stats)
    out = {}
    for key, spots in places.items():
        at = dict(zip(wanted[key], values[key]))
        out[key] = []
        for x in spots:
            low, high = at[math.floor(x)], at[math.ceil(x)]
            # Equal ends stay as they are: infinite ones have no difference.
            out[key].append(float(low if low == high else low + (high - low) * (x - math.floor(x))))
    return out


def ranks_by_group(df: DataFrame, value: str, group: str, wanted: Column) -> DataFrame:
    """(group, n, k, value) of any number of groups: the values at the ranks ``wanted`` (array<bigint>, from n).

    The same narrowing with the open ranges as a table: one row per group and rank, joined to the
    values, counted by bin, and replaced by the bin that holds the rank. Nothing is collected.
    """
    slim = df.select(F.col(group).alias("_g"), F.col(value).alias(value)).where(F.col(value).isNotNull())
    stats = slim.groupBy("_g").agg(F.count("*").alias("n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    table = materialise(stats.select("*", F.explode(F.array_distinct(wanted)).alias("k")).select(
        "_g", "n", "k", F.col("k").alias("_rank"), "_lo", "_hi"))
    order = Window.partitionBy("_g", "k").orderBy("_bin")
    open_ = ~F.col("_lo").eqNullSafe(F.col("_hi"))
    while not table.where(open_).isEmpty():
        ranges = table.where(open_).withColumnRenamed("_g", "_of")
        hits = slim.join(ranges, F.col("_g").eqNullSafe(F.col("_of")) & F.col(value).between(F.col("_lo"), F.col("_hi")))
        bins = hits.groupBy("_g", "k", "_rank", F.col("n"), _bin(df, value).alias("_bin")).agg(
            F.count("*").alias("_rows"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        # A window spans the bins of one rank, at most BINS rows.
        upto = bins.withColumn("_upto", F.sum("_rows").over(order))
        hit = upto.where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_rows") <= F.col("_rank")))
        moved = hit.select("_g", "n", "k", (F.col("_rank") - F.col("_upto") + F.col("_rows")).alias("_rank"), "_lo", "_hi")
        table = materialise(table.where(~open_).union(moved))
    return table.select(F.col("_g").alias(group), "n", "k", F.col("_lo").alias(value))


def quantile_table(df: DataFrame, value: str, probs: Sequence[float], group: str) -> DataFrame:
    """Linearly interpolated quantiles ``q0``, ``q1``, ... of any number of groups."""
    places = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    wanted = F.array(*[f(p).cast("bigint") for p in places for f in (F.floor, F.ceil)])
    found = ranks_by_group(df, value, group, wanted)
    at = lambda p, f: F.max(F.when(F.col("k") == f(p).cast("bigint"), F.col(value).cast("double")))
    out = found.groupBy(group).agg(F.first("n").alias("n"), *[
        at(p, f).alias(f"_{name}{i}") for i, p in enumerate(places) for name, f in (("a", F.floor), ("b", F.ceil))])
    return out.select(group, *[
        F.when(F.col(f"_a{i}") == F.col(f"_b{i}"), F.col(f"_a{i}")).otherwise(
            F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (p - F.floor(p))).alias(f"q{i}")
        for i, p in enumerate(places)])


def cuts_by_group(df: DataFrame, group: str, value: str, sizes) -> dict:
    """Cut values per group so that the first part holds ``sizes(n)[0]`` rows, and so on.

    ``sizes`` maps a group's row count to cumulative row counts.
    """
    stats = _group_stats(df, group, value)
    wanted = {key: [c - 1 for c in sizes(n) if 0 < c] for key, (n, _, _) in stats.items()}
    values = kth_smallest(df, value, wanted, group, stats)
    out = {}
    for key, (n, lo, _) in stats.items():
        cuts, rest = [], iter(values[key])
        for c in sizes(n):
            cuts.append(next(rest) if c > 0 else lo - 1)
        out[key] = cuts
    return out


def part_number(group: str, value: str, cuts: dict) -> Column:
    """Index of the part a row falls in: 0 up to the first cut, 1 up to the second, ..."""
    number = None
    for key, bounds in cuts.items():
        inner = F.lit(len(bounds))
        for i in reversed(range(len(bounds))):
            inner = F.when(F.col(value) <= F.lit(bounds[i]), F.lit(i)).otherwise(inner)
        hit = F.col(group).eqNullSafe(F.lit(key))
        number = F.when(hit, inner) if number is None else number.when(hit, inner)
    return F.lit(None).cast("int") if number is None else number


def cut_at_fractions(df: DataFrame, group: str, value: str, fractions: Sequence[float]) -> Column:
    """Part number of each row when every group is cut at the given cumulative fractions.

    Row counts are rounded half to even.
    """
    cuts = cuts_by_group(df, group, value, lambda n: [round(f * n) for f in fractions])
    return part_number(group, value, cuts)
