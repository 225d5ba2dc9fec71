"""Timing features of hot sessions, without gathering a session in one task.

Moments are partial aggregates, medians are found by counting, and the two spectral scores use a
discrete Fourier transform whose rows and columns are groups of about sqrt(length) points each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetrace.operators.joins import lookup_join
from pulsetrace.operators.order_stats import quantile_table
from pulsetrace.operators.sessions import HotSessions, hot_intervals, renamed_keys, same_keys
from pulsetrace.session import materialise

POINTS = "series bigint, bits int, i bigint, re double, im double"


def _columns_pass(pdf: pd.DataFrame) -> pd.DataFrame:
    """Transform one column of the matrix and turn it by the column's phase."""
    bits = int(pdf["bits"].iat[0])
    height, width = 1 << (bits // 2), 1 << (bits - bits // 2)
    column = int(pdf["part"].iat[0])
    x = np.zeros(height, dtype=np.complex128)
    x[(pdf["i"] // width).to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
    k = np.arange(height)
    y = np.fft.fft(x) * np.exp(-2j * np.pi * ((k * column) % (1 << bits)) / (1 << bits))
    return pd.DataFrame({"series": pdf["series"].iat[0], "bits": bits, "part": k, "i": column,
                         "re": y.real, "im": y.imag})


def _rows_pass(pdf: pd.DataFrame) -> pd.DataFrame:
    """Transform one row of the matrix; frequencies come out in natural numbering."""
    bits = int(pdf["bits"].iat[0])
    height, width = 1 << (bits // 2), 1 << (bits - bits // 2)
    row = int(pdf["part"].iat[0])
    x = np.zeros(width, dtype=np.complex128)
    x[pdf["i"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
    y = np.fft.fft(x)
    return pd.DataFrame({"series": pdf["series"].iat[0], "bits": bits,
                         "i": row + height * np.arange(width), "re": y.real, "im": y.imag})


def fourier(points: DataFrame) -> DataFrame:
    """Discrete Fourier transform of every series of 2**bits points; absent points are zero."""
    width = F.pow(F.lit(2.0), F.col("bits") - F.floor(F.col("bits") / 2)).cast("bigint")
    staged = points.withColumn("part", F.col("i") % width)
    kind = "series bigint, bits int, part bigint, i bigint, re double, im double"
    turned = staged.groupBy("series", "part").applyInPandas(_columns_pass, kind)
    return turned.groupBy("series", "part").applyInPandas(_rows_pass, POINTS)


def _told(points: DataFrame, facts: DataFrame, rows: str) -> DataFrame:
    """The points of every series in ``facts`` with its facts; ``rows`` says about how many points a series has.

    All series here are hot keys, so their points are dealt out by position.
    """
    known = facts.withColumns({"_known": F.lit(True), "_points": F.expr(rows)})
    return lookup_join(points, known, ["no"], "_points", ["i"]).where("_known").drop("_known")


def spectral_scores(series: DataFrame, lengths: DataFrame) -> DataFrame:
    """Autocorrelation peak and dominant-frequency share per series.

    ``series`` has ``no``, position ``i`` and centred value ``x``; ``lengths`` gives each series'
    point count ``n``. The transform of the exact length is taken as a convolution with a chirp, so any
    length works.
    """
    sizes = lengths.select("no", "n", F.length(F.bin(2 * F.col("n") - 1)).alias("bits"))
    base = _told(series, sizes, "n")
    square = F.col("i").cast("decimal(18,0)") * F.col("i").cast("decimal(18,0)")
    turn = (square % (F.col("n") * 2)).cast("double") * F.lit(np.pi) / F.col("n")
    base = base.withColumn("turn", turn)
    number = F.col("no").cast("bigint") * 3
    plain = F.struct(number.alias("series"), "bits", "i", F.col("x").alias("re"),
                     F.lit(0.0).alias("im"))
    chirped = F.struct((number + 1).alias("series"), "bits", "i",
                       (F.col("x") * F.cos("turn")).alias("re"),
                       (-F.col("x") * F.sin("turn")).alias("im"))

    def chirp(position):
        return F.struct((number + 2).alias("series"), "bits", position.alias("i"),
                        F.cos("turn").alias("re"), F.sin("turn").alias("im"))

    mirrored = F.pow(F.lit(2.0), F.col("bits")).cast("bigint") - F.col("i")
    points = base.select(F.inline(F.when(
        F.col("i") == 0, F.array(plain, chirped, chirp(F.col("i")))
    ).otherwise(F.array(plain, chirped, chirp(F.col("i")), chirp(mirrored)))))
    spectrum = materialise(fourier(points))
    kind = F.col("series") % 3
    power = spectrum.where(kind == 0).select(
        "series", "bits", "i", (F.col("re") ** 2 + F.col("im") ** 2).alias("re"),
        F.lit(0.0).alias("im"))
    left = spectrum.where(kind == 1).alias("a")
    right = spectrum.where(kind == 2).select(
        (F.col("series") - 1).alias("series"), "i", F.col("re").alias("cre"),
        F.col("im").alias("cim"))
    product = left.join(right, ["series", "i"]).select(
        "series", "bits", "i",
        (F.col("re") * F.col("cre") - F.col("im") * F.col("cim")).alias("re"),
        (-(F.col("re") * F.col("cim") + F.col("im") * F.col("cre"))).alias("im"))
    back = _told(fourier(power.unionByName(product)).withColumn("no", F.expr("series DIV 3")), sizes.drop("bits"), "2 * n")
    is_acf = F.col("series") % 3 == 0
    inside = F.col("i").between(1, F.col("n") - 1)
    half = F.col("i") <= F.floor(F.col("n") / 2)
    strength = F.col("re") ** 2 + F.col("im") ** 2
    return back.groupBy("no").agg(
        (F.max(F.when(is_acf & inside, F.abs("re")))
         / F.max(F.when(is_acf & (F.col("i") == 0), F.col("re")))).alias("periodicity_score"),
        (F.max(F.when(~is_acf & half & (F.col("i") > 0), strength))
         / F.sum(F.when(~is_acf & half, strength))).alias("fft_dominant_power"))


def hot_timing(sums: DataFrame, flows: DataFrame, hot: HotSessions, spectral: bool) -> DataFrame:
    """Interval statistics and spectral scores of the hot sessions, joined to their sums."""
    keys = hot.keys
    slim = flows.select(*keys, "ts_us", "uid")
    numbered = renamed_keys(hot.table.drop("n_flows").withColumnRenamed("_no", "no"), keys)
    points = materialise(
        hot_intervals(slim, hot).where(F.col("iat_us").isNotNull())
        .join(numbered, same_keys(keys))
        .select("no", (F.col("flow_no") - 1).alias("i"), "iat_us"))
    stats = points.groupBy("no").agg(
        F.count("*").alias("m"), F.avg("iat_us").alias("mean"), F.stddev_pop("iat_us").alias("std"),
        F.min("iat_us").alias("lo"), F.max("iat_us").alias("hi"))
    centre = quantile_table(points, "iat_us", [0.5], "no").withColumnRenamed("q0", "median")
    away = _told(points, centre.join(stats.select("no", "m"), "no"), "m").withColumn(
        "dev", F.abs(2 * F.col("iat_us") - (2 * F.col("median")).cast("bigint")))
    spread = quantile_table(away, "dev", [0.5], "no").withColumnRenamed("q0", "mad")
    far = F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")) / 1e6
    flat = far <= 1e-8 + 1e-5 * F.abs(F.col("mean") / 1e6)
    facts = materialise(stats.join(centre, "no").join(spread, "no").select(
        "no", "m", (F.col("mean") / 1e6).alias("iat_mean"), (F.col("std") / 1e6).alias("iat_std"),
        (F.col("median") / 1e6).alias("iat_median"), (F.col("lo") / 1e6).alias("iat_min"),
        (F.col("hi") / 1e6).alias("iat_max"), (F.col("mad") / 2 / 1e6).alias("iat_mad"),
        F.when(F.col("m") < 3, 0.0).when(flat, 1.0).alias("score")))
    scores = ["periodicity_score", "fft_dominant_power"]
    if spectral:
        open_ = facts.where("score IS NULL").select("no", F.col("m").alias("n"), "iat_mean")
        series = _told(points, open_, "n").select(
            "no", "i", (F.col("iat_us") / F.lit(1e6) - F.col("iat_mean")).alias("x"))
        found = spectral_scores(series, open_.drop("iat_mean"))
        facts = facts.join(found, "no", "left").withColumns({c: F.coalesce(c, "score") for c in scores})
    names = ["iat_mean", "iat_std", "iat_median", "iat_min", "iat_max", "iat_mad", *(scores if spectral else [])]
    table = numbered.join(facts, "no", "left").select(
        *[f"_key_{k}" for k in keys], *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names])
    return sums.join(table, same_keys(keys), "left").drop(*[f"_key_{k}" for k in keys])
