"""Periodicity and spectral power of interval series, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

SCORES_TYPE = StructType([StructField("periodicity_score", DoubleType()),
                          StructField("fft_dominant_power", DoubleType())])


def nearly_constant(x: np.ndarray) -> np.ndarray:
    """Rows whose every value is close to the row mean (relative 1e-5, absolute 1e-8)."""
    mean = x.mean(axis=1, keepdims=True)
    return (np.abs(x - mean) <= 1e-8 + 1e-5 * np.abs(mean)).all(axis=1)


def score_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Autocorrelation peak and dominant-frequency share of equally long series, one per row."""
    rows, n = x.shape
    if n < 3:
        return np.zeros(rows), np.zeros(rows)
    flat = nearly_constant(x)
    centred = x - x.mean(axis=1, keepdims=True)
    # Zero padding to 2n-1 or more turns the circular correlation into the linear one.
    size = 1 << int(2 * n - 1).bit_length()
    padded = np.fft.rfft(centred, size, axis=1)
    acf = np.fft.irfft(padded.real ** 2 + padded.imag ** 2, size, axis=1)[:, :n]
    bare = np.fft.rfft(centred, axis=1)
    power = bare.real ** 2 + bare.imag ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        peak = np.abs(acf[:, 1:]).max(axis=1) / acf[:, 0]
        share = power[:, 1:].max(axis=1) / power.sum(axis=1)
    peak = np.where(flat, 1.0, np.nan_to_num(peak))
    share = np.where(flat, 1.0, np.nan_to_num(share))
    return peak, share


@F.pandas_udf(SCORES_TYPE)
def series_scores(intervals_us: pd.Series) -> pd.DataFrame:
    """Both scores of each array of intervals; series of one length are scored together."""
    lengths = intervals_us.map(len).to_numpy()
    peak, share = np.zeros(len(lengths)), np.zeros(len(lengths))
    values = intervals_us.to_numpy()
    for n in np.unique(lengths):
        if n < 3:
            continue
        where = np.flatnonzero(lengths == n)
        # Long series go a few at a time, so a batch never holds many padded copies.
        step = max(1, 2_000_000 // int(n))
        for start in range(0, len(where), step):
            at = where[start:start + step]
            peak[at], share[at] = score_rows(np.stack(values[at]).astype(np.float64) / 1e6)
    return pd.DataFrame({"periodicity_score": peak, "fft_dominant_power": share})
