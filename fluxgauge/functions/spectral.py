"""Dominant frequency of a run of values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCK = 4096


def peak_bins(values: np.ndarray, rows: int) -> np.ndarray:
    """For each position the strongest frequency bin (1..rows//2) of the last ``rows`` values.

    The mean is removed, ties go to the lowest bin, a flat run counts as bin 1. NaN until
    ``rows`` values exist and where one of them is missing.
    """
    out = np.full(len(values), np.nan)
    if len(values) < rows:
        return out
    runs = np.lib.stride_tricks.sliding_window_view(values, rows)
    for at in range(0, len(runs), _BLOCK):
        out[rows - 1 + at : rows - 1 + at + _BLOCK] = peak_bins_of_runs(runs[at : at + _BLOCK])
    return out[: len(values)]


def peak_bins_of_runs(runs: np.ndarray) -> np.ndarray:
    """The strongest bin of every row of a matrix."""
    whole = ~np.isnan(runs).any(axis=1)
    clean = np.where(whole[:, None], runs, 0.0)
    power = np.abs(np.fft.rfft(clean - clean.mean(axis=1, keepdims=True), axis=1)[:, 1:]) ** 2
    best = power.max(axis=1, keepdims=True)
    near = power >= best * (1 - 1e-9)
    flat = best[:, 0] <= 1e-18 * (clean**2).sum(axis=1)
    first = np.where(flat, 0, near.argmax(axis=1)) + 1.0
    return np.where(whole, first, np.nan)


@F.pandas_udf(T.DoubleType())
def fft_dominant_bin(values: pd.Series, rows: pd.Series) -> pd.Series:
    """SQL form: the dominant bin of an array of exactly ``rows`` values, else NULL."""
    out = np.full(len(values), np.nan)
    lengths = values.map(lambda v: -1 if v is None else len(v)).to_numpy()
    wanted = rows.to_numpy()
    for size in np.unique(wanted):
        fits = np.flatnonzero((wanted == size) & (lengths == size))
        for at in range(0, len(fits), _BLOCK):
            part = fits[at : at + _BLOCK]
            out[part] = peak_bins_of_runs(np.stack(values.iloc[part].to_numpy()).astype(float))
    return pd.Series(out).where(~np.isnan(out), None).astype("Float64")


def dominant_bin(values: Column, rows: int) -> Column:
    """The same from built-in functions only, for short arrays: ``rows * rows / 2`` products
    per row, but no Python."""
    mean = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / rows
    centred = F.transform(values, lambda v: v - mean)
    step = 2.0 * np.pi / rows

    def part(wave, k: Column) -> Column:
        terms = F.transform(centred, lambda v, i: v * wave(k * i * step))
        return F.pow(F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v), F.lit(2.0))

    bins = F.sequence(F.lit(1), F.lit(rows // 2))
    power = F.transform(bins, lambda k: part(F.cos, k) + part(F.sin, k))
    best = F.array_max(power)
    energy = F.aggregate(F.transform(values, lambda v: v * v), F.lit(0.0), lambda acc, v: acc + v)
    first = F.array_position(F.transform(power, lambda p: p >= best * (1 - 1e-9)), True)
    found = F.when(best <= energy * 1e-18, 1.0).otherwise(first.cast("double"))
    return F.when(F.size(values) == rows, found)


def register_functions(spark: SparkSession) -> None:
    """Make ``fft_dominant_bin`` callable from SQL."""
    spark.udf.register("fft_dominant_bin", fft_dominant_bin)
