"""Spectral proxies and dominant frequency bins of a series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxgauge.functions.numeric import TINY
from fluxgauge.functions.spectral import peak_bins
from fluxgauge.operators.joins import join_null_safe
from fluxgauge.operators.series import Series

PEAK_ROWS = (24, 168)


def add_spectral(df: DataFrame, series: Series) -> DataFrame:
    """``spectral_entropy`` and the 24 and 168 row periodogram proxies, JVM-side."""
    name = series.value
    day, week = series.frame(24), series.frame(168)
    week_mean = F.avg(name).over(week)
    return df.withColumns(
        {
            "spectral_entropy": F.stddev_samp(name).over(day) / (week_mean + TINY),
            "periodogram_power": F.pow(F.avg(name).over(day), F.lit(2.0)),
            "periodogram_power_168": F.pow(week_mean, F.lit(2.0)),
        }
    )


def join_spectral(df: DataFrame, spectral: DataFrame, series: Series) -> DataFrame:
    """Spectral columns computed apart, joined by key and time.

    Same rows as ``add_spectral`` in the feature pass, for one more shuffle of both sides; the
    series must have one row per key and time.
    """
    return join_null_safe(df, spectral, [*series.keys, series.ts, *series.ties], "inner")


def add_fft_peaks(df: DataFrame, series: Series, rows: tuple[int, ...] = PEAK_ROWS) -> DataFrame:
    """``fft_peak_{n}`` for each n.

    A grouped Arrow map: each value crosses to Python once and the overlapping runs are views
    of it, where arrays of the last 168 values per row would multiply the data by 168. The
    groups are the series' partitions, so use it inside a chunk class, which bounds them; the
    exchange of the surrounding windows is shared.
    """
    keys, ts, ties, value = list(series.keys), series.ts, list(series.ties), series.value
    schema = T.StructType(df.schema.fields + [T.StructField(f"fft_peak_{n}", T.DoubleType()) for n in rows])

    def peaks(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (ts, *ties)])
        values = table[value].cast(pa.float64()).to_numpy().astype(float)
        for n in rows:
            found = peak_bins(values, n)
            table = table.append_column(f"fft_peak_{n}", pa.array(found, mask=np.isnan(found)))
        return table

    return df.groupBy(*keys).applyInArrow(peaks, schema)
