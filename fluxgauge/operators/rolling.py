"""Rolling statistics over row frames. All of one series share one exchange and one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge.operators.series import SITE_SERIES, Series

# The five terms of the smoothed throughput, newest first, and their divisor.
EWM_TERMS = (0.3, 0.21, 0.147, 0.103, 0.072)
EWM_DIVISOR = 0.832


def enough(series: Series, rows: int, value: Column, needed: int) -> Column:
    """``value`` where the frame holds at least ``needed`` non-NULL rows."""
    if needed <= 1:
        return value
    return F.when(F.count(series.value).over(series.frame(rows)) >= needed, value)


def add_rolling(df: DataFrame, series: Series = SITE_SERIES, min_rows_week: int = 24) -> DataFrame:
    """3, 6 and 24 row mean and sample deviation, 24 row extremes, 168 row mean.

    ``min_rows_week`` is the history the weekly mean needs (1 = none).
    """
    name = series.value
    columns: dict[str, Column] = {}
    for n in (3, 6, 24):
        columns[f"roll_mean_{n}h"] = F.avg(name).over(series.frame(n))
        columns[f"roll_std_{n}h"] = F.stddev_samp(name).over(series.frame(n))
    columns["roll_max_24h"] = F.max(name).over(series.frame(24))
    columns["roll_min_24h"] = F.min(name).over(series.frame(24))
    week = F.avg(name).over(series.frame(168))
    columns["roll_mean_168h"] = enough(series, 168, week, min_rows_week)
    return df.withColumns(columns)


def add_short_rolling(df: DataFrame, series: Series, short_rows: int = 12) -> DataFrame:
    """The tick table's rolling columns; ``short_rows`` is the frame called "1h"."""
    name = series.value
    short, quarter, day = series.frame(short_rows), series.frame(6), series.frame(24)
    return df.withColumns(
        {
            "rolling_mean_1h": F.avg(name).over(short),
            "rolling_std_1h": F.stddev_samp(name).over(short),
            "rolling_mean_6h": F.avg(name).over(quarter),
            "rolling_max_24h": F.max(name).over(day),
            "rolling_min_24h": F.min(name).over(day),
        }
    )


def add_moments(df: DataFrame, series: Series, rows: int = 12) -> DataFrame:
    """Rolling excess kurtosis and skewness (population moments)."""
    frame = series.frame(rows)
    return df.withColumns(
        {
            "kurtosis_1h": F.kurtosis(series.value).over(frame),
            "skewness_1h": F.skewness(series.value).over(frame),
        }
    )


def rolling_quantiles(series: Series, rows: int, low: float, high: float) -> Column:
    """Both linearly interpolated quantiles of a frame as one array."""
    return F.percentile(series.x, F.array(F.lit(low), F.lit(high))).over(series.frame(rows))


def add_quantiles(
    df: DataFrame, series: Series = SITE_SERIES, rows: int = 24, min_rows: int = 6
) -> DataFrame:
    """``roll_q25_24h`` and ``roll_q75_24h``."""
    pair = enough(series, rows, rolling_quantiles(series, rows, 0.25, 0.75), min_rows)
    return (
        df.withColumn("__pair", pair)
        .withColumns({"roll_q25_24h": F.col("__pair")[0], "roll_q75_24h": F.col("__pair")[1]})
        .drop("__pair")
    )


def add_ewm(df: DataFrame, series: Series, name: str = "ewm_30pct") -> DataFrame:
    """The fixed five-term smoothing; NULL until four earlier values exist."""
    total = series.x * EWM_TERMS[0]
    for back, weight in enumerate(EWM_TERMS[1:], start=1):
        total = total + series.lag(back) * weight
    return df.withColumn(name, total / EWM_DIVISOR)


def add_general_ewm(
    df: DataFrame, series: Series, alpha: float = 0.3, terms: int = 10, name: str = "ewm"
) -> DataFrame:
    """Weights ``alpha * (1 - alpha)^i`` over up to ``terms`` rows, normalised to sum 1.

    Near the start of a series the weights of the rows at hand are normalised.
    """
    weights = [alpha * (1 - alpha) ** i for i in range(terms)]
    recent = F.reverse(F.collect_list(series.value).over(series.frame(terms)))
    held = F.slice(F.array(*[F.lit(w) for w in weights]), 1, F.size(recent))
    total = F.aggregate(
        F.zip_with(recent, held, lambda v, w: v * w), F.lit(0.0), lambda acc, v: acc + v
    )
    norm = F.aggregate(held, F.lit(0.0), lambda acc, v: acc + v)
    return df.withColumn(name, F.try_divide(total, norm))
