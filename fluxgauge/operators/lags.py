"""Lags, differences and same-hour comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgauge.functions.clock import hours as hour_interval
from fluxgauge.functions.numeric import ratio
from fluxgauge.operators.joins import join_null_safe
from fluxgauge.operators.series import SITE_SERIES, Series

LAGS = (1, 2, 3, 6, 12, 24, 48, 168)


def add_lags(
    df: DataFrame,
    series: Series = SITE_SERIES,
    lags: tuple[int, ...] = LAGS,
    diffs: tuple[int, ...] = (1, 24),
    compare: bool = True,
) -> DataFrame:
    """``lag_{n}h`` (the value n rows back), ``diff_{n}`` and the ``vs_same_hour_*`` ratios."""
    x = series.x
    df = df.withColumns({f"lag_{n}h": series.lag(n) for n in lags})
    derived = {
        f"diff_{n}": x - (F.col(f"lag_{n}h") if n in lags else series.lag(n)) for n in diffs
    }
    if compare:
        for name, n in (("yesterday", 24), ("last_week", 168)):
            earlier = F.col(f"lag_{n}h") if n in lags else series.lag(n)
            derived[f"vs_same_hour_{name}"] = ratio(x, earlier)
    return df.withColumns(derived) if derived else df


def add_time_lags(
    df: DataFrame, series: Series = SITE_SERIES, hours: tuple[int, ...] = (1, 24, 168)
) -> DataFrame:
    """``time_lag_{n}h``: the value exactly n hours back, also across missing hours.

    An equi-join on (key, time) per lag, so work spreads over rows and not over keys; the
    series must have one row per key and time.
    """
    keys = list(series.keys)
    for n in hours:
        shifted = df.select(
            *keys,
            (F.col(series.ts) + hour_interval(n)).alias(series.ts),
            series.x.alias(f"time_lag_{n}h"),
        )
        df = join_null_safe(df, shifted, [*keys, series.ts], "left")
    return df
