"""Per-site forecasts, intervals, backtests and model choice as distributed Spark jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxgauge.functions.clock import floor_hour, hours, latest, moment
from fluxgauge.functions.numeric import clip
from fluxgauge.operators.aggregate import how_profile
from fluxgauge.operators.joins import join_null_safe, join_sized, with_capacity
from fluxgauge.operators.series import SITE_SERIES, Chunks, Series, TimeChunks
from fluxgauge.session import materialize

MAX_HORIZON = 168
HORIZONS = (1, 6, 24, 72, 168)
MIN_TRAINING_ROWS = 48
METHODS = ("naive_24", "naive_168", "hour_of_week")
#: Free parameters per method for the information criteria.
PARAMETERS = {"naive_24": 1, "naive_168": 1, "hour_of_week": 168, "blend": 170}
WEEKS_AVERAGED = 4

# Interval half-width is z * rmse * (1 + growth * step), step counted from 0.
Z_95, Z_OTHER = 1.96, 1.645
INTERVAL_GROWTH = 0.018


def training_window(
    df: DataFrame,
    as_of=None,
    weeks: int = 4,
    min_rows: int = MIN_TRAINING_ROWS,
    strict: bool = True,
    ts: str = "timestamp",
) -> DataFrame:
    """Rows of the ``weeks`` before ``as_of`` (exclusive; default just after the newest row).

    A site with fewer than ``min_rows`` rows is an error, or is left out if not ``strict``.
    """
    end = latest(df, ts) + hours(1) if as_of is None else moment(as_of)
    recent = df.filter((F.col(ts) >= end - hours(168 * weeks)) & (F.col(ts) < end))
    sizes = recent.groupBy("site").agg(F.count(F.lit(1)).alias("__rows"))
    if strict:
        short = df.select("site").distinct().join(sizes, "site", "left").filter(
            F.coalesce("__rows", F.lit(0)) < min_rows
        )
        worst = short.select("site").limit(1).collect()
        if worst:
            raise ValueError(f"insufficient data for {worst[0][0]}: fewer than {min_rows} rows")
        return recent
    kept = sizes.filter(F.col("__rows") >= min_rows).select("site")
    return join_sized(recent, kept, "site")


def horizon(sites: DataFrame, as_of, steps: int = MAX_HORIZON) -> DataFrame:
    """``site, timestamp, horizon_hours`` for the ``steps`` hours from ``as_of``'s hour on."""
    if not 1 <= steps <= MAX_HORIZON:
        raise ValueError(f"steps must be between 1 and {MAX_HORIZON}")
    return (
        sites.select("site")
        .distinct()
        .withColumn("horizon_hours", F.explode(F.sequence(F.lit(1), F.lit(steps))))
        .withColumn("timestamp", floor_hour(moment(as_of)) + hours(F.col("horizon_hours") - 1))
    )


def _season_back(step: Column, season: int) -> Column:
    """The smallest multiple of ``season`` hours that lies before the origin."""
    return F.ceil(step / season).cast("int") * season


def forecast(
    df: DataFrame,
    as_of=None,
    steps: int = MAX_HORIZON,
    method: str = "hour_of_week",
    weeks: int = 4,
    sites: DataFrame | None = None,
) -> DataFrame:
    """Point forecast per site and hour, within 5 and 95 percent of the site's capacity.

    ``hour_of_week``: mean of the same hour of the week in the training window;
    ``naive_24`` / ``naive_168``: the value one or more whole seasons back;
    ``blend``: mean of those of the three that are known.
    """
    if method not in PARAMETERS:
        raise ValueError(f"unknown method: {method}")
    origin = latest(df) + hours(1) if as_of is None else moment(as_of)
    known = materialize(
        training_window(df, origin, weeks, strict=False).select("site", "timestamp", "total_gbps")
    )
    grid = horizon(known, origin, steps)
    wanted = METHODS if method == "blend" else (method,)
    for name in wanted:
        if name == "hour_of_week":
            profile = how_profile(known).select("site", "day_of_week", "hour_of_day", F.col("how_mean").alias(name))
            keyed = grid.withColumns(
                {"day_of_week": F.weekday("timestamp"), "hour_of_day": F.hour("timestamp")}
            )
            grid = join_null_safe(
                keyed, profile, ["site", "day_of_week", "hour_of_day"], "left"
            ).drop("day_of_week", "hour_of_day")
        else:
            season = int(name.split("_")[1])
            back = hours(_season_back(F.col("horizon_hours"), season))
            source = known.select(
                "site", F.col("timestamp").alias("__source"), F.col("total_gbps").alias(name)
            )
            keyed = grid.withColumn("__source", F.col("timestamp") - back)
            grid = join_null_safe(keyed, source, ["site", "__source"], "left").drop("__source")
    if method == "blend":
        values = F.array_compact(F.array(*[F.col(n) for n in METHODS]))
        total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
        grid = grid.withColumn("__point", F.try_divide(total, F.size(values)))
    else:
        grid = grid.withColumn("__point", F.col(method))
    share = clip(F.try_divide(F.col("__point"), F.col("capacity_gbps")), 0.05, 0.95)
    return (
        with_capacity(grid, sites)
        .withColumn("__share", share)
        .select(
            "site",
            "timestamp",
            "horizon_hours",
            "capacity_gbps",
            (F.col("__share") * F.col("capacity_gbps")).alias("forecast_gbps"),
            (F.col("__share") * 100).alias("forecast_utilization_pct"),
        )
    )


def add_interval(
    fc: DataFrame, errors: DataFrame, confidence: float = 0.95, digits: bool = True
) -> DataFrame:
    """``lower_ci`` and ``upper_ci`` from ``errors`` (``site, rmse``); the lower end is >= 0.

    Rounds to 3 digits (utilisation 2) unless ``digits`` is off.
    """
    z = Z_95 if confidence == 0.95 else Z_OTHER
    point = F.col("forecast_gbps")
    reach = F.col("rmse") * (F.lit(1.0) + (F.col("horizon_hours") - 1) * INTERVAL_GROWTH) * z
    low = point - reach
    out = (
        join_sized(fc, errors.select("site", "rmse"), "site", "left")
        .withColumns(
            {
                "lower_ci": F.when(low.isNotNull(), F.greatest(low, F.lit(0.0))),
                "upper_ci": point + reach,
            }
        )
        .drop("rmse")
    )
    if digits:
        for name in ("forecast_gbps", "lower_ci", "upper_ci"):
            out = out.withColumn(name, F.round(name, 3))
        out = out.withColumn("forecast_utilization_pct", F.round("forecast_utilization_pct", 2))
    return out


def site_forecast(fc: DataFrame, site: str, hours_ahead: int = 24) -> DataFrame:
    """The first hours of one site's forecast; an unknown site is an error."""
    if not 1 <= hours_ahead <= MAX_HORIZON:
        raise ValueError(f"hours must be between 1 and {MAX_HORIZON}")
    own = fc.filter(F.col("site") == site)
    if not own.limit(1).count():
        raise ValueError(f"unknown site: {site}")
    return own.filter(F.col("horizon_hours") <= hours_ahead).orderBy("horizon_hours")


def predictions(df: DataFrame, series: Series = SITE_SERIES, ahead: int = 1) -> DataFrame:
    """What each method would have said ``ahead`` hours before each row; gap-free table.

    Every row is an origin of its own: only values at least ``ahead`` hours older enter.
    """
    weekly = -(-ahead // 168) * 168
    same_hour = [series.lag(weekly + 168 * i) for i in range(WEEKS_AVERAGED)]
    known = F.array_compact(F.array(*same_hour))
    total = F.aggregate(known, F.lit(0.0), lambda acc, v: acc + v)
    return df.withColumns(
        {
            "naive_24": series.lag(-(-ahead // 24) * 24),
            "naive_168": series.lag(weekly),
            "hour_of_week": F.try_divide(total, F.size(known)),
        }
    )


def backtest_chunks(ahead: int = 1) -> TimeChunks:
    reach = 168 * (-(-ahead // 168) + WEEKS_AVERAGED - 1)
    return TimeChunks(span=4 * reach, lookback=reach)


def backtest(
    df: DataFrame,
    ahead: int = 1,
    series: Series = SITE_SERIES,
    chunks: Chunks | None = None,
) -> DataFrame:
    """Rolling-origin errors per site and method over a gap-free hourly table.

    One row per (site, method): ``n_obs, rmse, mape`` (percent), ``rss, aic, bic``. Only
    hours all methods can predict count, so that the methods compare. One exchange for the
    lags, one partial aggregation per site.
    """
    chunks = chunks or backtest_chunks(ahead)
    narrow = df.select(*series.keys, series.ts, series.value)
    told = chunks.run(narrow, series, lambda d, s: predictions(d, s, ahead))
    y = series.x
    usable = told.filter(y.isNotNull()).dropna(subset=list(METHODS))
    measures = [F.count(F.lit(1)).alias("n_obs")]
    for m in METHODS:
        error = y - F.col(m)
        measures += [
            F.sum(error * error).alias(f"{m}_rss"),
            (F.avg(F.try_divide(F.abs(error), F.abs(y))) * 100).alias(f"{m}_mape"),
        ]
    per_site = usable.groupBy(*series.keys).agg(*measures)
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("method"),
                F.col(f"{m}_rss").alias("rss"),
                F.col(f"{m}_mape").alias("mape"),
                F.lit(PARAMETERS[m]).alias("p"),
            )
            for m in METHODS
        ]
    )
    n, rss = F.col("n_obs"), F.col("rss")
    fit = n * F.ln(rss / n)
    return (
        per_site.select(*series.keys, "n_obs", F.inline(rows))
        .withColumns(
            {
                "rmse": F.sqrt(rss / n),
                "aic": F.when(rss > 0, fit + F.col("p") * 2.0),
                "bic": F.when(rss > 0, fit + F.col("p") * F.ln(n)),
            }
        )
        .select(*series.keys, "method", "n_obs", "rmse", "mape", "rss", "aic", "bic")
    )


def select_model(backtests: DataFrame, criterion: str = "aic") -> DataFrame:
    """The method with the lowest criterion per site; ties go to the first name."""
    if criterion not in ("aic", "bic", "rmse", "mape"):
        raise ValueError(f"unknown criterion: {criterion}")
    score = F.col(criterion)
    best = F.min(F.when(score.isNotNull(), F.struct(score.alias("score"), "method")))
    return (
        backtests.groupBy("site")
        .agg(best.alias("best"))
        .select("site", F.col("best.method").alias("method"), F.col("best.score").alias("score"))
    )


def model_diagnostics(
    backtests: DataFrame, criterion: str = "aic", digits: bool = True
) -> DataFrame:
    """One row per site: the chosen method and its errors."""
    chosen = select_model(backtests, criterion).drop("score")
    out = backtests.join(chosen, ["site", "method"]).select(
        "site",
        "method",
        "n_obs",
        F.col("rmse").alias("training_rmse"),
        F.col("mape").alias("training_mape_pct"),
        "aic",
        "bic",
    )
    if digits:
        out = out.withColumns(
            {
                "training_rmse": F.round("training_rmse", 3),
                "training_mape_pct": F.round("training_mape_pct", 2),
            }
        )
    return out


def residuals(df: DataFrame, fc: DataFrame, value: str = "total_gbps") -> DataFrame:
    """``actual, fitted, residual`` where a forecast hour has been observed."""
    observed = df.select("site", "timestamp", F.col(value).alias("actual"))
    told = fc.select("site", "timestamp", F.col("forecast_gbps").alias("fitted"))
    return observed.join(told, ["site", "timestamp"]).withColumn(
        "residual", F.col("actual") - F.col("fitted")
    )


FIT_SCHEMA = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("horizon_hours", T.IntegerType()),
        T.StructField("forecast_gbps", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("n_obs", T.LongType()),
    ]
)


def fourier_fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Least squares on a trend and daily and weekly harmonics for one site's training rows."""
    pdf = pdf.dropna(subset=["total_gbps"]).sort_values("timestamp")
    if pdf.empty:
        return pd.DataFrame({f.name: [] for f in FIT_SCHEMA.fields})
    last = pdf["timestamp"].iloc[-1]

    def design(times) -> np.ndarray:
        t = (pd.DatetimeIndex(times) - last) / pd.Timedelta(hours=1)
        t = t.to_numpy(dtype=float)
        columns = [np.ones_like(t), t / 168.0]
        for period, harmonics in ((24, 4), (168, 3)):
            for k in range(1, harmonics + 1):
                columns += [np.sin(2 * np.pi * k * t / period), np.cos(2 * np.pi * k * t / period)]
        return np.column_stack(columns)

    past = design(pdf["timestamp"])
    y = pdf["total_gbps"].to_numpy(dtype=float)
    weights, *_ = np.linalg.lstsq(past, y, rcond=None)
    future = pd.date_range(last + pd.Timedelta(hours=1), periods=MAX_HORIZON, freq="h")
    return pd.DataFrame(
        {
            "site": pdf["site"].iloc[0],
            "timestamp": future,
            "horizon_hours": np.arange(1, MAX_HORIZON + 1, dtype=np.int32),
            "forecast_gbps": np.maximum(design(future) @ weights, 0.0),
            "rmse": float(np.sqrt(np.mean((y - past @ weights) ** 2))),
            "n_obs": len(y),
        }
    )


def forecast_by_site(
    df: DataFrame, fn=fourier_fit, schema=FIT_SCHEMA, as_of=None, weeks: int = 4
) -> DataFrame:
    """A model of the caller's own per site, given the site's training window.

    A group is at most ``weeks`` x 168 rows, as the table has one row per site and hour.
    """
    window = training_window(df, as_of, weeks, strict=False).select("site", "timestamp", "total_gbps")
    return window.groupBy("site").applyInPandas(fn, schema)
