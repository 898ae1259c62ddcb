"""Whole feature plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge.functions.clock import hours
from fluxgauge.operators.aggregate import hourly_table
from fluxgauge.operators.anomaly import add_anomaly, classify_anomaly, ensemble
from fluxgauge.operators.cross_site import add_correlation, add_cross_site
from fluxgauge.operators.exog import add_exog
from fluxgauge.operators.flows import clean_flows
from fluxgauge.operators.joins import event_flags
from fluxgauge.operators.kpis import add_kpis, add_node_kpis
from fluxgauge.operators.lags import add_lags
from fluxgauge.operators.rolling import add_ewm, add_moments, add_rolling, add_short_rolling
from fluxgauge.operators.series import (
    NODE_SERIES,
    SITE_SERIES,
    Chunks,
    RowChunks,
    Series,
    TimeChunks,
)
from fluxgauge.operators.spectral import add_fft_peaks, add_spectral
from fluxgauge.operators.spine import densify, expected_profile
from fluxgauge.operators.temporal import add_temporal
from fluxgauge.schemas import TRAFFIC_TYPES
from fluxgauge.session import materialize, stored

#: How missing hours of an hourly table count: no traffic; utilisation and quality stay unknown, so
#: that a site that reports nothing doesn't pull down the others' mean.
HOURLY_FILL = {
    "total_gbps": 0.0,
    **{f"{t}_gbps": 0.0 for t in TRAFFIC_TYPES},
    "active_sessions": 0,
    "new_flows_per_sec": 0,
    "link_errors": 0,
    "is_anomaly": False,
}


def hourly_from_flows(
    raw: DataFrame,
    formats: tuple[str, ...] | None = None,
    bucket: Column | None = None,
    key: tuple[str, ...] | None = None,
    start=None,
    end=None,
) -> DataFrame:
    """Raw flow records to a gap-free table of bytes per traffic type and mean latency.

    One aggregation over the flows; hours without flows have 0 bytes and no latency.
    """
    flows = clean_flows(raw, formats, bucket, key)
    table = materialize(hourly_table(flows))
    zeros = {c: 0.0 for c in (*TRAFFIC_TYPES, "total_bytes_hour")}
    return densify(table, ts="hour", start=start, end=end, fill=zeros)


def expected_from_flows(hourly: DataFrame, start=None, end=None) -> DataFrame:
    """Usual bytes per traffic type and site for every hour of ``[start, end)`` (``expected_profile``).

    ``hourly`` is the table of observed hours (``hourly_table``).
    """
    return expected_profile(hourly, (*TRAFFIC_TYPES, "total_bytes_hour"), "hour", start, end)


def features(
    hourly: DataFrame,
    series: Series = SITE_SERIES,
    chunks: Chunks | None = None,
    dow: str = "monday0",
    min_rows: bool = True,
    floor: float | None = None,
    spread: bool = True,
) -> DataFrame:
    """All hourly features: calendar, lags, rolling, KPIs, cross-site, anomalies.

    ``hourly`` has one row per (site, hour). Gaps are allowed by default; for a gap-free table
    (``densify``) ``TimeChunks`` saves the counting pass. Cross-site signals come first, on
    the narrow input; all windows then share one exchange and sort.
    ``min_rows=False`` drops the history requirements.
    """
    needs = {"week": 24, "day": 6, "high": 3} if min_rows else {"week": 1, "day": 1, "high": 1}

    def windows(df: DataFrame, s: Series) -> DataFrame:
        df = add_lags(df, s)
        df = add_rolling(df, s, needs["week"])
        df = add_kpis(df, s, floor)
        df = add_correlation(df, s)
        df = add_anomaly(df, s, needs["day"], needs["high"], floor)
        return classify_anomaly(df, s)

    base = add_cross_site(stored(hourly), series.ts, spread, others=True)
    built = (chunks or RowChunks(bucket_seconds=86_400)).run(base, series, windows).drop("mean_of_others")
    return ensemble(add_temporal(built, series.ts, dow, with_holiday_flag=True))


def node_features(
    node: DataFrame,
    series: Series = NODE_SERIES,
    chunks: Chunks | None = None,
    short_rows: int = 12,
    events: DataFrame | None = None,
    dow: str = "sunday0",
    full_week: bool = True,
    peaks: bool = True,
) -> DataFrame:
    """The tick table's features: calendar, rolling, KPIs, lags, drivers, spectrum.

    Nodes may have any number of ticks, so the default splits them by row count. With
    ``full_week`` only rows with 168 earlier ones remain, as their lag shows.
    """

    def windows(df: DataFrame, s: Series) -> DataFrame:
        df = add_lags(df, s, (1, 2, 24, 48, 168), compare=False)
        df = add_short_rolling(df, s, short_rows)
        df = add_moments(add_ewm(df, s), s)
        df = add_spectral(add_node_kpis(df, s), s)
        return add_fft_peaks(df, s) if peaks else df

    df = add_exog(event_flags(node, events, ts=series.ts), "node_id")
    df = (chunks or RowChunks()).run(df, series, windows)
    df = add_temporal(df, series.ts, dow, with_holiday_flag=True)
    if full_week:
        df = df.filter(F.col("lag_168h").isNotNull())
    return df.select(
        series.ts,
        *series.ties,
        "node_id",
        "region",
        series.value,
        *["hour_of_day", "day_of_week", "is_weekend", "is_peak_hour", "month", "quarter"],
        *["week_of_year", "is_holiday", "hour_sin", "hour_cos"],
        *["rolling_mean_1h", "rolling_std_1h", "rolling_mean_6h", "rolling_max_24h"],
        *["rolling_min_24h", "ewm_30pct", "kurtosis_1h", "skewness_1h"],
        "utilization_pct",
        F.col("packet_loss_pct").alias("packet_loss_rate"),
        F.col("latency_ms").alias("avg_latency_ms"),
        "jitter_ms",
        F.col("active_flows_m").alias("active_flows"),
        *["bytes_io_ratio", "top_talker_share", "protocol_entropy"],
        *["lag_1h", "lag_2h", "lag_24h", "lag_48h", "lag_168h", "diff_1", "diff_24"],
        *["cdn_req_norm", "dns_qps_norm", "bgp_updates", "ntp_drift_proxy"],
        *["geo_event_flag", "maintenance_flag"],
        *["spectral_entropy", "periodogram_power"],
        *(["fft_peak_24", "fft_peak_168"] if peaks else []),
    )


def features_of_day(hourly: DataFrame, day, **options) -> DataFrame:
    """Features of one day, computed with the week ahead of it as history.

    ``hourly`` must hold that week (``read_hourly``) and have the column ``date``. Hours
    missing from it are added, and kept only where they were read.
    """
    table = stored(hourly)
    known = table.drop("date").withColumn("__read", F.lit(True))
    dense = densify(known, fill={c: v for c, v in HOURLY_FILL.items() if c in known.columns})
    options.setdefault("chunks", TimeChunks())
    built = features(dense, **options).filter("__read").drop("__read")
    start = F.lit(str(day)).cast("date").cast("timestamp_ntz")
    return (
        built.filter((F.col("timestamp") >= start) & (F.col("timestamp") < start + hours(24)))
        .withColumn("date", F.to_date("timestamp"))
    )
