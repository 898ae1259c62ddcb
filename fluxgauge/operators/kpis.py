"""Derived KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge.functions.numeric import TINY, clip, ratio
from fluxgauge.operators.series import SITE_SERIES, Series

HIGH_UTILIZATION = 80
MEDIUM_UTILIZATION = 65


def quality_score() -> Column:
    """0..100, lowered by latency, loss and jitter; NULL if any of them is missing."""
    penalty = (
        F.col("latency_ms") / 5.0 + F.col("packet_loss_pct") * 20.0 + F.col("jitter_ms") / 2.0
    )
    return clip(F.lit(100.0) - penalty, 0.0, 100.0)


def congestion_risk() -> Column:
    used = F.col("utilization_pct")
    return (
        F.when(used > HIGH_UTILIZATION, "HIGH").when(used > MEDIUM_UTILIZATION, "MEDIUM").otherwise("LOW")
    )


def add_kpis(df: DataFrame, series: Series = SITE_SERIES, floor: float | None = None) -> DataFrame:
    """Seven hourly KPIs. Needs ``lag_24h``, ``roll_max_24h`` and ``roll_mean_24h``.

    ``floor`` raises the mean of the peak ratio to at least this value instead of giving
    NULL at 0. A missing latency gives a missing efficiency.
    """
    x, earlier = series.x, F.col("lag_24h")
    latency = F.col("latency_ms")
    return df.withColumns(
        {
            "bandwidth_headroom_pct": 100.0 - F.col("utilization_pct"),
            "traffic_intensity_index": ratio(x, F.col("capacity_gbps")),
            "quality_score": quality_score(),
            "congestion_risk": congestion_risk(),
            "efficiency_ratio": F.when(latency.isNotNull(), x / F.greatest(latency, F.lit(1.0))),
            "traffic_growth_rate": ratio(x - earlier, earlier),
            "peak_to_avg_ratio": ratio(F.col("roll_max_24h"), F.col("roll_mean_24h"), floor),
        }
    )


def add_node_kpis(df: DataFrame, series: Series) -> DataFrame:
    """KPIs of the tick table. Needs the columns of ``add_short_rolling``."""
    spread = F.col("rolling_std_1h")
    return df.withColumns(
        {
            "bytes_io_ratio": F.col("bytes_in_gbps") / (F.col("bytes_out_gbps") + TINY),
            "top_talker_share": series.x / (F.col("rolling_max_24h") + TINY),
            "protocol_entropy": spread / (F.col("rolling_mean_1h") + TINY),
            "ntp_drift_proxy": spread,
        }
    )
