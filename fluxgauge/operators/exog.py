"""Exogenous drivers normalised per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgauge.functions.numeric import TINY
from fluxgauge.operators.joins import with_node_stats

DRIVERS = {"cdn": "cdn_requests_k", "dns": "dns_qps"}
NAMES = {"cdn": "cdn_req_norm", "dns": "dns_qps_norm"}


def exog_stats(df: DataFrame, key: str = "node_id") -> DataFrame:
    """Mean and sample deviation of the drivers per node, combined before the shuffle."""
    measures = []
    for short, column in DRIVERS.items():
        measures += [
            F.avg(column).alias(f"{short}_mean"),
            F.stddev_samp(column).alias(f"{short}_std"),
        ]
    return df.groupBy(key).agg(*measures)


def add_exog(df: DataFrame, key: str = "node_id", stats: DataFrame | None = None) -> DataFrame:
    """``cdn_req_norm`` and ``dns_qps_norm``."""
    joined = with_node_stats(df, exog_stats(df, key) if stats is None else stats, key)
    scores = {
        NAMES[short]: (F.col(column) - F.col(f"{short}_mean")) / (F.col(f"{short}_std") + TINY)
        for short, column in DRIVERS.items()
    }
    return joined.withColumns(scores).drop(
        *[f"{short}_{part}" for short in DRIVERS for part in ("mean", "std")]
    )
