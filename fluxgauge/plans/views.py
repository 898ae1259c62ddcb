"""The tick table's features, KPIs and anomaly flags as named views for SQL users."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fluxgauge.operators.anomaly import anomaly_flags
from fluxgauge.operators.reports import kpi_snapshot
from fluxgauge.operators.series import NODE_SERIES, Series
from fluxgauge.plans.features import node_features
from fluxgauge.session import materialize
from fluxgauge.sources.readers import register_stage

#: Names of the feature table that the reports know under their raw names.
RAW_NAMES = {"packet_loss_rate": "packet_loss_pct", "avg_latency_ms": "latency_ms", "active_flows": "active_flows_m"}


def register_views(
    node: DataFrame,
    series: Series = NODE_SERIES,
    as_of=None,
    days: int = 7,
    last_hours: int = 1,
    digits: bool = True,
    prefix: str = "",
    **options,
) -> dict[str, DataFrame]:
    """Temporary views ``network_features``, ``kpi_snapshot`` and ``anomaly_flags``.

    All three stand on one stored feature table, so that a query on a view never computes the
    features again; both reports cover its rows, those with a week of history. ``as_of`` replaces the
    clock (default: the newest row); ``options`` go to ``node_features``.
    """
    table = materialize(node_features(node, series, **options))
    raw = table.withColumnsRenamed(RAW_NAMES)
    views = {
        "network_features": table,
        "kpi_snapshot": kpi_snapshot(raw, ts=series.ts, digits=digits),
        "anomaly_flags": anomaly_flags(raw, series, as_of, days, last_hours),
    }
    return {name: register_stage(df, prefix + name) for name, df in views.items()}
