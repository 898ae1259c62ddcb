"""Which features belong to which group, read off the builders themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxgauge.operators.anomaly import add_anomaly
from fluxgauge.operators.cross_site import add_correlation, add_cross_site
from fluxgauge.operators.kpis import add_kpis
from fluxgauge.operators.lags import add_lags
from fluxgauge.operators.rolling import add_rolling
from fluxgauge.operators.temporal import add_temporal
from fluxgauge.schemas import HOURLY, dimension


def feature_groups(spark: SparkSession) -> dict[str, list[str]]:
    """Group -> feature names. Only analyses plans; nothing runs."""
    table = spark.createDataFrame([], HOURLY)
    builders = {
        "temporal": lambda df: add_temporal(df, with_holiday_flag=True),
        "lag_features": add_lags,
        "rolling_stats": add_rolling,
        "derived_kpis": add_kpis,
        "cross_site": lambda df: add_correlation(
            add_cross_site(df, spread=False).withColumn("mean_of_others", df.utilization_pct)
        ).drop("mean_of_others"),
        "anomaly_indicators": add_anomaly,
    }
    groups = {}
    for name, build in builders.items():
        built = build(table)
        groups[name] = [c for c in built.columns if c not in table.columns]
        table = built
    return groups


def catalogue(spark: SparkSession) -> DataFrame:
    """``feature_group, feature``, one row per feature."""
    rows = [(group, f) for group, names in feature_groups(spark).items() for f in names]
    return dimension(spark, rows, "feature_group string, feature string")
