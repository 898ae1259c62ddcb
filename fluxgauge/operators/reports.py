"""KPI snapshots and reports: what dashboards and callers ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxgauge.functions.clock import earliest, floor_to, hours, latest, since
from fluxgauge.functions.numeric import any_of, nan_to_null
from fluxgauge.operators.catalogue import catalogue
from fluxgauge.operators.joins import join_null_safe, join_sized
from fluxgauge.operators.kpis import HIGH_UTILIZATION
from fluxgauge.session import materialize, stored

HIGH_NODE_UTILIZATION = 85
DEGRADED_LOSS = 0.001


def kpi_measures(nodes: Column, distinct: bool = False, node: str = "node_id") -> list[Column]:
    """Unrounded snapshot measures, shared by the batch and the streaming snapshot."""
    loss = F.avg("packet_loss_pct") * 100

    def matching(condition: Column) -> Column:
        return F.count_distinct(F.when(condition, F.col(node))) if distinct else F.count_if(condition)

    return [
        nodes.alias("active_nodes"),
        F.sum("throughput_gbps").alias("total_throughput_gbps"),
        F.avg("utilization_pct").alias("avg_utilization_pct"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        loss.alias("packet_loss_pct"),
        F.sum("active_flows_m").alias("total_flows_m"),
        (F.lit(100.0) - loss).alias("availability_pct"),
        matching(F.col("utilization_pct") > HIGH_NODE_UTILIZATION).alias("high_util_nodes"),
        matching(F.col("packet_loss_pct") > DEGRADED_LOSS).alias("degraded_nodes"),
    ]


SNAPSHOT_DIGITS = {
    "total_throughput_gbps": 2,
    "avg_utilization_pct": 2,
    "avg_latency_ms": 2,
    "packet_loss_pct": 4,
    "total_flows_m": 3,
    "availability_pct": 4,
}


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def kpi_snapshot(
    df: DataFrame,
    grain: str = "minute",
    digits: bool = True,
    distinct: bool = False,
    ts: str = "timestamp",
) -> DataFrame:
    """Platform KPIs per minute (or other ``grain``), newest first.

    ``high_util_nodes`` and ``degraded_nodes`` count rows, or nodes with ``distinct``.
    ``digits=False`` leaves the measures unrounded.
    """
    snapshot = df.groupBy(floor_to(grain, F.col(ts)).alias("minute_ts")).agg(
        *kpi_measures(F.count_distinct("node_id"), distinct)
    )
    if digits:
        snapshot = rounded(snapshot, SNAPSHOT_DIGITS)
    return snapshot.orderBy(F.desc("minute_ts"))


def current_kpis(df: DataFrame, key: str = "site", ts: str = "timestamp") -> DataFrame:
    """The last known value of every column per site; NaN counts as unknown.

    One hash aggregate of ``max_by`` over the fixed-width columns: one value per column and
    task, no sort. Text would turn it into a sort of the whole table, so for text columns the
    aggregate yields only the time of the last value, and the few rows at these times are
    read in a second pass over the text columns alone, from the oldest of these times on: that bound
    is a scalar subquery and prunes files and row groups. Needs one row per site and time.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != key]
    df = nan_to_null(stored(df) if text else df)

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.col(ts))

    last = [F.max_by(c, known(c)).alias(c) for c in df.columns if c not in (key, ts, *text)]
    times = [F.max(known(c)).alias(f"__at_{c}") for c in text]
    current = df.groupBy(key).agg(F.max(ts).alias(ts), *last, *times)
    if not text:
        return current
    current = materialize(current)
    marks = [f"__at_{c}" for c in text]
    at_mark = [F.col(ts) == F.col(m) for m in marks]
    oldest = current.select(F.min(F.least(*marks) if len(marks) > 1 else F.col(marks[0]))).scalar()
    texts = (
        join_sized(df.select(key, ts, *text).filter(F.col(ts) >= oldest), current.select(key, *marks), key)
        .filter(any_of(at_mark))
        .groupBy(key)
        .agg(*[F.max(F.when(hit, F.col(c))).alias(c) for c, hit in zip(text, at_mark)])
    )
    return join_null_safe(current.drop(*marks), texts, [key], "left").select(key, ts, *[c for c in df.columns if c not in (key, ts)])


def anomaly_report(
    df: DataFrame, hours_back: int = 24, as_of=None, ts: str = "timestamp"
) -> DataFrame:
    """Flagged rows of the last ``hours_back`` (1..720) hours, newest first."""
    if not 1 <= hours_back <= 720:
        raise ValueError("hours_back must be between 1 and 720")
    return (
        since(df, ts, as_of, hours_back)
        .filter("is_anomaly")
        .select(ts, "site", "total_gbps", "utilization_pct", "anomaly_type")
        .orderBy(F.desc(ts))
    )


def anomaly_count(df: DataFrame, hours_back: int = 24, as_of=None) -> DataFrame:
    """Number of rows of ``anomaly_report``."""
    report = anomaly_report(df, hours_back, as_of)
    return report.agg(F.count(F.lit(1)).alias("anomalies")).withColumn(
        "window_hours", F.lit(hours_back)
    )


def platform_summary(
    current: DataFrame, hourly: DataFrame, features: int, horizon: int = 168, digits: bool = True
) -> DataFrame:
    """One row over the site snapshot. Utilisations of 0 or NULL do not count for the mean.

    Sites above the limit are counted here and listed by ``high_utilization_sites``.
    """
    used = F.col("utilization_pct")
    points = hourly.select(F.count(F.lit(1))).scalar()
    summary = current.agg(
        F.count(F.lit(1)).alias("sites_monitored"),
        F.sum(F.coalesce("total_gbps", F.lit(0.0))).alias("total_traffic_gbps"),
        F.avg(F.nullif(used, F.lit(0.0))).alias("avg_utilization_pct"),
        F.count_if(used > HIGH_UTILIZATION).alias("high_utilization_count"),
    ).withColumns(
        {
            "features_engineered": F.lit(features),
            "data_points": points,
            "forecasting_horizon_hours": F.lit(horizon),
        }
    )
    if digits:
        summary = rounded(summary, {"total_traffic_gbps": 1, "avg_utilization_pct": 1})
    return summary


def high_utilization_sites(current: DataFrame) -> DataFrame:
    """Sites of the snapshot above the utilisation limit."""
    return current.filter(F.col("utilization_pct") > HIGH_UTILIZATION).select(
        "site", "utilization_pct"
    )


def site_coverage(hourly: DataFrame, ts: str = "timestamp") -> DataFrame:
    """First and last hour, rows and missing hours per site, against the table's whole span."""
    span = F.timestamp_diff("HOUR", earliest(hourly, ts), latest(hourly, ts)) + 1
    return (
        hourly.groupBy("site")
        .agg(
            F.min(ts).alias("first_hour"),
            F.max(ts).alias("last_hour"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        .withColumn("missing_hours", span - F.col("n_rows"))
    )


def feature_profile(features: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Per feature: group, non-NULL count, NULL rate, minimum, mean, maximum.

    One aggregate row holds all measures and is turned into rows afterwards, instead of
    turning every input row into one row per feature. Text features have counts only.
    """
    spark = features.sparkSession
    groups = catalogue(spark) if groups is None else groups
    kinds = {f.name: f.dataType for f in features.schema.fields}
    names = [r.feature for r in groups.select("feature").collect() if r.feature in kinds]
    measures = []
    for name in names:
        numeric = isinstance(kinds[name], T.NumericType)
        value = F.col(name).cast("double") if numeric else F.lit(None).cast("double")
        measures.append(
            F.struct(
                F.lit(name).alias("feature"),
                F.count(name).alias("non_null"),
                F.try_divide(F.count_if(F.col(name).isNull()), F.count(F.lit(1))).alias("null_rate"),
                F.min(value).alias("min_value"),
                F.avg(value).alias("mean_value"),
                F.max(value).alias("max_value"),
            )
        )
    listed = features.agg(F.array(*measures).alias("m")).select(F.inline("m"))
    return listed.join(groups, "feature").select("feature_group", *listed.columns)


def feature_group_sizes(spark) -> DataFrame:
    """Group, number of features and their names."""
    return (
        catalogue(spark)
        .groupBy("feature_group")
        .agg(F.count(F.lit(1)).alias("n_features"), F.array_sort(F.collect_list("feature")).alias("features"))
    )


def anomaly_timeline(hourly: DataFrame, days: int = 30, as_of=None, ts: str = "timestamp") -> DataFrame:
    """Anomalies per day and type over the trailing days."""
    recent = since(hourly, ts, as_of, 24 * days).filter("is_anomaly")
    return recent.groupBy(F.to_date(ts).alias("date"), "anomaly_type").agg(
        F.count(F.lit(1)).alias("anomalies")
    )


def peak_and_headroom(forecast: DataFrame) -> DataFrame:
    """Per site the hour of the highest forecast (first if tied) and the least headroom."""
    peak = F.max(F.struct(F.col("forecast_gbps"), -F.col("horizon_hours")))
    return (
        forecast.groupBy("site")
        .agg(
            peak.alias("__peak"),
            F.min(F.col("capacity_gbps") - F.col("forecast_gbps")).alias("min_headroom_gbps"),
            F.min("timestamp").alias("__first"),
        )
        .select(
            "site",
            (F.col("__first") + hours(-F.col("__peak")["col2"] - 1)).alias("peak_hour"),
            F.col("__peak")["forecast_gbps"].alias("peak_gbps"),
            "min_headroom_gbps",
        )
    )


def availability_daily(hourly: DataFrame, scale: float = 1.0, ts: str = "timestamp") -> DataFrame:
    """Availability per site and day: 100 minus mean loss in percent.

    ``scale`` turns the loss column into percent (100 for a fraction).
    """
    loss = F.avg("packet_loss_pct") * scale
    return hourly.groupBy("site", F.to_date(ts).alias("date")).agg(
        (F.lit(100.0) - loss).alias("availability_pct"),
        F.count("packet_loss_pct").alias("measured_hours"),
    )
