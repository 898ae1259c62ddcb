"""Hourly aggregation of flows, traffic shares and traffic profiles.

All are hash aggregates of built-in functions: rows combine before the shuffle, so a site or
hour with a large share of the rows ships one partial row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge.operators.joins import with_latency
from fluxgauge.schemas import TRAFFIC_TYPES


def hourly_by_type(flows: DataFrame) -> DataFrame:
    """Bytes per (site, hour, traffic_type)."""
    return flows.groupBy("site", "hour", "traffic_type").agg(F.sum("total_bytes").alias("total_bytes"))


def _row_sum() -> Column:
    return reduce(lambda a, b: a + b, [F.col(t) for t in TRAFFIC_TYPES])


def pivot_types(by_type: DataFrame) -> DataFrame:
    """One row per (site, hour) with a column per traffic type (0 if absent) and their sum."""
    pivoted = (
        by_type.groupBy("site", "hour").pivot("traffic_type", list(TRAFFIC_TYPES)).sum("total_bytes")
    )
    return pivoted.na.fill(0.0, list(TRAFFIC_TYPES)).withColumn("total_bytes_hour", _row_sum())


def hourly_latency(flows: DataFrame) -> DataFrame:
    """Mean latency per (site, hour)."""
    return flows.groupBy("site", "hour").agg(F.avg("latency_raw").alias("avg_latency_ms"))


def hourly_table(flows: DataFrame) -> DataFrame:
    """``pivot_types`` joined with ``hourly_latency``, as one aggregation with one shuffle."""
    per_type = [
        F.coalesce(
            F.sum(F.when(F.col("traffic_type") == t, F.col("total_bytes"))), F.lit(0.0)
        ).alias(t)
        for t in TRAFFIC_TYPES
    ]
    return (
        flows.groupBy("site", "hour")
        .agg(*per_type, F.avg("latency_raw").alias("avg_latency_ms"))
        .withColumn("total_bytes_hour", _row_sum())
        .select("site", "hour", *TRAFFIC_TYPES, "total_bytes_hour", "avg_latency_ms")
    )


def hourly_table_by_join(flows: DataFrame) -> DataFrame:
    """The same table from its parts: pivot left-joined with latency."""
    return with_latency(pivot_types(hourly_by_type(flows)), hourly_latency(flows))


def type_ratios(hourly: DataFrame) -> DataFrame:
    """Total bytes and share per traffic type; equal shares if there is no traffic."""
    totals = hourly.agg(*[F.coalesce(F.sum(t), F.lit(0.0)).alias(t) for t in TRAFFIC_TYPES])
    grand = _row_sum()
    return (
        totals.withColumn("__grand", grand)
        .unpivot(["__grand"], list(TRAFFIC_TYPES), "traffic_type", "total_bytes")
        .withColumn(
            "ratio",
            F.when(F.col("__grand") > 0, F.col("total_bytes") / F.col("__grand")).otherwise(
                1.0 / len(TRAFFIC_TYPES)
            ),
        )
        .drop("__grand")
    )


def hod_profile(hourly: DataFrame, value: str = "total_bytes_hour", ts: str = "hour") -> DataFrame:
    """Mean per hour of day for all 24 hours; hours without rows get the overall mean."""
    overall = hourly.select(F.avg(value)).scalar()
    seen = hourly.groupBy(F.hour(ts).alias("hod")).agg(F.avg(value).alias("mean_value"))
    hours = hourly.sparkSession.range(24).select(F.col("id").cast("int").alias("hod"))
    return hours.join(F.broadcast(seen), "hod", "left").withColumn(
        "mean_value", F.coalesce("mean_value", overall)
    )


def normalize_profile(profile: DataFrame, value: str = "mean_value") -> DataFrame:
    """``hod_norm``: the profile over its maximum; 0.4 throughout if that is not positive."""
    peak = profile.select(F.max(value)).scalar()
    return profile.withColumn("hod_norm", F.when(peak > 0, F.col(value) / peak).otherwise(0.4))


def how_profile(hourly: DataFrame, value: str = "total_gbps", ts: str = "timestamp") -> DataFrame:
    """Mean, sample deviation and count per site and hour of week (Monday = 0)."""
    return hourly.groupBy(
        "site", F.weekday(ts).alias("day_of_week"), F.hour(ts).alias("hour_of_day")
    ).agg(
        F.avg(value).alias("how_mean"),
        F.stddev_samp(value).alias("how_std"),
        F.count(value).alias("how_count"),
    )
