"""Anomaly indicators, severities, ensemble decisions and typed anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgauge.functions.clock import since
from fluxgauge.functions.numeric import TINY, flag, ratio
from fluxgauge.operators.joins import join_sized
from fluxgauge.operators.series import NODE_SERIES, SITE_SERIES, Series

SPIKE_Z = 3.0
IQR_REACH = 1.5
SUSTAINED_FACTOR = 1.5


def add_anomaly(
    df: DataFrame,
    series: Series = SITE_SERIES,
    min_rows: int = 6,
    min_rows_high: int = 3,
    floor: float | None = None,
    baseline: str = "include_current",
    spike_rows: int = 3,
) -> DataFrame:
    """z-scores over 24 and 3 rows, IQR, spike and sustained-high flags.

    ``min_rows`` non-NULL rows are needed by the 24-row statistics and ``min_rows_high`` by
    the six-row minimum (1 = no need). ``floor`` raises deviations and the IQR to at least
    this value instead of giving NULL at 0. With the current row in its own baseline, a
    three-row z cannot pass 1.155, so ``sudden_spike_flag`` stays 0; with
    ``baseline="exclude_current"`` and a longer ``spike_rows`` it fires.
    """
    if baseline not in ("include_current", "exclude_current"):
        raise ValueError(f"unknown baseline option: {baseline}")
    frame = series.frame if baseline == "include_current" else series.before
    x, name = series.x, series.value
    day, short = frame(24), frame(spike_rows)

    df = df.withColumns(
        {
            "__n24": F.count(name).over(day),
            "__mean24": F.avg(name).over(day),
            "__std24": F.stddev_samp(name).over(day),
            "__mean3": F.avg(name).over(short),
            "__std3": F.stddev_samp(name).over(short),
            "__quart": F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).over(day),
            "__low6": F.min(name).over(series.frame(6)),
            "__n6": F.count(name).over(series.frame(6)),
        }
    )
    known = F.col("__n24") >= min_rows
    mean = F.when(known, F.col("__mean24"))
    spread = F.col("__quart")[1] - F.col("__quart")[0]
    if floor is not None:
        spread = F.when(spread.isNotNull(), F.greatest(spread, F.lit(floor)))
    low = F.when(F.col("__n6") >= min_rows_high, F.col("__low6"))
    return (
        df.withColumns(
            {
                "zscore_24h": F.when(known, ratio(x - F.col("__mean24"), F.col("__std24"), floor)),
                "zscore_1h": ratio(x - F.col("__mean3"), F.col("__std3"), floor),
                "iqr_flag_24h": flag(F.abs(x - mean) > spread * IQR_REACH),
                "sustained_high_flag": flag(low > mean * SUSTAINED_FACTOR),
            }
        )
        .withColumn("sudden_spike_flag", flag(F.abs("zscore_1h") > SPIKE_Z))
        .drop("__n24", "__mean24", "__std24", "__mean3", "__std3", "__quart", "__low6", "__n6")
    )


def ensemble(df: DataFrame, threshold: float = 3.0, votes: int = 2) -> DataFrame:
    """z-score, IQR and sustained-high votes, and whether enough of them agree."""
    total = (
        flag(F.abs("zscore_24h") > threshold) + F.col("iqr_flag_24h") + F.col("sustained_high_flag")
    )
    return df.withColumn("ensemble_votes", total).withColumn(
        "ensemble_anomaly", flag(F.col("ensemble_votes") >= votes)
    )


def classify_anomaly(df: DataFrame, series: Series = SITE_SERIES, rows: int = 24) -> DataFrame:
    """``detected_type``: ddos (utilisation 30 points above the mean of the ``rows`` rows
    ahead), maintenance (at most a fifth of it), bgp_flap (fewer peers than the row ahead)."""
    used = F.col("utilization_pct")
    usual = F.col("__usual")
    kind = (
        F.when(used >= usual + 30.0, "ddos")
        .when(used <= usual * 0.2, "maintenance")
        .when(F.col("bgp_peers_up") < F.col("__peers"), "bgp_flap")
    )
    return (
        df.withColumns(
            {
                "__usual": F.avg("utilization_pct").over(series.before(rows)),
                "__peers": series.lag(1, "bgp_peers_up"),
            }
        )
        .withColumn("detected_type", kind)
        .drop("__usual", "__peers")
    )


def baseline_stats(
    df: DataFrame, series: Series = NODE_SERIES, as_of=None, days: int = 7
) -> DataFrame:
    """Mean ``mu`` and sample deviation ``sigma`` per key over the trailing days."""
    recent = since(df, series.ts, as_of, 24 * days)
    return recent.groupBy(*series.keys).agg(
        F.avg(series.value).alias("mu"), F.stddev_samp(series.value).alias("sigma")
    )


def severity(df: DataFrame, series: Series = NODE_SERIES) -> DataFrame:
    """``z_score`` and ``anomaly_severity`` from ``mu`` and ``sigma``; works on streams too."""
    z = F.col("z_score")
    return df.withColumn(
        "z_score", F.abs(series.x - F.col("mu")) / (F.col("sigma") + TINY)
    ).withColumn(
        "anomaly_severity", F.when(z > 3.5, "HIGH").when(z > 2.5, "MEDIUM").otherwise("NORMAL")
    )


def anomaly_flags(
    df: DataFrame, series: Series = NODE_SERIES, as_of=None, days: int = 7, last_hours: int = 1
) -> DataFrame:
    """Rows of the last hour scored against the trailing baseline, most deviant first."""
    recent = since(df, series.ts, as_of, last_hours).select(
        series.ts, *series.keys, series.value
    )
    stats = baseline_stats(df, series, as_of, days)
    return severity(join_sized(recent, stats, list(series.keys)), series).orderBy(F.desc("z_score"))
