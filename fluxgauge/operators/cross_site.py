"""Signals that compare sites within the same hour.

Two ways with the same result. ``spread=True`` never puts an hour into one task: hour
statistics are partial aggregates joined back, and ranks come from counts per distinct value,
accumulated within narrow value bands and then over the bands, so neither a crowded hour nor
a value shared by many sites ends up in one group. ``spread=False`` is one window over the
hour: a single shuffle, right where the number of sites is known to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgauge.functions.clock import floor_hour
from fluxgauge.functions.numeric import ratio
from fluxgauge.operators.joins import join_null_safe, join_sized
from fluxgauge.operators.series import SITE_SERIES, Series

_USED = "utilization_pct"


def hour_stats(df: DataFrame, hour: str = "__hour", value: str = _USED) -> DataFrame:
    """Sum, count, mean and sample deviation per hour."""
    return df.groupBy(hour).agg(
        F.sum(value).alias("__sum"),
        F.count(value).alias("__count"),
        F.avg(value).alias("__mean"),
        F.stddev_samp(value).alias("__std"),
    )


def value_ranks(
    df: DataFrame, hour: str = "__hour", value: str = _USED, bands: int = 128, top: float = 100.0
) -> DataFrame:
    """Rank of each distinct value within its hour, highest first, NULL last.

    A band is a slice of ``[0, top]``; what lies outside goes to the outermost bands.
    """
    v = F.col(value)
    slice_of = F.floor(v * (bands / top))
    band = F.when(v.isNull(), -1).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(bands), slice_of))
    )
    counts = df.groupBy(hour, value).agg(F.count(F.lit(1)).alias("__n")).withColumn("__band", band)
    ahead_in_band = (
        Window.partitionBy(hour, "__band")
        .orderBy(F.desc_nulls_last(value))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ahead_by_band = (
        Window.partitionBy(hour)
        .orderBy(F.desc("__band"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    above = (
        counts.groupBy(hour, "__band")
        .agg(F.sum("__n").alias("__in_band"))
        .withColumn("__above", F.coalesce(F.sum("__in_band").over(ahead_by_band), F.lit(0)))
        .drop("__in_band")
    )
    within = counts.withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead_in_band), F.lit(0)))
    return join_null_safe(within, above, [hour, "__band"], "inner").select(
        hour,
        value,
        (F.col("__above") + F.col("__ahead") + 1).cast("int").alias("site_rank_current_hour"),
    )


def add_cross_site(
    df: DataFrame, ts: str = "timestamp", spread: bool = True, others: bool = False
) -> DataFrame:
    """``site_rank_current_hour``, ``site_relative_to_avg`` and ``cross_site_stddev``; with
    ``others`` also ``mean_of_others``, the hour's mean utilisation of all other sites.

    With ``spread``, ``df`` is read three times (twice for two columns only), so hand in a
    stored table rather than a long plan.
    """
    if spread:
        table = df.withColumn("__hour", floor_hour(F.col(ts)))
        narrow = table.select("__hour", _USED)
        ranked = join_null_safe(table, value_ranks(narrow), ["__hour", _USED], "inner")
        joined = join_sized(ranked, hour_stats(narrow), "__hour")
    else:
        hour = Window.partitionBy("__hour")
        joined = df.withColumn("__hour", floor_hour(F.col(ts))).withColumns(
            {
                "site_rank_current_hour": F.rank().over(hour.orderBy(F.desc_nulls_last(_USED))),
                "__sum": F.sum(_USED).over(hour),
                "__count": F.count(_USED).over(hour),
                "__mean": F.avg(_USED).over(hour),
                "__std": F.stddev_samp(_USED).over(hour),
            }
        )
    signals = {
        "site_relative_to_avg": ratio(F.col(_USED), F.col("__mean")),
        "cross_site_stddev": F.col("__std"),
    }
    if others:
        signals["mean_of_others"] = _mean_of_others()
    return joined.withColumns(signals).drop("__hour", *_STATS)


_STATS = ("__sum", "__count", "__mean", "__std")

#: A deviation of up to this part of the mean size is rounding.
_STEADY = 1e-9


def _mean_of_others() -> Column:
    own = F.coalesce(F.col(_USED), F.lit(0.0))
    count = F.col("__count") - F.when(F.col(_USED).isNull(), 0).otherwise(1)
    return ratio(F.col("__sum") - own, count)


def add_mean_of_others(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """``mean_of_others`` alone."""
    table = df.withColumn("__hour", floor_hour(F.col(ts)))
    joined = join_sized(table, hour_stats(table.select("__hour", _USED)), "__hour")
    return joined.withColumn("mean_of_others", _mean_of_others()).drop("__hour", *_STATS)


def add_correlation(df: DataFrame, series: Series = SITE_SERIES, rows: int = 24) -> DataFrame:
    """``cross_site_correlation_index``: rolling Pearson correlation of a site's utilisation
    with the mean of the others; NULL where either is constant. Needs ``mean_of_others``.

    Constant up to rounding, that is: a mean of others is a sum less the own value, which leaves
    noise in the last digits, and noise correlates with anything.
    Written out from its parts, as ``corr`` itself raises on a constant frame in ANSI mode.
    """
    frame = series.frame(rows)
    mine = F.when(F.col("mean_of_others").isNotNull(), F.col(_USED))
    other = F.when(F.col(_USED).isNotNull(), F.col("mean_of_others"))
    spread = F.stddev_pop(mine).over(frame) * F.stddev_pop(other).over(frame)

    def varies(x: Column) -> Column:
        return F.stddev_pop(x).over(frame) > _STEADY * F.avg(F.abs(x)).over(frame)

    return df.withColumn(
        "cross_site_correlation_index",
        F.when(varies(mine) & varies(other), ratio(F.covar_pop(mine, other).over(frame), spread)),
    )
