"""Gap-free key x hour grids and what is usual at each of their hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgauge.functions.clock import earliest, epoch_hours, floor_hour, hours, latest, moment
from fluxgauge.operators.joins import join_sized
from fluxgauge.session import materialize, stored


def hour_spine(keys: DataFrame, start: Column, end: Column, ts: str = "timestamp") -> DataFrame:
    """Every key with every full hour of ``[start, end)``.

    Expands to days and then to hours, so no row ever carries a long array.
    """
    first_day = F.date_trunc("day", start).cast("timestamp_ntz")
    days = F.sequence(first_day, end, hours(24))
    per_day = F.sequence(F.col("__day"), F.col("__day") + hours(23), hours(1))
    at = F.col(ts)
    return (
        keys.withColumn("__day", F.explode(days))
        .withColumn(ts, F.explode(per_day))
        .filter((at >= start) & (at < end))
        .drop("__day")
    )


#: How several values of one hour become one.
COMBINE = ("last", "mean", "sum", "min", "max")

#: Hours of a key that one task fills forward.
FILL_SPAN = 8 * 168


def _combined(columns: dict[str, str], combine: dict[str, str], ts: str) -> list[Column]:
    """One aggregate per column; the last ones share one, so that they come from the same row."""
    unknown = set(combine.values()) - set(COMBINE)
    if unknown:
        raise ValueError(f"no way to combine: {sorted(unknown)}")
    out = []
    last = [c for c in columns if combine.get(c, "last") == "last"]
    if last:
        out.append(F.max(F.when(F.col("__seen"), F.struct(ts, *last))).alias("__last"))
    for c, how in combine.items():
        if c in columns and how != "last":
            value = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[how](c)
            out.append(value.cast(columns[c]).alias(c))
    return out


def densify(
    df: DataFrame,
    keys: tuple[str, ...] = ("site",),
    ts: str = "timestamp",
    start=None,
    end=None,
    fill: dict | None = None,
    forward: tuple[str, ...] = (),
    combine: dict[str, str] | None = None,
) -> DataFrame:
    """All keys x hours of ``[start, end)`` with the observed values, one row each.

    The range defaults to the hours the table covers. Missing hours are NULL except for the
    columns in ``fill`` (column -> value) and in ``forward``, which repeat the last known
    value. Stamps within an hour count for that hour: of several, each column takes what
    ``combine`` says ("last", "mean", "sum", "min" or "max"), by default the last stamp's row, and
    of equal last stamps the largest row. A mean keeps the column's type. Rows without a key are a
    key of their own; rows without a time belong to no hour.

    Spine and rows are united and meet in one aggregate, which also collapses an hour's rows before
    the shuffle. Filling forward splits long series (``fill_forward``).
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in (*keys, ts)}
    low = floor_hour(earliest(df, ts)) if start is None else floor_hour(moment(start))
    high = floor_hour(latest(df, ts)) + hours(1) if end is None else moment(end)
    spine = hour_spine(df.select(*keys).distinct(), low, high, ts).withColumn("__hour", F.col(ts))
    hour = floor_hour(F.col(ts))
    rows = df.withColumn("__hour", hour).filter((hour >= low) & (hour < high))
    both = rows.withColumn("__seen", F.lit(True)).unionByName(
        spine.withColumn("__seen", F.lit(False)), allowMissingColumns=True
    )
    way = combine or {}
    grouped = both.groupBy(*keys, "__hour").agg(*_combined(types, way, ts) or [F.count("*").alias("__n")])
    last = [c for c in types if way.get(c, "last") == "last"]
    full = grouped.withColumns({c: F.col(f"__last.`{c}`") for c in last}) if last else grouped
    full = full.withColumn(ts, F.col("__hour")).select(*df.columns)
    if forward:
        full = fill_forward(full, forward, keys, ts)
    return full.na.fill(fill) if fill else full


def fill_forward(
    df: DataFrame,
    columns: tuple[str, ...],
    keys: tuple[str, ...] = ("site",),
    ts: str = "timestamp",
    span: int = FILL_SPAN,
) -> DataFrame:
    """Missing values of an hourly table replaced by the key's last known one.

    A prefix scan: chunks of ``span`` hours are filled apart, a table of one row per key and chunk
    tells the last value of every chunk, and what that table knows ahead of a chunk fills its
    beginning. No window covers more than a chunk of rows, or the chunks of a key.
    """
    df = df.withColumn("__chunk", F.floor(epoch_hours(F.col(ts)) / span))
    df = stored(df)
    known = {c: F.max(F.when(F.col(c).isNotNull(), F.struct(ts, c))).alias(c) for c in columns}
    ends = df.groupBy(*keys, "__chunk").agg(*known.values())
    ahead = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "__chunk", *[F.last(F.col(c)[c], ignorenulls=True).over(ahead).alias(f"__from_{c}") for c in columns]
    )
    within = Window.partitionBy(*keys, "__chunk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    filled = df.withColumns({c: F.last(c, ignorenulls=True).over(within) for c in columns})
    joined = join_sized(filled, carried, [*keys, "__chunk"], "left")
    out = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__from_{c}")) for c in columns})
    return out.drop("__chunk", *[f"__from_{c}" for c in columns])


def expected_profile(
    hourly: DataFrame,
    values: tuple[str, ...],
    ts: str = "hour",
    start=None,
    end=None,
    key: str = "site",
) -> DataFrame:
    """What is usual at every hour of ``[start, end)``, by default the hours the table covers.

    ``expected_{value}`` is the mean over all observed hours of the same key and hour of week, and
    ``observed_hours`` their number; where there is none, the mean of the key's hour of day
    stands in and the number is 0. Both means come from one aggregate over the table: a row per key and hour of
    week, whose sums and counts also give the hours of day.
    """
    hourly = stored(hourly)
    low = floor_hour(earliest(hourly, ts)) if start is None else floor_hour(moment(start))
    high = floor_hour(latest(hourly, ts)) + hours(1) if end is None else moment(end)
    at = F.col(ts)
    weekly = materialize(
        hourly.filter(at.isNotNull())
        .groupBy(key, F.weekday(ts).alias("__dow"), F.hour(ts).alias("__hod"))
        .agg(
            F.count("*").alias("observed_hours"),
            *[F.sum(v).alias(f"__sum_{v}") for v in values],
            *[F.count(v).alias(f"__n_{v}") for v in values],
        )
    )
    daily = weekly.groupBy(key, "__hod").agg(
        *[F.try_divide(F.sum(f"__sum_{v}"), F.sum(f"__n_{v}")).alias(f"__daily_{v}") for v in values]
    )
    grid = hour_spine(weekly.select(key).distinct(), low, high, ts).withColumns(
        {"__dow": F.weekday(ts), "__hod": F.hour(ts)}
    )
    joined = join_sized(grid, weekly, [key, "__dow", "__hod"], "left")
    joined = join_sized(joined, daily, [key, "__hod"], "left")
    usual = [
        F.coalesce(F.try_divide(F.col(f"__sum_{v}"), F.col(f"__n_{v}")), F.col(f"__daily_{v}")).alias(f"expected_{v}")
        for v in values
    ]
    return joined.select(key, ts, *usual, F.coalesce("observed_hours", F.lit(0)).alias("observed_hours"))
