"""Joins against dimensions and small statistics tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgauge.functions.clock import epoch_hours, floor_hour, hours, latest
from fluxgauge.functions.numeric import all_of, flag
from fluxgauge.schemas import DEFAULT_CAPACITY, holiday_dimension, site_dimension
from fluxgauge.session import stored


def join_sized(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Equi-join with a table whose size is known before ``big`` is planned.

    ``small`` (an aggregate, as a rule) is stored first. The optimiser then broadcasts it if
    its stored size is below ``spark.sql.autoBroadcastJoinThreshold``, without a shuffle of
    ``big``; otherwise the join is shuffled and adaptive execution splits skewed keys. Keys
    compare NULL-safely, so no row of ``big`` is lost.
    """
    names = [on] if isinstance(on, str) else list(on)
    return join_null_safe(big, stored(small), names, how)


def join_null_safe(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """``left`` columns plus the columns of ``right`` that are not keys."""
    renamed = right.withColumnsRenamed({n: f"__r_{n}" for n in names})
    condition = all_of([F.col(n).eqNullSafe(F.col(f"__r_{n}")) for n in names])
    return left.join(renamed, condition, how).drop(*[f"__r_{n}" for n in names])


def with_node_stats(df: DataFrame, stats: DataFrame, key: str = "node_id") -> DataFrame:
    """Rows with the statistics of their node (inner, as every row's node has statistics)."""
    return join_sized(df, stats, key)


def with_latency(pivot: DataFrame, latency: DataFrame, keys=("site", "hour")) -> DataFrame:
    """Hourly table with mean latency; both sides have one row per (site, hour)."""
    return pivot.join(latency, list(keys), "left")


def with_capacity(
    df: DataFrame, sites: DataFrame | None = None, default: int = DEFAULT_CAPACITY
) -> DataFrame:
    """Adds ``capacity_gbps``; sites absent from the dimension get ``default``.

    The built-in dimension has five rows and is broadcast; one handed in is sized first.
    """
    own = sites is None
    dim = (site_dimension(df.sparkSession) if own else sites).select("site", "capacity_gbps")
    df = df.drop("capacity_gbps")
    joined = df.join(F.broadcast(dim), "site", "left") if own else join_sized(df, dim, "site", "left")
    return joined.withColumn("capacity_gbps", F.coalesce("capacity_gbps", F.lit(default)))


def with_holidays(
    df: DataFrame, ts: str = "timestamp", holidays: DataFrame | None = None
) -> DataFrame:
    """Adds ``is_holiday`` by joining the holiday dimension (column ``holiday``, a date)."""
    own = holidays is None
    dim = holiday_dimension(df.sparkSession) if own else holidays.select("holiday").distinct()
    dim = dim.select(F.col("holiday").alias("__day"), F.lit(1).alias("is_holiday"))
    dated = df.withColumn("__day", F.to_date(ts))
    if own:
        joined = dated.join(F.broadcast(dim), "__day", "left")
    else:
        joined = join_sized(dated, dim, "__day", "left")
    return joined.withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0))).drop("__day")


def merge_intervals(events: DataFrame, keys: list[str]) -> DataFrame:
    """Union of overlapping or touching half-open intervals ``[start, end)`` per key.

    One window per key: for short lists, or keys that bound them (``interval_index``).
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") > F.col("__reached"), F.lit(True)).cast("int")
    return (
        events.filter(F.col("end") > F.col("start"))
        .withColumn("__reached", reached)
        .withColumn("__island", F.sum(opens).over(order))
        .groupBy(*keys, "__island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("__island")
    )


def interval_index(events: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Half-open intervals ``[start, end)`` as whole days and, at their edges, pieces within an hour.

    ``(keys, __day)`` with each wholly covered day once, and ``(keys, __hour, start, end)`` with
    disjoint pieces, none longer than its hour. An interval costs one row per day and at most 48
    rows for its edges. Overlaps are merged within a day or an hour only, never over a whole key.
    """
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    first = F.when(F.col("start") == day("start"), F.col("start")).otherwise(day("start") + hours(24))
    spans = (
        events.filter(F.col("end") > F.col("start"))
        .select(*keys, "start", "end")
        .withColumns({"__first": first, "__last": day("end")})
    )
    whole = F.when(
        F.col("__first") < F.col("__last"),
        F.sequence(F.col("__first"), F.col("__last") - hours(24), hours(24)),
    )
    days = spans.select(*keys, F.explode(whole).alias("__day")).distinct()

    inside = F.col("__first") > F.col("__last")
    edges = F.array(
        F.struct(F.col("start").alias("__a"), F.when(inside, F.col("end")).otherwise(F.col("__first")).alias("__b")),
        F.struct(F.when(inside, F.col("end")).otherwise(F.col("__last")).alias("__a"), F.col("end").alias("__b")),
    )
    edge = spans.select(*keys, F.inline(edges)).filter("__a < __b")
    last_hour = floor_hour(F.col("__b") - F.expr("INTERVAL '0.000001' SECOND"))
    hourly = edge.withColumn("__at", F.explode(F.sequence(floor_hour(F.col("__a")), last_hour, hours(1))))
    clipped = hourly.select(
        *keys,
        epoch_hours(F.col("__at")).alias("__hour"),
        F.greatest("__a", "__at").alias("start"),
        F.least(F.col("__b"), F.col("__at") + hours(1)).alias("end"),
    )
    # Of pieces with one beginning the longest covers the others, before any window sees them.
    longest = clipped.groupBy(*keys, "__hour", "start").agg(F.max("end").alias("end"))
    return days, merge_intervals(longest, [*keys, "__hour"])


def event_flags(
    df: DataFrame,
    events: DataFrame | None = None,
    kinds: dict[str, str] | None = None,
    key: str = "node_id",
    ts: str = "timestamp",
) -> DataFrame:
    """0/1 columns telling whether an announced event covers the row's time.

    ``events`` has ``(key, start, end, kind)``, half-open; ``kinds`` maps kind to column. An event
    without an end still goes on: it covers every later row. Without events the columns are 0.

    The range join is an equi-join in two resolutions (``interval_index``): a row meets its day, if
    an event covers all of it, and else the disjoint pieces of its hour, of which one at most fits.
    """
    kinds = kinds or {"geo": "geo_event_flag", "maintenance": "maintenance_flag"}
    if events is None:
        return df.withColumns({name: F.lit(0) for name in kinds.values()})
    now = latest(df, ts) + hours(1)
    events = events.filter(F.col("kind").isin(*kinds)).withColumn("end", F.coalesce("end", now))
    days, pieces = interval_index(events, [key, "kind"])
    df = df.withColumns({"__hour": epoch_hours(F.col(ts)), "__day": F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")})
    for kind, name in kinds.items():
        day = days.filter(F.col("kind") == kind).select(F.col(key).alias("__key"), F.col("__day").alias("__on"))
        piece = pieces.filter(F.col("kind") == kind).select(
            F.col(key).alias("__owner"),
            F.col("__hour").alias("__at"),
            F.col("start").alias("__start"),
            F.col("end").alias("__end"),
        )
        covered: Column = (
            (F.col(key) == F.col("__owner"))
            & (F.col("__hour") == F.col("__at"))
            & (F.col(ts) >= F.col("__start"))
            & (F.col(ts) < F.col("__end"))
        )
        df = (
            df.join(day, (F.col(key) == F.col("__key")) & (F.col("__day") == F.col("__on")), "left")
            .join(piece, covered, "left")
            .withColumn(name, flag(F.col("__key").isNotNull() | F.col("__owner").isNotNull()))
            .drop("__key", "__on", "__owner", "__at", "__start", "__end")
        )
    return df.drop("__hour", "__day")
