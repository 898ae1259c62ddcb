"""Cleaning of raw flow records whose column names and types are not fixed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxgauge.functions.clock import floor_hour, moment
from fluxgauge.functions.numeric import to_nonneg
from fluxgauge.functions.protocol import DEFAULT_TYPE, with_traffic_type
from fluxgauge.operators.joins import join_sized
from fluxgauge.operators.timestamps import read_times, time_column
from fluxgauge.schemas import SITE_CAPACITY, SITE_WEIGHTS
from fluxgauge.session import materialize

# Names a time column goes by, and candidate names per role, best first.
TIMESTAMP_NAMES = (
    "timestamp", "flow_start", "flow_starttime", "date", "time", "datetime", "start_time",
    "starttime", "firstseen",
)
ROLE_NAMES = {
    "bytes_fwd": (
        "totlen_fwd_pkts", "flow_byts_s", "total_fwd_bytes", "tot_fwd_pkts",
        "total_length_of_fwd_packets",
    ),
    "bytes_bwd": ("totlen_bwd_pkts", "total_bwd_bytes", "tot_bwd_pkts"),
    "latency": ("fwd_iat_mean", "flow_iat_mean", "bwd_iat_mean", "idle_mean"),
    "protocol": ("protocolname", "protocol_name", "label", "application"),
    "duration": ("flow_duration", "duration"),
}

# What a missing column counts as.
DEFAULT_BYTES_FWD = 1000.0
DEFAULT_BWD_SHARE = 0.3
DEFAULT_LATENCY = 10.0

DAY_FIRST_FORMATS = (
    "d/M/yyyy H:m[:s][.SSSSSS]",
    "d-M-yyyy H:m[:s][.SSSSSS]",
    "yyyy-M-d H:m[:s][.SSSSSS]",
    "yyyy/M/d H:m[:s][.SSSSSS]",
    "yyyy-M-d'T'H:m[:s][.SSSSSS]",
    "d/M/yyyy",
    "d-M-yyyy",
    "yyyy-M-d",
    "yyyy/M/d",
)


def normalize_name(name: str) -> str:
    return name.strip().replace(" ", "_").replace(".", "_").lower()


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trimmed, lower-case names with ``_`` for blanks and dots."""
    return df.toDF(*[normalize_name(c) for c in df.columns])


def resolve_column(df: DataFrame, candidates) -> str | None:
    """The first candidate the table has: a schema lookup."""
    present = set(df.columns)
    return next((c for c in candidates if c in present), None)


_WIDTHS = {"yyyy": r"\d{4}", "SSSSSS": r"\d{1,6}", "'T'": "T", "[": "(", "]": ")?"}


def shape_of(fmt: str) -> str:
    """A regular expression for texts that may have the given time format."""
    tokens = re.findall(r"'T'|yyyy|SSSSSS|[A-Za-z]+|.", fmt)
    return "^" + "".join(
        _WIDTHS.get(t) or (r"\d{1,2}" if t.isalpha() else re.escape(t)) for t in tokens
    ) + "$"


def day_first(value: Column, formats=DAY_FIRST_FORMATS) -> Column:
    """A time read by the first format that fits, else NULL.

    Only texts of the right shape are tried, as every failed attempt costs an exception.
    """
    text = F.trim(value.cast("string"))
    tries = [F.when(text.rlike(shape_of(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


def detect_timestamp(df: DataFrame) -> str | None:
    """The time column: by name or type, else by the look of all its values (``time_column``)."""
    return time_column(df, TIMESTAMP_NAMES)


def parse_timestamp(
    df: DataFrame, column: str, formats: tuple[str, ...] | None = None, rejects: Observation | None = None
) -> DataFrame:
    """``raw_timestamp`` instead of ``column``; rows whose time does not parse are dropped.

    Without ``formats`` texts are read by ``with_time``, whatever mix of shapes they have; ``rejects``
    then counts the rows dropped.
    """
    if formats is None:
        return read_times(df, column, rejects)
    return (
        df.withColumn(column, day_first(F.col(f"`{column}`"), formats))
        .withColumnRenamed(column, "raw_timestamp")
        .dropna(subset=["raw_timestamp"])
    )


def synthesize_timestamp(df: DataFrame, start="2024-01-01 00:00:00") -> DataFrame:
    """``raw_timestamp`` one second apart in row order, for tables without a time column.

    Numbers rows densely without one ordering task: rows keep their partition-wise number,
    partitions get offsets from their counts (one row per partition). The numbered rows are
    stored first, as a re-planned scan may cut partitions otherwise.
    """
    marked = materialize(
        df.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()})
    )
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .drop("__n")
    )
    position = F.col("__id") - F.col("__first") + F.col("__offset")
    return (
        join_sized(marked, offsets, "__part")
        .withColumn(
            "raw_timestamp",
            (moment(start).cast("timestamp") + F.make_dt_interval(secs=position.cast("decimal(18,6)"))).cast("timestamp_ntz"),
        )
        .drop("__part", "__id", "__first", "__offset")
    )


def add_flow_metrics(df: DataFrame) -> DataFrame:
    """``protocol``, ``bytes_fwd``, ``bytes_bwd``, ``total_bytes``, ``latency_raw`` and
    ``traffic_type`` from whichever role columns the table has."""
    role = {name: resolve_column(df, names) for name, names in ROLE_NAMES.items()}

    def measured(column: str) -> Column:
        return to_nonneg(F.col(column), isinstance(df.schema[column].dataType, T.StringType))

    def number(name: str, default: Column) -> Column:
        return measured(role[name]) if role[name] else default

    forward = number("bytes_fwd", F.lit(DEFAULT_BYTES_FWD))
    backward = number("bytes_bwd", F.col("bytes_fwd") * DEFAULT_BWD_SHARE)
    latency = measured(role["latency"]) / 1000 if role["latency"] else F.lit(DEFAULT_LATENCY)
    protocol = F.col(role["protocol"]) if role["protocol"] else F.lit(None).cast("string")
    if role["protocol"]:
        df = with_traffic_type(df, protocol)
    else:
        df = df.withColumn("traffic_type", F.lit(DEFAULT_TYPE))
    return (
        df.withColumn("bytes_fwd", forward)
        .withColumn("bytes_bwd", backward)
        .withColumns(
            {
                "total_bytes": F.col("bytes_fwd") + F.col("bytes_bwd"),
                "latency_raw": latency,
                "protocol": protocol.cast("string"),
            }
        )
    )


def assign_site(
    df: DataFrame,
    sites=tuple(SITE_CAPACITY),
    weights=SITE_WEIGHTS,
    seed: int = 42,
    key: tuple[str, ...] | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """``site`` drawn by weight, the same on every run.

    A row's bucket of 10,000 is an MD5 of ``seed`` and ``key`` (default: all columns), or is
    given as ``bucket``; cumulative weights cut the buckets into sites.
    """
    if len(sites) != len(weights):
        raise ValueError("one weight per site")
    if bucket is None:
        columns = [F.col(f"`{c}`").cast("string") for c in (key or df.columns)]
        digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *columns)), 1, 8)
        bucket = F.conv(digits, 16, 10).cast("long") % 10_000
    total, reached = sum(weights), 0
    chain = None
    for site, weight in zip(sites[:-1], weights[:-1]):
        reached += weight
        below = bucket < int(round(reached * 10_000 / total))
        chain = F.when(below, site) if chain is None else chain.when(below, site)
    return df.withColumn("site", F.lit(sites[-1]) if chain is None else chain.otherwise(sites[-1]))


def clean_flows(
    raw: DataFrame,
    formats: tuple[str, ...] | None = None,
    bucket: Column | None = None,
    key: tuple[str, ...] | None = None,
    seed: int = 42,
    ts_column: str | None = None,
    rejects: Observation | None = None,
) -> DataFrame:
    """Raw flows to the ``FLOW`` schema. Projections and one filter when the table has a time
    column, and a narrow count of that column where its texts leave the order of day and month
    open; ``bucket`` and ``ts_column`` refer to normalised column names. Without a time column
    rows get stamps by their order; ``rejects`` counts the rows without a readable time."""
    df = normalize_columns(raw)
    column = ts_column or detect_timestamp(df)
    df = parse_timestamp(df, column, formats, rejects) if column else synthesize_timestamp(df)
    df = assign_site(df, key=key, bucket=bucket, seed=seed)
    return add_flow_metrics(df).withColumn("hour", floor_hour(F.col("raw_timestamp"))).select(
        "raw_timestamp",
        "protocol",
        "bytes_fwd",
        "bytes_bwd",
        "total_bytes",
        "latency_raw",
        "traffic_type",
        "site",
        "hour",
    )
