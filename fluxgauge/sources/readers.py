"""Batch and streaming sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxgauge.functions.clock import hours, moment
from fluxgauge.schemas import NODE
from fluxgauge.sources.flow_files import read_flow_files


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A table of a fixed schema (``HOURLY`` or ``NODE``); nothing is inferred."""
    return spark.read.schema(schema).format(fmt).load(path)


def conformance(df: DataFrame, schema: T.StructType) -> DataFrame:
    """How far a table keeps to a fixed schema: one row per column of either.

    ``expected`` and ``found`` are types (NULL: not there), ``nulls`` counts missing values and
    ``violations`` values that the expected type cannot hold. One aggregate over the table; names
    compare as Spark compares them, without case.
    """
    here = {f.name.lower(): f for f in df.schema.fields}
    wanted = {f.name.lower() for f in schema.fields}
    rows = []
    for f in schema.fields:
        found = here.get(f.name.lower())
        value = F.col(f"`{found.name}`") if found else None
        bad = value.isNotNull() & value.try_cast(f.dataType).isNull() if found else None
        rows.append((f.name, f.dataType, found, value, bad))
    rows += [(f.name, None, f, F.col(f"`{f.name}`"), None) for f in df.schema.fields if f.name.lower() not in wanted]

    def text(kind) -> Column:
        return F.lit(kind.simpleString() if kind is not None else None).cast("string")

    lines = [
        F.struct(
            F.lit(name).alias("column"),
            text(kind).alias("expected"),
            text(found.dataType if found else None).alias("found"),
            (F.count_if(value.isNull()) if found else F.count(F.lit(1))).alias("nulls"),
            (F.lit(0).cast("long") if bad is None else F.count_if(bad)).alias("violations"),
        )
        for name, kind, found, value, bad in rows
    ]
    return df.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` with its types; what a type cannot hold, and columns that are not
    there, are NULL (``conformance`` counts them)."""
    here = {f.name.lower(): f.name for f in df.schema.fields}
    return df.select(
        *[
            (F.col(f"`{here[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in here else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def read_ticks(
    spark: SparkSession,
    path: str,
    start,
    end,
    nodes: list[str] | None = None,
    lookback_days: int = 0,
) -> DataFrame:
    """Ticks of ``[start, end)``, and of the days ahead that their history needs, from a table that
    ``write_features`` laid out by ``node_id`` and ``date``: both filters prune folders."""
    low, high = moment(start) - hours(24 * lookback_days), moment(end)
    ticks = spark.read.parquet(path)
    days = F.col("date").between(F.to_date(low), F.to_date(high))
    at = F.col("timestamp")
    rows = ticks.filter(days & (at >= low) & (at < high))
    return rows if nodes is None else rows.filter(F.col("node_id").isin(*nodes))


def read_hourly(
    spark: SparkSession, path: str, date: str | dt.date, lookback_days: int = 7
) -> DataFrame:
    """Rows of ``date`` and of the days its look-back needs.

    ``date`` is a column or a partition of the table; either way the filter reaches the scan.
    """
    day = date if isinstance(date, dt.date) else dt.date.fromisoformat(date)
    first = day - dt.timedelta(days=lookback_days)
    return spark.read.parquet(path).filter(F.col("date").between(F.lit(first), F.lit(day)))


def read_flows(
    spark: SparkSession,
    path: str | list[str],
    limit: int | None = None,
    encoding: str | None = None,
    rejects: Observation | None = None,
) -> DataFrame:
    """Flow CSV with header, all columns text under normalised names, whatever their order per file.

    Files that are not UTF-8 are read as Latin-1 unless ``encoding`` is given; lines with too many
    fields are left out and counted by ``rejects`` (``flow_files``). ``limit`` samples the first rows;
    by default all rows are read.
    """
    flows = read_flow_files(spark, path, encoding, rejects)
    return flows if limit is None else flows.limit(limit)


def parse_telemetry(raw: DataFrame, schema: T.StructType = NODE, payload: str = "value") -> DataFrame:
    """JSON payloads to typed columns. Event time is zoned, as watermarks require."""
    fields = [
        T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType)
        for f in schema.fields
    ]
    parsed = F.from_json(F.col(payload).cast("string"), T.StructType(fields))
    return raw.select(parsed.alias("data")).select("data.*")


def read_telemetry_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType = NODE,
    fmt: str = "text",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """JSON telemetry as an unbounded table.

    ``fmt="text"`` reads files of JSON lines below the path ``source``; for ``"kafka"``
    ``source`` is the topic and the servers go to ``options`` (needs the connector package).
    """
    reader = spark.readStream.format(fmt).options(**(options or {}))
    raw = reader.option("subscribe", source).load() if fmt == "kafka" else reader.load(source)
    return parse_telemetry(raw, schema)


def register_stage(df: DataFrame, name: str) -> DataFrame:
    """Name an intermediate table for SQL."""
    df.createOrReplaceTempView(name)
    return df
