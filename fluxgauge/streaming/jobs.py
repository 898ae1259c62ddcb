"""Streaming sinks, aggregates and features.

Streams carry a zoned ``timestamp`` column, as Spark's watermarks require; results are cast
back to zone-less time.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fluxgauge.operators.anomaly import severity
from fluxgauge.operators.joins import join_sized
from fluxgauge.operators.kpis import add_node_kpis
from fluxgauge.operators.lags import add_lags
from fluxgauge.operators.reports import SNAPSHOT_DIGITS, kpi_measures, rounded
from fluxgauge.operators.rolling import add_ewm, add_moments, add_short_rolling
from fluxgauge.operators.series import NODE_SERIES, Chunks, RowChunks, Series
from fluxgauge.operators.spectral import add_spectral
from fluxgauge.schemas import TRAFFIC_TYPES
from fluxgauge.streaming.closing import closable, close_stream, timely
from fluxgauge.streaming.history import History, newest_features


def start_feature_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    trigger: str | None = "5 seconds",
    fmt: str = "parquet",
) -> StreamingQuery:
    """Append a stream to files every ``trigger``; ``None`` drains what is there and stops."""
    when = {"processingTime": trigger} if trigger else {"availableNow": True}
    return (
        df.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**when)
        .start(path)
    )


def drain(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all available input and read its files back."""
    start_feature_stream(df, path, checkpoint, trigger=None).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drain_closed(
    df: DataFrame, path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], ts: str = "timestamp"
) -> DataFrame:
    """All that ``build`` makes of a stream whose input is complete, the last windows included.

    The stream runs over all available input, is closed by a mark (``closing``) and runs over that.
    """
    marks = os.path.join(checkpoint, "marks")
    out = build(closable(df, marks, ts))
    drain(out, path, os.path.join(checkpoint, "query"))
    close_stream(df.sparkSession, marks, ts)
    return drain(out, path, os.path.join(checkpoint, "query"))


def _start_of(window: str = "window") -> Column:
    return F.col(f"{window}.start").cast("timestamp_ntz")


def kpi_stream(
    df: DataFrame, watermark: str = "2 minutes", digits: bool = True, ts: str = "timestamp"
) -> DataFrame:
    """Minute KPIs of a telemetry stream, emitted when the watermark closes the minute.

    Nodes are counted approximately, as streams cannot count distinct values exactly.
    """
    minutes = timely(df, ts, watermark).groupBy(F.window(ts, "1 minute"))
    measures = minutes.agg(*kpi_measures(F.approx_count_distinct("node_id")))
    out = measures.select(_start_of().alias("minute_ts"), *measures.columns[1:])
    return rounded(out, SNAPSHOT_DIGITS) if digits else out


def hourly_stream(flows: DataFrame, watermark: str = "1 hour", ts: str = "raw_timestamp") -> DataFrame:
    """Bytes per traffic type and mean latency per site and hour of a flow stream."""
    per_type = [
        F.coalesce(
            F.sum(F.when(F.col("traffic_type") == t, F.col("total_bytes"))), F.lit(0.0)
        ).alias(t)
        for t in TRAFFIC_TYPES
    ]
    grouped = timely(flows, ts, watermark).groupBy("site", F.window(ts, "1 hour"))
    table = grouped.agg(*per_type, F.avg("latency_raw").alias("avg_latency_ms"))
    return table.select("site", _start_of().alias("hour"), *TRAFFIC_TYPES, "avg_latency_ms")


def anomaly_stream(df: DataFrame, baseline: DataFrame, series: Series = NODE_SERIES) -> DataFrame:
    """Stream rows scored against a static baseline (``node_id, mu, sigma``), counted before
    it is broadcast."""
    narrow = df.select(series.ts, *series.keys, series.value)
    return severity(join_sized(narrow, baseline, list(series.keys)), series)


def tick_windows(df: DataFrame, series: Series, short_rows: int = 12) -> DataFrame:
    """The window features of the tick table, the same code as in batch."""
    df = add_lags(df, series, (1, 2, 24, 48, 168), compare=False)
    df = add_short_rolling(df, series, short_rows)
    df = add_moments(add_ewm(df, series), series)
    return add_spectral(add_node_kpis(df, series), series)


def features_foreach_batch(
    df: DataFrame,
    path: str,
    checkpoint: str,
    series: Series = NODE_SERIES,
    chunks: Chunks | None = None,
    build=tick_windows,
    trigger: str | None = "5 seconds",
    unit: str = "hour",
) -> StreamingQuery:
    """Row-window features of a stream by running the batch code on what each micro-batch changes.

    Rows may come in any order: features that a late row changes are computed again and replaced
    (``history``). ``unit`` ("hour" or "day") is what is replaced as a whole. Read the result with
    ``read_batches``.
    """
    history = History(path, df.schema, series, unit)
    chunks = chunks or RowChunks()

    def process(batch: DataFrame, batch_id: int) -> None:
        history.update(batch, batch_id, chunks, build)

    when = {"processingTime": trigger} if trigger else {"availableNow": True}
    return (
        df.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**when)
        .start()
    )


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All features written by ``features_foreach_batch``, each in its newest version."""
    return newest_features(spark, path)
