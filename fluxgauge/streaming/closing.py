"""Ending a stream: a mark that moves the watermark past everything held, and rows that came too late.

A watermark follows the newest event, so a stream that has read all its input still holds its last
windows. A closable stream is united with a small stream of marks: rows without data whose time
moves the watermark and which are dropped right behind it. Writing the last mark closes every window.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Tells marks from rows.
MARK = "__mark"
#: Later than any event.
END = "9999-01-01 00:00:00"
#: Earlier than any event.
START = "0001-01-01 00:00:00"


def _marks(spark: SparkSession, ts: str, at: str | None = None) -> DataFrame:
    rows = spark.range(1).select(F.lit(at).cast("timestamp").alias(ts), F.lit(True).alias(MARK))
    return rows if at else rows.limit(0)


def closable(df: DataFrame, folder: str, ts: str = "timestamp") -> DataFrame:
    """The stream with a column that tells marks, and with the marks below ``folder``."""
    spark = df.sparkSession
    none = _marks(spark, ts)
    none.write.mode("append").parquet(folder)
    marks = spark.readStream.schema(none.schema).parquet(folder)
    return df.withColumn(MARK, F.lit(False)).unionByName(marks, allowMissingColumns=True)


def timely(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """The stream under a watermark; marks, if it has any, have moved it and are gone.

    The test for marks reads the event time, as Spark would move one that does not ahead of the
    watermark, which then never saw a mark.
    """
    marked = df.withWatermark(ts, delay)
    if MARK not in df.columns:
        return marked
    never = F.col(ts) < F.lit(START).cast("timestamp")
    return marked.where(~F.col(MARK) | never).drop(MARK)


def close_stream(spark: SparkSession, folder: str, ts: str = "timestamp", at: str = END) -> None:
    """Write a mark at ``at``: whatever ends before it, less the delay, is closed when it is read.

    The default ends the stream for good: every later row is late.
    """
    _marks(spark, ts, at).write.mode("append").parquet(folder)


def late_rows(
    df: DataFrame,
    path: str,
    checkpoint: str,
    delay: str,
    window: str | None = None,
    ts: str = "timestamp",
    trigger: str | None = "5 seconds",
) -> StreamingQuery:
    """Side output: the rows a stream with the same triggers drops as too late.

    A row is late if its ``window`` (or, without one, its time) ended at least ``delay`` before the
    newest event of the batches ahead of its own. Every batch writes its late rows below
    ``path/late`` and the newest event so far below ``path/newest``; repeating it overwrites both.
    """

    def newest(session: SparkSession, below: int) -> DataFrame:
        marks = session.read.schema("newest timestamp, batch_id int").parquet(os.path.join(path, "newest"))
        return marks.where(F.col("batch_id") < below).select(F.max("newest").alias("newest"))

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        here = batch.select(F.max(ts).alias("newest"))
        late = batch.limit(0)
        if batch_id:
            known = newest(session, batch_id)
            end = F.window(ts, window)["end"] if window else F.col(ts)
            late = batch.where(end <= known.scalar() - F.expr(f"INTERVAL '{delay}'"))
            here = here.union(known).select(F.max("newest").alias("newest"))
        late.write.mode("overwrite").parquet(os.path.join(path, "late", f"batch_id={batch_id}"))
        here.write.mode("overwrite").parquet(os.path.join(path, "newest", f"batch_id={batch_id}"))

    when = {"processingTime": trigger} if trigger else {"availableNow": True}
    return df.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(**when).start()
