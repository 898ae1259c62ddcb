"""Row-window features of a stream, corrected when rows come late.

Time is cut into buckets. A batch stores its rows, finds the buckets whose features they change (a row
changes those of the next 168 rows of its key), computes these buckets again from the stored rows
and writes them as a new version. A manifest, written last, names the newest version of every
bucket, so readers see a batch whole or not at all, and features written too early are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxgauge.operators.joins import join_null_safe
from fluxgauge.operators.series import WEEK_ROWS, Chunks, Series
from fluxgauge.session import remove

BUCKET, _HIT = "__period", "__hit"


def bucket_of(ts: Column, unit: str = "hour") -> Column:
    """The name of a time's bucket, in the order of time; rows without a time come first, as in windows."""
    pattern = {"hour": "yyyy-MM-dd-HH", "day": "yyyy-MM-dd"}[unit]
    return F.concat(F.lit("t"), F.coalesce(F.date_format(ts, pattern), F.lit("")))


def changed_buckets(sizes: DataFrame, keys: list[str], lookback: int) -> DataFrame:
    """``(bucket)``: those whose features depend on rows of the buckets marked ``fresh``.

    ``sizes`` has the rows ``n`` per key and bucket. A bucket depends on a fresh one if fewer than
    ``lookback`` rows of the key lie between them.
    """
    order = Window.partitionBy(*keys).orderBy(BUCKET)
    counted = sizes.withColumn("__to", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.when(F.col("fresh"), F.col("__to"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    near = F.col("__to") - F.col("n") - last < lookback
    return counted.withColumn("__near", near).where("fresh OR __near").select(BUCKET).distinct()


def needed_buckets(sizes: DataFrame, changed: DataFrame, keys: list[str], lookback: int) -> DataFrame:
    """``(keys, bucket, hit)``: the changed buckets of every key, and those that hold their history."""
    order = Window.partitionBy(*keys).orderBy(BUCKET)
    marked = sizes.join(changed.withColumn(_HIT, F.lit(True)), BUCKET, "left")
    marked = marked.withColumn(_HIT, F.coalesce(_HIT, F.lit(False)))
    counted = marked.withColumn("__to", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.when(F.col(_HIT), F.col("__to") - F.col("n"))
    following = F.min(start).over(order.rowsBetween(1, Window.unboundedFollowing))
    near = F.coalesce(following - F.col("__to") < lookback, F.lit(False))
    return counted.withColumn("__near", near).where(F.col(_HIT) | F.col("__near")).select(*keys, BUCKET, _HIT)


class History:
    """The stored rows, sizes, features and manifest of one stream below ``path``."""

    def __init__(self, path: str, schema: T.StructType, series: Series, unit: str = "hour", lookback: int = WEEK_ROWS):
        self.path, self.series, self.unit, self.lookback = path, series, unit, lookback
        self.schema = T.StructType([f for f in schema.fields if f.name != BUCKET])
        kept = [f for f in self.schema.fields if f.name in series.keys]
        self.sizes_schema = T.StructType([*kept, T.StructField(BUCKET, T.StringType()), T.StructField("n", T.LongType())])

    def _at(self, *parts) -> str:
        return os.path.join(self.path, *map(str, parts))

    def _read(self, session: SparkSession, kind: str, schema: T.StructType, batch_id: int) -> DataFrame:
        """What this batch and the earlier ones stored; a batch that failed later on left more."""
        known = T.StructType([*schema.fields, T.StructField("batch_id", T.IntegerType())])
        return session.read.schema(known).parquet(self._at(kind)).where(F.col("batch_id") <= batch_id)

    def update(self, batch: DataFrame, batch_id: int, chunks: Chunks, build: Callable) -> None:
        """Store a batch and replace the features it changes. Repeating a batch overwrites its own files."""
        session, keys = batch.sparkSession, list(self.series.keys)
        placed = batch.withColumn(BUCKET, bucket_of(F.col(self.series.ts), self.unit))
        own = self._at("rows", f"batch_id={batch_id}")
        placed.write.mode("overwrite").partitionBy(BUCKET).parquet(own)
        bucketed = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.StringType())])
        stored = session.read.schema(bucketed).parquet(own)
        counts = stored.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(self._at("sizes", f"batch_id={batch_id}"))

        fresh = F.max((F.col("batch_id") == batch_id).cast("int")) == 1
        sizes = self._read(session, "sizes", self.sizes_schema, batch_id)
        sizes = sizes.groupBy(*keys, BUCKET).agg(F.sum("n").alias("n"), fresh.alias("fresh"))
        manifest = self._at("manifest", f"batch_id={batch_id}")
        changed = changed_buckets(sizes, keys, self.lookback)
        work = self._at("work", f"batch_id={batch_id}")
        changed.write.mode("overwrite").parquet(os.path.join(work, "changed"))
        changed = session.read.schema(f"{BUCKET} string").parquet(os.path.join(work, "changed"))
        needed = needed_buckets(sizes, changed, keys, self.lookback)
        rows = self._read(session, "rows", bucketed, batch_id).drop("batch_id")
        # The buckets are as many as there are hours; naming them prunes folders.
        names = [r[0] for r in needed.select(BUCKET).distinct().collect()]
        rows = join_null_safe(rows.where(F.col(BUCKET).isin(names)), needed, [*keys, BUCKET], "inner")
        rows.write.mode("overwrite").parquet(os.path.join(work, "rows"))
        rows = session.read.schema(rows.schema).parquet(os.path.join(work, "rows"))
        built = chunks.run(rows, self.series, build).where(_HIT).drop(_HIT)
        built.write.mode("overwrite").partitionBy(BUCKET).parquet(self._at("features", f"version={batch_id}"))
        changed.write.mode("overwrite").parquet(manifest)
        remove(session, work)


def newest_features(spark: SparkSession, path: str) -> DataFrame:
    """The features of every bucket in the version that the manifest names."""
    manifest = spark.read.schema(f"{BUCKET} string, batch_id int").parquet(os.path.join(path, "manifest"))
    newest = manifest.groupBy(BUCKET).agg(F.max("batch_id").alias("version"))
    features = spark.read.parquet(os.path.join(path, "features"))
    return features.join(newest, [BUCKET, "version"], "left_semi").drop(BUCKET, "version")
