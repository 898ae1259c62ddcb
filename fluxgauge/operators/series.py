"""Time series as partitions of a table, and ways to split long ones.

A window over ``PARTITION BY site`` puts each site into one task. The chunk classes below
spread one series over many tasks with the same result: every row goes to its own chunk, and
rows at the end of a chunk are also handed to the following one as history. Windows then run
per (key, chunk) and only a row's copy in its own chunk is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from fluxgauge.functions.clock import epoch_hours, epoch_micros
from fluxgauge.operators.joins import join_null_safe, join_sized
from fluxgauge.session import materialize

#: The longest look-back of any feature: one week of hours.
WEEK_ROWS = 168

_CHUNK, _HOME = "__chunk", "__home"


@dataclass(frozen=True)
class Series:
    """Which columns make a time series: key, time, value and tie-breakers of the order."""

    keys: tuple[str, ...] = ("site",)
    ts: str = "timestamp"
    value: str = "total_gbps"
    ties: tuple[str, ...] = ()

    @property
    def x(self) -> Column:
        return F.col(self.value)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.ts, *self.ties)

    def frame(self, rows: int) -> WindowSpec:
        """The last ``rows`` rows including the current one."""
        return self.window().rowsBetween(-(rows - 1), 0)

    def before(self, rows: int) -> WindowSpec:
        """The ``rows`` rows ahead of the current one."""
        return self.window().rowsBetween(-rows, -1)

    def lag(self, rows: int, column: str | None = None) -> Column:
        return F.lag(column or self.value, rows).over(self.window())

    def keyed_by(self, *keys: str) -> "Series":
        return replace(self, keys=keys)


SITE_SERIES = Series()
NODE_SERIES = Series(keys=("node_id",), value="throughput_gbps")

Build = Callable[[DataFrame, Series], DataFrame]


@dataclass(frozen=True)
class WholeSeries:
    """No split: one task per key. For tables known to be small per key."""

    def run(self, df: DataFrame, series: Series, build: Build) -> DataFrame:
        return build(df, series)


@dataclass(frozen=True)
class TimeChunks:
    """Split a gap-free hourly series by time. Needs no pass over the data.

    Exact when each key has one row per hour without gaps (see ``densify``), so that
    ``lookback`` rows are ``lookback`` hours. Rows copied: ``lookback / span``.
    """

    span: int = 8 * WEEK_ROWS
    lookback: int = WEEK_ROWS

    def run(self, df: DataFrame, series: Series, build: Build) -> DataFrame:
        if self.lookback > self.span:
            raise ValueError("span must cover the look-back")
        at = epoch_hours(F.col(series.ts))
        home = F.floor(at / self.span)
        in_tail = F.pmod(at, F.lit(self.span)) >= self.span - self.lookback
        targets = F.when(in_tail, F.array(home, home + 1)).otherwise(F.array(home))
        return _build_chunks(df.withColumn(_HOME, home), targets, series, build)


@dataclass(frozen=True)
class RowChunks:
    """Split any series into runs of about ``rows`` rows, exact also with gaps.

    One counting pass gives rows per (key, time bucket). If no key has more than ``rows``
    rows, the windows run per key as they are. Otherwise running totals of these counts
    place each bucket in a chunk and tell which later chunks start less than ``lookback``
    rows after it. A bucket with more than ``rows`` rows is cut a thousandfold finer, again
    if need be, so only rows of one key and one instant must stay together. The bucket table
    has one row per key and bucket, however many rows a bucket holds, and is broadcast only
    if small.
    """

    rows: int = 50_000
    lookback: int = WEEK_ROWS
    bucket_seconds: int = 3600

    def run(self, df: DataFrame, series: Series, build: Build) -> DataFrame:
        if self.lookback > self.rows:
            raise ValueError("rows must cover the look-back")
        keys = list(series.keys)
        at = epoch_micros(F.col(series.ts))
        bucketed = df.withColumn("__bucket", at - F.pmod(at, F.lit(self._width)))
        sizes = materialize(bucketed.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n")))
        per_key = sizes.groupBy(*keys).agg(F.sum("__n").alias("__rows"))
        if not per_key.filter(F.col("__rows") > self.rows).limit(1).count():
            return build(df, series)
        bucketed, sizes = self._split_crowded(bucketed, sizes, keys, at)
        placed = join_sized(bucketed, self._targets(sizes, keys), [*keys, "__bucket"])
        return _build_chunks(placed, F.col("__targets"), series, build, ("__bucket", "__targets"))

    @property
    def _width(self) -> int:
        return self.bucket_seconds * 1_000_000

    def _split_crowded(
        self, df: DataFrame, sizes: DataFrame, keys: list[str], at: Column
    ) -> tuple[DataFrame, DataFrame]:
        """Finer buckets where one holds too many rows; a bucket is known by its first instant."""
        width = self._width
        crowded = F.col("__n") > self.rows
        while width > 1 and sizes.filter(crowded).limit(1).count():
            width = max(width // 1000, 1)
            hot = sizes.filter(crowded).select(*keys, "__bucket", F.lit(True).alias("__hot"))
            marked = join_sized(df, hot, [*keys, "__bucket"], "left").withColumn(
                "__bucket",
                F.when(F.col("__hot"), at - F.pmod(at, F.lit(width))).otherwise(F.col("__bucket")),
            )
            finer = marked.filter("__hot").groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
            sizes = materialize(sizes.filter(~crowded).unionByName(finer))
            df = marked.drop("__hot")
        return df, sizes

    def _targets(self, sizes: DataFrame, keys: list[str]) -> DataFrame:
        in_order = Window.partitionBy(*keys).orderBy("__bucket")
        earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
        sized = (
            sizes.withColumn("__from", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
            .withColumn("__to", F.col("__from") + F.col("__n"))
            .withColumn(_HOME, F.floor(F.col("__from") / self.rows))
        )
        by_chunk = Window.partitionBy(*keys).orderBy(_HOME)
        entry = F.struct("__start", _HOME)
        # Two chunks in a row span more than ``rows`` rows, so at most two can start within
        # the look-back of a bucket's end.
        starts = (
            sized.groupBy(*keys, _HOME)
            .agg(F.min("__from").alias("__start"))
            .withColumn("__next", F.lead(entry, 1).over(by_chunk))
            .withColumn("__after", F.lead(entry, 2).over(by_chunk))
            .drop("__start")
        )
        reach = F.col("__to") + self.lookback
        wanted = [
            F.when(F.col(f"{c}.__start") < reach, F.col(f"{c}.{_HOME}"))
            for c in ("__next", "__after")
        ]
        return join_null_safe(sized, starts, [*keys, _HOME], "inner").select(
            *keys,
            "__bucket",
            _HOME,
            F.array_compact(F.array(F.col(_HOME), *wanted)).alias("__targets"),
        )


def _build_chunks(
    df: DataFrame, targets: Column, series: Series, build: Build, extra: tuple[str, ...] = ()
) -> DataFrame:
    copies = df.withColumn(_CHUNK, F.explode(F.coalesce(targets, F.array(F.lit(None).cast("bigint")))))
    built = build(copies.drop(*extra), series.keyed_by(*series.keys, _CHUNK))
    return built.filter(F.col(_CHUNK).eqNullSafe(F.col(_HOME))).drop(_CHUNK, _HOME)


Chunks = WholeSeries | TimeChunks | RowChunks


def dedupe_series(df: DataFrame, series: Series = SITE_SERIES) -> DataFrame:
    """One row per (key, time): the smallest by all other columns, NULLs first.

    An aggregate, not a ranking window: copies collapse before the shuffle.
    """
    keys = [*series.keys, series.ts]
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row"))
    return kept.select(*keys, "__row.*").select(*df.columns)
