"""Lag and rolling features of a stream by keyed state, in event-time order."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from fluxgauge.operators.rolling import EWM_DIVISOR, EWM_TERMS
from fluxgauge.operators.series import NODE_SERIES, WEEK_ROWS, Series
from fluxgauge.streaming.closing import timely

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store ``transformWithState`` needs, for queries started inside the block."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


_LAGS = (1, 2, 24, 48, 168)
_COLUMNS = (
    *[f"lag_{n}h" for n in _LAGS],
    "diff_1",
    "diff_24",
    "rolling_mean_6h",
    "rolling_max_24h",
    "rolling_min_24h",
    "ewm_30pct",
)
_POINTS = T.StructType(
    [
        T.StructField("micros", T.ArrayType(T.LongType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)
_NUMBER = T.StructType([T.StructField("n", T.LongType())])

#: Held rows are kept by the hour of their time, emitted ones in blocks of a day's rows.
HELD_MICROS = 3600 * 1_000_000
BLOCK_ROWS = 24


def row_features(values: pd.Series) -> pd.DataFrame:
    """Lags and rolling statistics of one ordered run of values."""
    out = {f"lag_{n}h": values.shift(n) for n in _LAGS}
    out["diff_1"] = values - values.shift(1)
    out["diff_24"] = values - values.shift(24)
    out["rolling_mean_6h"] = values.rolling(6, min_periods=1).mean()
    day = values.rolling(24, min_periods=1)
    out["rolling_max_24h"], out["rolling_min_24h"] = day.max(), day.min()
    smooth = sum(w * values.shift(i) for i, w in enumerate(EWM_TERMS))
    out["ewm_30pct"] = smooth / EWM_DIVISOR
    return pd.DataFrame(out)


class TickFeatures(StatefulProcessor):
    """Holds rows until the watermark passes them, then emits them in time order.

    State per node is indexed by time. ``held`` maps an hour to its points still ahead of the
    watermark: new rows touch their own hours only, and an hour is read when the watermark reaches
    it. ``tail`` maps a block number to 24 emitted points: emitting appends to the newest block and
    drops blocks that the last 168 points no longer need. One timer stands at the earliest held
    point. A firing works on one hour after the other, so it holds an hour of a node's rows at a
    time. Rows behind the watermark never arrive here.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", _NUMBER, _POINTS)
        self.tail = handle.getMapState("tail", _NUMBER, _POINTS)
        self.emitted = handle.getValueState("emitted", _NUMBER)
        self.timer = handle.getValueState("timer", _NUMBER)

    @staticmethod
    def _points(state, key: int) -> tuple[np.ndarray, np.ndarray]:
        if not state.containsKey((key,)):
            return np.empty(0, dtype=np.int64), np.empty(0)
        micros, values = state.getValue((key,))
        return np.array(micros, dtype=np.int64), np.array(values, dtype=float)

    @staticmethod
    def _put(state, key: int, micros: np.ndarray, values: np.ndarray) -> None:
        state.updateValue((key,), (micros.tolist(), values.tolist()))

    def _wake_at(self, micros: int | None) -> None:
        """Move the timer to the millisecond behind a point; no point, no timer."""
        now = self.timer.get()[0] if self.timer.exists() else None
        wanted = None if micros is None else int(micros // 1000) + 1
        if now == wanted:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        if wanted is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(wanted)
            self.timer.update((wanted,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            micros = part["micros"].to_numpy(dtype=np.int64)
            values = part["x"].to_numpy(dtype=float)
            hours = micros // HELD_MICROS
            for hour in np.unique(hours).tolist():
                own = hours == hour
                old_micros, old_values = self._points(self.held, hour)
                self._put(self.held, hour, np.concatenate([old_micros, micros[own]]), np.concatenate([old_values, values[own]]))
            if len(micros):
                first = int(micros.min()) if first is None else min(first, int(micros.min()))
        if first is not None:
            now = self.timer.get()[0] if self.timer.exists() else None
            if now is None or first // 1000 + 1 < now:
                self._wake_at(first)
        return iter(())

    def _history(self, emitted: int) -> np.ndarray:
        """The last 168 emitted values."""
        first = max(0, emitted - WEEK_ROWS) // BLOCK_ROWS
        blocks = [self._points(self.tail, b)[1] for b in range(first, -(-emitted // BLOCK_ROWS))]
        return np.concatenate([np.empty(0), *blocks])[-WEEK_ROWS:]

    def _remember(self, emitted: int, micros: np.ndarray, values: np.ndarray) -> int:
        """Append points to the blocks; returns their number in all."""
        at = max(0, len(values) - WEEK_ROWS - BLOCK_ROWS) // BLOCK_ROWS * BLOCK_ROWS if emitted % BLOCK_ROWS == 0 else 0
        while at < len(values):
            number = emitted + at
            block, used = number // BLOCK_ROWS, number % BLOCK_ROWS
            old_micros, old_values = self._points(self.tail, block) if used else (np.empty(0, np.int64), np.empty(0))
            to = at + BLOCK_ROWS - used
            self._put(self.tail, block, np.concatenate([old_micros, micros[at:to]]), np.concatenate([old_values, values[at:to]]))
            at = to
        total = emitted + len(values)
        for block in range(max(0, emitted - WEEK_ROWS) // BLOCK_ROWS, max(0, total - WEEK_ROWS) // BLOCK_ROWS):
            if self.tail.containsKey((block,)):
                self.tail.removeKey((block,))
        return total

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        emitted = self.emitted.get()[0] if self.emitted.exists() else 0
        waiting = sorted(hour for (hour,) in self.held.keys())
        for hour in waiting:
            if hour * HELD_MICROS > limit:
                break
            micros, values = self._points(self.held, hour)
            order = np.lexsort((values, micros))
            micros, values = micros[order], values[order]
            due = int(np.searchsorted(micros, limit, side="right"))
            if due:
                before = self._history(emitted)
                out = row_features(pd.Series(np.concatenate([before, values[:due]]))).iloc[len(before) :]
                emitted = self._remember(emitted, micros[:due], values[:due])
                out.insert(0, "node_id", key[0])
                out.insert(1, "timestamp", pd.to_datetime(micros[:due], unit="us"))
                out.insert(2, "throughput_gbps", values[:due])
                yield out
            if due == len(micros):
                self.held.removeKey((hour,))
            else:
                self._put(self.held, hour, micros[due:], values[due:])
                break
        self.emitted.update((emitted,))
        ahead = [hour for hour in waiting if self.held.containsKey((hour,))][:1]
        self._wake_at(int(self._points(self.held, ahead[0])[0].min()) if ahead else None)

    def close(self) -> None:
        pass


def features_stream(
    df: DataFrame, watermark: str = "10 minutes", series: Series = NODE_SERIES
) -> DataFrame:
    """Row-window features per node, exact in event-time order, by ``transformWithState``.

    Start it within ``keyed_state``. Only time and value enter Python. A node's rows of one
    micro-batch meet in one task, so bound the micro-batch at the source (``maxFilesPerTrigger``,
    ``maxOffsetsPerTrigger``). Rows within the watermark's delay are held until the stream is closed.
    """
    fields = [
        T.StructField("node_id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("throughput_gbps", T.DoubleType()),
        *[T.StructField(c, T.DoubleType()) for c in _COLUMNS],
    ]
    key, ts, value = series.keys[0], series.ts, series.value
    narrow = timely(df, ts, watermark).selectExpr(
        f"{key} AS node_id", ts, f"unix_micros({ts}) AS micros", f"{value} AS x"
    )
    return narrow.groupBy("node_id").transformWithStateInPandas(
        TickFeatures(), T.StructType(fields), "append", "eventTime"
    )
