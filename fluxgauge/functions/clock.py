"""Zone-less time arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def floor_to(unit: str, ts: Column) -> Column:
    """Start of the unit; ``date_trunc`` yields a zoned value, so it is cast back."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def floor_hour(ts: Column) -> Column:
    return floor_to("hour", ts)


def epoch_hours(ts: Column) -> Column:
    return F.timestamp_diff("HOUR", _epoch(), ts)


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _epoch(), ts)


def hours(count) -> Column:
    """An interval of ``count`` hours; ``count`` is a number or a column."""
    count = count if isinstance(count, Column) else F.lit(int(count))
    return F.make_dt_interval(hours=count.cast("int"))


def moment(value) -> Column:
    """A Python time, a text or a column as a zone-less timestamp."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, (dt.datetime, dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def latest(df: DataFrame, ts: str = "timestamp") -> Column:
    """The newest time of a table as a scalar subquery: no join, and usable in any filter."""
    return df.select(F.max(ts)).scalar()


def earliest(df: DataFrame, ts: str = "timestamp") -> Column:
    return df.select(F.min(ts)).scalar()


def since(df: DataFrame, ts: str, as_of, back_hours: int) -> DataFrame:
    """Rows of the ``back_hours`` up to ``as_of`` (default: the newest row), ends included.

    Bounds are scalar subqueries or literals, so the filter reaches the scan.
    """
    end = as_of_or_latest(df, ts, as_of)
    recent = F.col(ts) >= end - hours(back_hours)
    return df.filter(recent if as_of is None else recent & (F.col(ts) <= end))


def as_of_or_latest(df: DataFrame, ts: str, as_of) -> Column:
    return latest(df, ts) if as_of is None else moment(as_of)
