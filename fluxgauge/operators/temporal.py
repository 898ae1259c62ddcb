"""Calendar features: pure projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge.functions.numeric import flag
from fluxgauge.operators.joins import with_holidays


def _cycle(name: str, value: Column, period: int) -> dict[str, Column]:
    angle = value * (F.pi() * 2.0 / period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def add_temporal(
    df: DataFrame,
    ts: str = "timestamp",
    dow: str = "monday0",
    holidays: DataFrame | None = None,
    with_holiday_flag: bool = False,
) -> DataFrame:
    """Calendar parts, flags and cyclic encodings of ``ts``.

    ``dow="monday0"`` counts Monday as 0; ``"sunday0"`` counts Sunday as 0. The weekday
    cycle follows the same choice; weekend and business flags do not depend on it.
    """
    if dow not in ("monday0", "sunday0"):
        raise ValueError(f"unknown dow option: {dow}")
    at = F.col(ts)
    hour, day, month = F.hour(at), F.dayofmonth(at), F.month(at)
    weekday = F.weekday(at)
    numbered = weekday if dow == "monday0" else F.dayofweek(at) - 1
    late = day >= 28
    features = {
        "hour_of_day": hour,
        "day_of_week": numbered,
        "day_of_month": day,
        "week_of_year": F.weekofyear(at),
        "month": month,
        "quarter": F.quarter(at),
        "is_weekend": flag(weekday >= 5),
        "is_business_hour": flag(hour.between(9, 17) & (weekday < 5)),
        "is_month_end": flag(late),
        "is_quarter_end": flag(late & (month % 3 == 0)),
        "is_peak_hour": flag(hour.between(8, 20)),
        **_cycle("hour", hour, 24),
        **_cycle("dow", numbered, 7),
        **_cycle("day", F.dayofyear(at), 365),
    }
    df = df.withColumns(features)
    if with_holiday_flag or holidays is not None:
        df = with_holidays(df, ts, holidays)
    return df
