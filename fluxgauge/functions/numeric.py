"""Guarded arithmetic. Spark runs ANSI by default, so every division states its zero rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-9


def ratio(top: Column, bottom: Column, floor: float | None = None) -> Column:
    """``top / bottom``: NULL on a zero divisor, or the divisor raised to ``floor``. Never inf."""
    if floor is None:
        return F.try_divide(top, bottom)
    return F.when(bottom.isNotNull(), top / F.greatest(bottom, F.lit(floor)))


def clip(value: Column, low: float, high: float) -> Column:
    """Bounded value; NULL stays NULL (``greatest``/``least`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def to_nonneg(value: Column, text: bool = True) -> Column:
    """Text to a non-negative double: what does not parse counts as 0.

    A cast would also take the suffixed and hexadecimal literals of Java (``1d``, ``0x1p3``).
    """
    number = value.try_cast("double")
    if text:
        number = F.when(~value.rlike(r"^\s*[-+]?[\d.].*[dDfFxX]"), number)
    number = F.nanvl(number, F.lit(0.0))
    return F.greatest(F.coalesce(number, F.lit(0.0)), F.lit(0.0))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def round_half_up(value: Column, digits: int) -> Column:
    """Rounding by ``floor``, the same in every SQL engine also on decimal ties."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.500001) / scale


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    cleaned = {
        f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`"))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(cleaned) if cleaned else df
