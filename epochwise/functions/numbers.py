"""Small numeric column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(value: Column, digits: int = 6) -> Column:
    """Half-even rounding to ``digits`` decimals; never yields negative zero."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double, null where the bottom is 0 or null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def finite(value: Column) -> Column:
    """Double with NaN turned into null."""
    d = value.cast("double")
    return F.when(~F.isnan(d), d)
