"""Interval estimates as column arithmetic on counts and moments."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from epochwise.functions.numbers import clip, ratio


def z_value(confidence: float = 0.95) -> float:
    """Two-sided standard normal quantile, pinned to nine decimals."""
    return round(NormalDist().inv_cdf(0.5 + confidence / 2.0), 9)


def wilson(hits: Column, total: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Score interval of a rate; (0, 1) where the total is 0."""
    z2 = F.lit(z_value(confidence) ** 2)
    n, x = total.cast("double"), hits.cast("double")
    # centre and half width of the score interval, both over (n + z^2)
    centre = F.try_divide(x + z2 / 2.0, n + z2)
    half = F.try_divide(F.lit(z_value(confidence)) * F.sqrt(F.try_divide(x * (n - x), n) + z2 / 4.0), n + z2)
    none = F.coalesce(total <= 0, F.lit(True))
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(none, 1.0).otherwise(F.least(F.lit(1.0), centre + half))


def newcombe(hits_a: Column, total_a: Column, hits_b: Column, total_b: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Interval of a rate difference from two score intervals; (-1, 1) if a total is 0."""
    low_a, high_a = wilson(hits_a, total_a, confidence)
    low_b, high_b = wilson(hits_b, total_b, confidence)
    pa, pb = ratio(hits_a, total_a), ratio(hits_b, total_b)
    gap = pa - pb
    none = F.coalesce((total_a <= 0) | (total_b <= 0), F.lit(True))
    low = clip(gap - F.hypot(pa - low_a, high_b - pb), -1.0, 1.0)
    high = clip(gap + F.hypot(high_a - pa, pb - low_b), -1.0, 1.0)
    return F.when(none, -1.0).otherwise(low), F.when(none, 1.0).otherwise(high)


def mean_interval(n: Column, mean: Column, sd: Column, z: float) -> tuple[Column, Column]:
    """Normal interval of a mean; one value gives a zero-width interval."""
    half = F.when(n <= 1, 0.0).otherwise(F.lit(z) * F.try_divide(sd, F.sqrt(n)))
    return mean - half, mean + half
