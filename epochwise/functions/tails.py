"""Tail probabilities Spark SQL lacks, as Arrow UDFs over aggregated rows.

These run after aggregation, on one row per comparison.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def _gamma_half_step(x: float) -> float:
    """log of gamma(x + 1/2) / gamma(x)."""
    if x > 5000.0:
        return 0.5 * math.log(x) - 1.0 / (8.0 * x) + 1.0 / (192.0 * x**3)
    return math.lgamma(x + 0.5) - math.lgamma(x)


def t_tail_value(t: float, df: float) -> float:
    """Two-sided Student p value, by quadrature over the angle atan(t / sqrt(df)).

    The integrand is cos(angle)**(df - 1); the range stops where it has fallen
    by exp(-45), so large df keep their precision.
    """
    power = df - 1.0
    start = math.atan2(abs(t), math.sqrt(df))
    stop = math.pi / 2
    if power > 0:
        sin2 = math.sin(start) ** 2 - math.cos(start) ** 2 * math.expm1(-90.0 / power)
        stop = min(stop, math.asin(min(1.0, math.sqrt(sin2))))
    cuts = np.linspace(start, stop, 17)
    mid, half = (cuts[1:] + cuts[:-1]) / 2, (cuts[1:] - cuts[:-1]) / 2
    angle = mid[:, None] + half[:, None] * _NODES[None, :]
    log_cos = 0.5 * np.log1p(-np.minimum(np.sin(angle) ** 2, 1.0 - 1e-300))
    area = float((np.exp(power * log_cos) * _WEIGHTS[None, :] * half[:, None]).sum())
    scale = math.exp(_gamma_half_step(df / 2.0)) / math.sqrt(math.pi)
    return min(1.0, 2.0 * scale * area)


def fisher_value(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p: total weight of tables no likelier than the observed one.

    Weights are taken relative to the observed table from the ratios of
    neighbouring tables.  Outside 40 standard deviations of the mean they are
    below the smallest double, so the walk stops there.
    """
    row, col, n = a + b, a + c, a + b + c + d
    low, high = max(0, col - (n - row)), min(row, col)
    if n == 0 or low == high:
        return 1.0
    mean = row * col / n
    sd = math.sqrt(max(1.0, mean * (n - row) / n * (n - col) / max(1, n - 1)))
    low = max(low, min(a, math.floor(mean - 40 * sd)))
    high = min(high, max(a, math.ceil(mean + 40 * sd)))
    x = np.arange(low, high, dtype=float)
    step = np.log(row - x) + np.log(col - x) - np.log(x + 1) - np.log(n - row - col + x + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    weight -= weight[a - low]
    top = weight.max()
    mass = np.exp(weight - top)
    return float(min(1.0, mass[weight <= 1e-9].sum() / mass.sum()))


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal p value."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2.0))).astype("float64")


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna()
    return pd.Series([t_tail_value(x, k) if good else None for x, k, good in zip(t, df, ok, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    ok = a.notna() & b.notna() & c.notna() & d.notna()
    rows = zip(a, b, c, d, ok, strict=True)
    return pd.Series([fisher_value(int(w), int(x), int(y), int(z)) if good else None for w, x, y, z, good in rows], dtype="float64")
