"""Tail probabilities and quantiles for small tables of test statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NORMAL_975 = 1.959963984540054


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi_square_tail(x: float, df: int) -> float:
    """Upper tail for whole degrees of freedom, as a finite sum."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2:
        total, log_term, start = math.erfc(math.sqrt(half)), 0.5 * math.log(half) - math.lgamma(1.5), 1
    else:
        total, log_term, start = math.exp(-half), math.log(half), 2
    for k in range(start, df - 1, 2):
        total += math.exp(log_term - half)
        log_term += math.log(half) - math.log((k + 2) / 2.0)
    return min(total, 1.0)


def t_two_sided_mass(t: float, df: int) -> float:
    """P(-t < T < t) for whole degrees of freedom, as a finite sum."""
    angle = math.atan(t / math.sqrt(df))
    cos2 = math.cos(angle) ** 2
    if df == 1:
        return 2.0 * angle / math.pi
    term, total = (1.0, 1.0) if df % 2 == 0 else (math.cos(angle), math.cos(angle))
    first = 1 if df % 2 == 0 else 2
    for k in range(first, df - 2, 2):
        term *= cos2 * k / (k + 1.0)
        total += term
    total *= math.sin(angle)
    return total if df % 2 == 0 else 2.0 * (angle + total) / math.pi


def t_critical_value(df: int, level: float = 0.95) -> float:
    """Two-sided critical value of Student's t.

    From 1,000 degrees of freedom on, the expansion around the normal
    quantile is accurate to the last digits; below, the exact distribution
    is inverted by bisection.
    """
    if df < 1:
        return math.nan
    if level == 0.95 and df >= 1000:
        z, n = NORMAL_975, float(df)
        return (z + (z**3 + z) / (4 * n) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * n**2)
                + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * n**3)
                + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * n**4))
    low, high = 0.0, 1.0
    while t_two_sided_mass(high, df) < level:
        low, high = high, high * 2.0
    for _ in range(80):
        middle = 0.5 * (low + high)
        low, high = (middle, high) if t_two_sided_mass(middle, df) < level else (low, middle)
    return 0.5 * (low + high)


@F.pandas_udf(T.DoubleType())
def _t_critical(df: pd.Series) -> pd.Series:
    known = {d: t_critical_value(int(d)) for d in df.dropna().unique() if d >= 1}
    return df.map(known).astype("float64")


@F.pandas_udf(T.DoubleType())
def _chi_square_p(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(k) or k < 1 else chi_square_tail(float(x), int(k))
                      for x, k in zip(statistic, df)], dtype="float64")


def t_critical(df: Column) -> Column:
    """97.5 % quantile of Student's t, one value per (already grouped) row."""
    return F.nanvl(_t_critical(df.cast("double")), F.lit(None).cast("double"))


def chi_square_p(statistic: Column, df: Column) -> Column:
    return F.nanvl(_chi_square_p(statistic.cast("double"), df.cast("double")), F.lit(None).cast("double"))


def p_text(p: Column) -> Column:
    return (F.when(p.isNull(), "NA").when(p < 0.001, "< 0.001").otherwise(F.format_string("%.3f", p)))


def inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric positive matrix after scaling its diagonal to one.

    A matrix that has become singular (a covariate separates the events)
    gives NaN, so that the fit reports no estimate instead of failing.
    """
    with np.errstate(invalid="ignore", divide="ignore"):
        scale = 1.0 / np.sqrt(np.diag(matrix))
        scaled = matrix * np.outer(scale, scale)
    if not np.all(np.isfinite(scaled)):
        return np.full_like(matrix, np.nan)
    try:
        return np.linalg.inv(scaled) * np.outer(scale, scale)
    except np.linalg.LinAlgError:
        return np.full_like(matrix, np.nan)
