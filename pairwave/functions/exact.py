"""Exact test of a 2x2 table, given its four counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Half-width, in standard deviations, of the part of the support that is
# evaluated, besides 50 cells.  An observed cell outside is so unlikely that
# its p-value is reported as the smallest double instead of zero.
SPREAD = 40.0


class _Conditional:
    """First cell of a 2x2 table with fixed margins, for any odds ratio.

    The support grows with the margins, so only the part around the mode is
    evaluated: its length is of the order of the root of the counts.
    """

    def __init__(self, a: int, b: int, c: int, d: int):
        self.x, self.row, self.col, self.other = a, a + b, a + c, b + d
        self.low, self.high = max(0, self.row - self.other), min(self.row, self.col)

    def mode(self, log_odds: float) -> int:
        odds = math.exp(min(max(log_odds, -700.0), 700.0))
        a = odds - 1.0
        b = -((self.col + self.row + 2.0) * odds + self.other - self.row)
        c = odds * (self.col + 1.0) * (self.row + 1.0)
        root = -(b + math.copysign(math.sqrt(max(b * b - 4.0 * a * c, 0.0)), b)) / 2.0
        return int(min(max(c / root, self.low), self.high))

    def mass(self, log_odds: float):
        j = self.mode(log_odds)
        cells = (j, self.row - j, self.col - j, self.other - self.row + j)
        half = int(SPREAD * (1.0 / sum(1.0 / max(n, 1) for n in cells)) ** 0.5) + 50
        support = np.arange(max(self.low, j - half), min(self.high, j + half) + 1, dtype="float64")
        s = support[:-1]
        ratio = (np.log(self.col - s) + np.log(self.row - s) - np.log(s + 1.0)
                 - np.log(self.other - self.row + s + 1.0) + log_odds)
        log_mass = np.concatenate([[0.0], np.cumsum(ratio)])
        mass = np.exp(log_mass - log_mass.max())
        return support, mass / mass.sum()

    def mean(self, log_odds: float) -> float:
        support, mass = self.mass(log_odds)
        return float(support @ mass)

    def at_least(self, log_odds: float) -> float:
        support, mass = self.mass(log_odds)
        return float(mass[support >= self.x].sum())

    def at_most(self, log_odds: float) -> float:
        support, mass = self.mass(log_odds)
        return float(mass[support <= self.x].sum())


def _increasing_root(f, start: float) -> float:
    """Root of an increasing function: bracket by doubling, then bisect."""
    step, low, high = 0.5, start, start
    while f(low) > 0 and low > -700:
        low, step = low - step, step * 2.0
    step = 0.5
    while f(high) < 0 and high < 700:
        high, step = high + step, step * 2.0
    while high - low > 1e-12 * max(1.0, abs(low)):
        middle = 0.5 * (low + high)
        if middle in (low, high):
            break
        low, high = (low, middle) if f(middle) > 0 else (middle, high)
    return 0.5 * (low + high)


def exact_odds_ratio(a: int, b: int, c: int, d: int, level: float = 0.95):
    """Conditional maximum-likelihood odds ratio, exact limits, two-sided p."""
    table = _Conditional(a, b, c, d)
    if table.low == table.high:
        return 0.0 if table.x == 0 else math.nan, 0.0, math.inf, 1.0
    start = math.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))
    tail = (1.0 - level) / 2.0
    at_low, at_high = table.x == table.low, table.x == table.high
    estimate = 0.0 if at_low else math.inf if at_high else math.exp(
        _increasing_root(lambda t: table.mean(t) - table.x, start))
    lower = 0.0 if at_low else math.exp(_increasing_root(lambda t: table.at_least(t) - tail, start))
    upper = math.inf if at_high else math.exp(_increasing_root(lambda t: tail - table.at_most(t), start))
    support, mass = table.mass(0.0)
    observed = mass[support == table.x]
    p = float(mass[mass <= observed[0] * (1.0 + 1e-7)].sum()) if observed.size else math.ulp(0.0)
    return estimate, lower, upper, min(p, 1.0)


_RESULT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("odds_ratio", "conf_low", "conf_high", "p_value")])


@F.pandas_udf(_RESULT)
def _exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    rows = []
    for cells in zip(a, b, c, d):
        usable = not any(pd.isna(n) for n in cells)
        rows.append(exact_odds_ratio(*(int(n) for n in cells)) if usable else (None,) * 4)
    return pd.DataFrame(rows, columns=["odds_ratio", "conf_low", "conf_high", "p_value"], dtype="float64")


def exact_test(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Struct of estimate, limits and p-value for one table per row."""
    return _exact(*(n.cast("long") for n in (a, b, c, d)))
