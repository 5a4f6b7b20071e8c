"""Model terms, model frames and the small matrices behind a fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwave.functions.distributions import inverse, normal_two_sided
from pairwave.session import pin

# Share of a column's length that must remain after projecting it on the
# columns before it; below, the column is a combination of those.
DEPENDENT = 1e-9


@dataclass(frozen=True)
class Term:
    """A numeric column, or the indicator of one level of a factor."""

    name: str
    column: str
    level: object = None

    def expression(self) -> Column:
        c = F.col(self.column)
        return (c if self.level is None else c == F.lit(self.level)).cast("double")

    def values(self, frame: pd.DataFrame) -> np.ndarray:
        c = frame[self.column]
        return c.to_numpy("float64") if self.level is None else (c == self.level).to_numpy("float64")


@dataclass(frozen=True)
class Model:
    """Terms fitted on the rows where every model column is known.

    ``group`` restricts the frame to one value of its ``role`` column.
    """

    name: str
    terms: tuple[Term, ...]
    group: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t.column for t in self.terms))

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(t.name for t in self.terms)

    def rows(self, frame: pd.DataFrame) -> pd.DataFrame:
        keep = frame[list(self.columns)].notna().all(axis=1)
        if self.group is not None:
            keep &= frame["role"] == self.group
        return frame[keep]

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        if not self.terms:
            return np.empty((len(rows), 0))
        return np.column_stack([t.values(rows) for t in self.terms])

    def without(self, dropped) -> Model:
        return Model(self.name, tuple(t for t in self.terms if t.name not in dropped), self.group)


def numeric(*columns: str) -> tuple[Term, ...]:
    return tuple(Term(c, c) for c in columns)


def factor(column: str, levels) -> tuple[Term, ...]:
    """Indicators of all levels but the first, which is the reference."""
    return tuple(Term(f"{column}{level}", column, level) for level in list(levels)[1:])


@dataclass
class Fit:
    """A fitted model: small arrays on the driver."""

    model: Model
    coef: np.ndarray
    cov: np.ndarray
    n_frame: int
    n_model: int
    events: int
    extra: dict = field(default_factory=dict)

    @property
    def converged(self) -> bool:
        return bool(self.extra.get("converged", True))

    def estimate(self, term: str) -> tuple[float | None, float | None]:
        """Coefficient and standard error; nulls for a term that is not estimable."""
        if term not in self.model.names:
            return None, None
        k = self.model.names.index(term)
        if not np.isfinite(self.coef[k]) or not self.cov[k, k] >= 0:
            return None, None
        return float(self.coef[k]), float(np.sqrt(self.cov[k, k]))

    def ratio(self, term: str, z: float):
        """exp(b) with limits and two-sided Wald p-value."""
        b, se = self.estimate(term)
        if b is None:
            return None, None, None, None
        with np.errstate(over="ignore"):
            limits = np.exp(np.array([b, b - z * se, b + z * se]))
        return (*map(float, limits), normal_two_sided(b / se) if se > 0 else None)


TERM_SCHEMA = ("group string, model string, position int, term string, estimate double, std_error double, "
               "ratio double, conf_low double, conf_high double, p_value double, "
               "n_frame bigint, n_model bigint, events bigint, converged boolean")


def term_rows(fit: Fit, z: float, terms=None) -> list[tuple]:
    rows = []
    for k, term in enumerate(fit.model.names):
        if terms is None or term in terms:
            rows.append((fit.model.group, fit.model.name, k, term, *fit.estimate(term), *fit.ratio(term, z),
                         fit.n_frame, fit.n_model, fit.events, fit.converged))
    return rows


def term_table(spark: SparkSession, fits, z: float, terms=None) -> DataFrame:
    """Tidy table of the terms of several fits; one small row per term."""
    return spark.createDataFrame([r for fit in fits for r in term_rows(fit, z, terms)], TERM_SCHEMA)


def collapse(frame: DataFrame, columns) -> DataFrame:
    """Distinct covariate patterns with their row counts, pinned.

    Rows with equal model columns enter every likelihood the same way, so
    the iterations run over patterns with a weight.  Categorical covariates
    shrink the frame by orders of magnitude; continuous ones leave it
    distributed.  The aggregate combines before its shuffle.
    """
    return pin(frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")))


def levels_of(patterns: DataFrame, columns, group: str = "role") -> dict[tuple, list]:
    """Sorted known levels of categorical columns per group."""
    found = patterns.groupBy(group).agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns]).collect()
    return {(row[group], c): list(row[c]) for row in found for c in columns}


def partial_sums(patterns: DataFrame, models, kernel: Callable[[Model, pd.DataFrame], np.ndarray]) -> dict:
    """Sum a vector per model over all patterns.

    Each partition adds up its own rows; only one vector per model and
    partition is shuffled and one per model reaches the driver.
    """
    models = list(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, model in enumerate(models):
                rows = model.rows(batch)
                if len(rows):
                    part = kernel(model, rows)
                    totals[k] = totals[k] + part if k in totals else part
        for k, vector in totals.items():
            yield pd.DataFrame({"model": k, "position": np.arange(len(vector)), "value": vector})

    sums = patterns.mapInPandas(run, "model int, position int, value double")
    collected = sums.groupBy("model", "position").agg(F.sum("value").alias("value")).collect()
    result: dict[int, dict[int, float]] = {}
    for row in collected:
        result.setdefault(row["model"], {})[row["position"]] = row["value"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in result.items()}


def sum_of_products(frame: DataFrame) -> np.ndarray:
    """Inner products of all columns, added up per partition first."""
    size = len(frame.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            values = batch.to_numpy("float64")
            total += values.T @ values
        yield pd.DataFrame({"position": np.arange(size * size), "value": total.ravel()})

    cells = frame.mapInPandas(run, "position int, value double")
    summed = cells.groupBy("position").agg(F.sum("value").alias("value")).collect()
    product = np.zeros(size * size)
    for row in summed:
        product[row["position"]] = row["value"]
    return product.reshape(size, size)


def dependent_columns(gram: np.ndarray) -> list[int]:
    """Columns that are combinations of earlier ones, from their inner products."""
    work, dropped = gram.astype(float).copy(), []
    size = np.diag(gram).copy()
    for k in range(len(work)):
        if size[k] <= 0 or work[k, k] <= DEPENDENT * size[k]:
            dropped.append(k)
            work[k, :] = work[:, k] = 0.0
            continue
        pivot = work[:, k] / work[k, k]
        work[k + 1:, :] -= np.outer(pivot[k + 1:], work[k, :])
    return dropped


# A term whose variance grows by this factor from the null model to the last
# step runs off to infinity: its events are separated, or nearly so.
SEPARATED = 1e4


def separated(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Terms without a finite estimate, from the information at the null model and at the last step."""
    return ~(np.diag(inverse(end)) <= SEPARATED * np.diag(inverse(start)))


def sandwich(bread: np.ndarray, meat: np.ndarray) -> np.ndarray:
    inner = inverse(bread)
    return inner @ meat @ inner


def expand(fit_names, all_names, coef: np.ndarray, cov: np.ndarray):
    """Put estimates back in the full term order, with NaN for dropped terms."""
    index = [all_names.index(n) for n in fit_names]
    full = np.full(len(all_names), np.nan)
    full_cov = np.full((len(all_names), len(all_names)), np.nan)
    full[index] = coef
    full_cov[np.ix_(index, index)] = cov
    return full, full_cov
