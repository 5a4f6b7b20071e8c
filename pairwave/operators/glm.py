"""Logistic and log-link Poisson regression on covariate patterns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwave.operators.design import (
    Fit, Model, collapse, dependent_columns, expand, inverse, partial_sums, sandwich, separated)

# Fixed value: the normal quantile of the published limits.
Z = 1.96


def model_patterns(frame: DataFrame, outcome: str, models, group: str | None = "role") -> DataFrame:
    """Covariate patterns for all models of a family, from one pass over the frame."""
    columns = list(dict.fromkeys(c for m in models for c in m.columns))
    keys = ([group] if group else []) + [outcome, *columns]
    return collapse(frame.dropna(subset=[outcome]), keys)


# Newton steps; a fit that needs more has terms that diverge, and says so.
MAX_STEPS = 30


def _key(model: Model):
    return model.group, model.name


def _design(model: Model, rows: pd.DataFrame, centre: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(rows)), model.matrix(rows) - centre])


def _mean(eta: np.ndarray, family: str) -> tuple[np.ndarray, np.ndarray]:
    """Means and their variances."""
    mean = np.exp(np.minimum(eta, 700.0)) if family == "poisson" else 1.0 / (1.0 + np.exp(-np.clip(eta, -700.0, 700.0)))
    return mean, mean if family == "poisson" else mean * (1.0 - mean)


def fit_glms(patterns: DataFrame, outcome: str, models, family: str = "binomial", robust: bool = False) -> list[Fit]:
    """Fit several models on the same patterns, with the family's canonical link.

    A Newton step of all models is one pass over the pinned patterns.
    Columns are centred, so a term far from zero is as good as any other.
    Collinear terms are found from the inner products and left out, as null
    estimates; terms that diverge are null as well and their model is
    reported as not converged.  ``robust`` replaces the model covariance by
    the HC0 sandwich.
    """
    models = list(models)
    if len({_key(m) for m in models}) < len(models):
        raise ValueError("models of a family need names of their own")
    events = _frame_counts(patterns, outcome)

    def add_up(chosen, kernel) -> dict:
        found = partial_sums(patterns, chosen, kernel)
        return {_key(m): found[k] for k, m in enumerate(chosen) if k in found}

    def weighted(model: Model, rows: pd.DataFrame) -> np.ndarray:
        n = rows["n"].to_numpy("float64")
        return np.concatenate([[n.sum()], n @ model.matrix(rows)])

    sums = add_up(models, weighted)
    means = {key: v[1:] / v[0] for key, v in sums.items()}

    def inner(model: Model, rows: pd.DataFrame) -> np.ndarray:
        x = _design(model, rows, means[_key(model)])
        return (x.T @ (x * rows["n"].to_numpy("float64")[:, None])).ravel()

    kept, centres = {}, {}
    grams = add_up([m for m in models if _key(m) in sums], inner)
    for model in models:
        if _key(model) in grams:
            p = len(model.terms) + 1
            dropped = {c - 1 for c in dependent_columns(grams[_key(model)].reshape(p, p)) if c > 0}
            kept[_key(model)] = model.without({model.terms[c].name for c in dropped})
            centres[_key(model)] = np.delete(means[_key(model)], sorted(dropped))
    fitted = _newton(add_up, outcome, kept, centres, family)
    covariance = _robust(add_up, outcome, kept, centres, fitted, family) if robust and kept else {
        key: inverse(f["information"]) for key, f in fitted.items()}
    fits = []
    for model in models:
        key = _key(model)
        n_frame, n_events = events.get(model.group, (0, 0)) if model.group else (
            sum(v[0] for v in events.values()), sum(v[1] for v in events.values()))
        names = ("(Intercept)", *model.names)
        coef, cov, n_model, converged = np.full(len(names), np.nan), np.full((len(names),) * 2, np.nan), 0, False
        if key in kept:
            # The intercept belongs to the centre; moved to zero, slopes stay.
            shift = np.eye(len(centres[key]) + 1)
            shift[0, 1:] = -centres[key]
            slopes = np.where(fitted[key]["separated"], np.nan, fitted[key]["beta"])
            slopes[0] = shift[0] @ fitted[key]["beta"]
            coef, cov = expand(("(Intercept)", *kept[key].names), names, slopes, shift @ covariance[key] @ shift.T)
            n_model, converged = int(sums[key][0]), fitted[key]["converged"]
        fits.append(Fit(model, coef[1:], cov[1:, 1:], n_frame, n_model, n_events,
                        {"intercept": coef[0], "intercept_variance": cov[0, 0], "converged": converged}))
    return fits


def _frame_counts(patterns: DataFrame, outcome: str) -> dict:
    """Rows and events per role."""
    keys = ["role"] if "role" in patterns.columns else []
    rows = patterns.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col(outcome) * F.col("n")).alias("e")).collect()
    return {(r["role"] if keys else None): (int(r["n"] or 0), int(r["e"] or 0)) for r in rows}


def _newton(add_up, outcome: str, models: dict, centres: dict, family: str) -> dict:
    """Coefficients and information of all models, one pass per step; a step that loses likelihood is halved."""
    state = {key: {"beta": np.zeros(len(m.terms) + 1), "step": 0.0, "best": -np.inf, "information": None, "start": None}
             for key, m in models.items()}
    running = dict(models)
    for _ in range(MAX_STEPS):
        if not running:
            break
        beta = {key: state[key]["beta"] for key in running}

        def kernel(model: Model, rows: pd.DataFrame) -> np.ndarray:
            x = _design(model, rows, centres[_key(model)])
            n, y = rows["n"].to_numpy("float64"), rows[outcome].to_numpy("float64")
            eta = x @ beta[_key(model)]
            mean, curvature = _mean(eta, family)
            loglik = n @ (y * eta - (mean if family == "poisson" else np.logaddexp(0.0, eta)))
            return np.concatenate([[loglik], x.T @ (n * (y - mean)), (x.T @ (x * (n * curvature)[:, None])).ravel()])

        sums = add_up(list(running.values()), kernel)
        for key, model in list(running.items()):
            own, p = state[key], len(model.terms) + 1
            loglik, score, information = sums[key][0], sums[key][1:p + 1], sums[key][p + 1:].reshape(p, p)
            if not np.isfinite(loglik) or loglik < own["best"] - 1e-10 * abs(own["best"]):
                own["step"] = own["step"] / 2.0
                own["beta"] = own["beta"] - own["step"]
                continue
            own["best"], own["information"] = loglik, information
            own["start"] = information if own["start"] is None else own["start"]
            step = inverse(information) @ score
            if not np.all(np.isfinite(step)) or np.max(np.abs(step) * np.sqrt(np.diag(information))) <= 1e-9:
                del running[key]
                continue
            own["step"], own["beta"] = step, own["beta"] + step
    for key, own in state.items():
        own["separated"] = separated(own["start"], own["information"])
        own["separated"][0] = False
        own["converged"] = key not in running and not own["separated"].any()
    return state


def _robust(add_up, outcome: str, models: dict, centres: dict, fitted: dict, family: str) -> dict:
    """HC0: inverse information times the summed squared scores, twice."""

    def kernel(model: Model, rows: pd.DataFrame) -> np.ndarray:
        x = _design(model, rows, centres[_key(model)])
        n, y = rows["n"].to_numpy("float64"), rows[outcome].to_numpy("float64")
        mean, curvature = _mean(x @ fitted[_key(model)]["beta"], family)
        bread = x.T @ (x * (n * curvature)[:, None])
        meat = x.T @ (x * (n * (y - mean) ** 2)[:, None])
        return np.concatenate([bread.ravel(), meat.ravel()])

    result = {}
    for key, vector in add_up(list(models.values()), kernel).items():
        p = len(models[key].terms) + 1
        result[key] = sandwich(*vector.reshape(2, p, p))
    return result
