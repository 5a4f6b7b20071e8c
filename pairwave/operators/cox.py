"""Cox proportional hazards with Efron ties, fitted on risk-set sums.

Rows stay on the executors.  A Newton step sends coefficients out; tasks add
up the rows at each distinct time.  Reverse cumulative sums over the times
are the risk sets; the likelihood, its derivatives and the
proportional-hazards test are sums over event times.

The time axis is cut into ranges of about ``TIMES_PER_RANGE`` distinct times.
The totals per range give each range the sums of all later ones, and every
range is evaluated on the executors.  The driver gets one short row per
model and range.  Follow-up counted in days is one or two ranges.  With very
many distinct times, ranges and times per range grow with the square root
of their number, so neither a task nor the driver holds more than that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwave.functions.distributions import chi_square_tail, inverse
from pairwave.functions.joins import attach
from pairwave.operators.design import Fit, Model, dependent_columns, expand, separated, sum_of_products
from pairwave.session import pin

TIMES_PER_RANGE = 5_000
MAX_STEPS = 25
# Tied events added one by one per time, and times handled at once.
TIED_DIRECT, TIED_ROWS = 128, 4_096
# A task holds sums for at most this many times before it passes them on.
HELD_TIMES = 50_000


@dataclass
class SurvivalFrame:
    """Pinned rows (role, time, event, covariates, n) and the cuts of the time axis."""

    rows: DataFrame
    cuts: tuple[float, ...]
    centers: dict
    counts: dict
    levels: dict
    cluster: str | None = None

    @property
    def ranges(self) -> int:
        return len(self.cuts) + 1


def survival_frame(frame: DataFrame, time: str, event: str, covariates, group: str | None = "role",
                   cluster: str | None = None, factors=(), times_per_range: int = TIMES_PER_RANGE) -> SurvivalFrame:
    """Collapse equal rows, sort them by time into partitions, and pin them.

    Partitions by ranges of time hold few distinct times each, so the sums
    per time that leave them are short.  A time shared by very many rows is
    spread by the hash of the covariates.  The work on a row grows with the
    square of the number of terms, so partitions are not merged by size.
    """
    covariates = tuple(covariates)
    keys = [*([cluster] if cluster else []), *covariates]
    role = F.col(group) if group else F.lit(None).cast("string")
    rows = (frame.dropna(subset=[time, event])
            .select(role.alias("role"), F.col(time).cast("double").alias("time"),
                    F.col(event).cast("int").alias("event"), *keys)
            .groupBy("role", "time", "event", *keys).agg(F.count(F.lit(1)).alias("n")))
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pin(rows.repartitionByRange(tasks, "time", F.xxhash64("role", "event", *keys)))
    numbers = _numbers(rows, covariates)
    measured = rows.groupBy("role").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("event")).alias("events"),
        F.approx_count_distinct("time", 0.02).alias("times"),
        *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in numbers],
        *[F.sort_array(F.collect_set(c)).alias(f"levels_{c}") for c in factors]).collect()
    distinct = sum(r["times"] for r in measured)
    cuts: tuple[float, ...] = ()
    ranges = math.ceil(distinct / max(times_per_range, math.sqrt(distinct), 1))
    if ranges > 1:
        points = [k / ranges for k in range(1, ranges)]
        cuts = tuple(sorted(set(rows.select("time").distinct().approxQuantile("time", points, 0.1 / ranges))))
    return SurvivalFrame(
        rows, cuts,
        {r["role"]: {c: r[f"mean_{c}"] or 0.0 for c in numbers} for r in measured},
        {r["role"]: (int(r["n"]), int(r["events"])) for r in measured},
        {(r["role"], c): list(r[f"levels_{c}"]) for r in measured for c in factors}, cluster)


def _numbers(rows: DataFrame, covariates) -> list[str]:
    return [c for c, kind in rows.dtypes if c in covariates and kind != "string"]


# -- sums per time ---------------------------------------------------------

class _Layout:
    """Where each sum sits in the vector kept per time, for p terms."""

    def __init__(self, p: int):
        self.p, self.upper = p, np.triu_indices(p)
        q = len(self.upper[0])
        self.risk = slice(0, 1 + p + q)
        self.tied = slice(1 + p + q, 2 * (1 + p + q))
        self.deaths, self.at_risk = 2 * (1 + p + q), 2 * (1 + p + q) + 1
        self.covariates = slice(self.at_risk + 1, self.at_risk + 1 + p)
        self.width = self.at_risk + 1 + p

    def square(self, packed: np.ndarray) -> np.ndarray:
        full = np.zeros((*packed.shape[:-1], self.p, self.p))
        full[..., self.upper[0], self.upper[1]] = packed
        full[..., self.upper[1], self.upper[0]] = packed
        return full

    def split(self, sums: np.ndarray):
        p = self.p
        return sums[..., 0], sums[..., 1:1 + p], self.square(sums[..., 1 + p:])


def _centered(model: Model, rows: pd.DataFrame, centers: dict) -> np.ndarray:
    x = model.matrix(rows)
    shift = [centers.get(t.column, 0.0) if t.level is None else 0.0 for t in model.terms]
    return x - np.array(shift)


def _sums_by(keys: np.ndarray, model: Model, rows: pd.DataFrame, beta: np.ndarray, centers: dict):
    """Sums per distinct key: one small matrix product over each key's rows,
    and one over those of them with an event."""
    layout = _Layout(len(model.terms))
    event = rows["event"].to_numpy("int64")
    order = np.lexsort((event, keys))
    keys, event, n = keys[order], event[order], rows["n"].to_numpy("float64")[order]
    x = _centered(model, rows, centers)[order]
    with_one = np.column_stack([np.ones(len(x)), x])
    with np.errstate(over="ignore"):
        weighted = with_one * (n * np.exp(x @ beta))[:, None]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    upper = np.triu_indices(layout.p + 1)
    out = np.zeros((len(starts), layout.width))
    products = weighted[:, upper[0]] * with_one[:, upper[1]]
    out[:, layout.risk] = np.add.reduceat(products, starts, axis=0)
    out[:, layout.tied] = np.add.reduceat(np.where(event[:, None] == 1, products, 0.0), starts, axis=0)
    out[:, layout.deaths] = np.add.reduceat(n * event, starts)
    out[:, layout.at_risk] = np.add.reduceat(n, starts)
    out[:, layout.covariates] = np.add.reduceat(x * (n * event)[:, None], starts, axis=0)
    return keys[starts], out


def _add_by(keys: np.ndarray, values: np.ndarray):
    """Distinct keys in order and the sums of the values at each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(values[order], starts, axis=0)


def _sums(frame: SurvivalFrame, models, betas, per_range: bool) -> DataFrame:
    """Partial sums per model and time (or only per range of times).

    A task adds up all its batches first; as it holds a range of times, the
    rows it returns number about as many as its distinct times.
    """
    models, cuts, centers = list(models), np.array(frame.cuts), frame.centers

    def output(k: int, held) -> pd.DataFrame:
        keys, sums = held
        return pd.DataFrame({
            "model": k, "part": keys.astype(int) if per_range else np.searchsorted(cuts, keys, side="right"),
            "time": keys.astype(float), "sums": list(sums)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, model in enumerate(models):
                rows = model.rows(batch)
                if not len(rows):
                    continue
                time = rows["time"].to_numpy("float64")
                keys = np.searchsorted(cuts, time, side="right") if per_range else time
                added = _sums_by(keys, model, rows, betas[k], centers.get(model.group, {}))
                if k in held:
                    added = _add_by(*(np.concatenate(pair) for pair in zip(held[k], added)))
                held[k] = added
                if len(added[0]) > HELD_TIMES:
                    yield output(k, held.pop(k))
        for k in held:
            yield output(k, held[k])

    return frame.rows.mapInPandas(run, "model int, part int, time double, sums array<double>")


# -- one range of times ----------------------------------------------------

def _tied_sums(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """For d tied events per time, with f = l/d for l = 0..d-1 and q = s - f e:
    the sums of log q, 1/q, f/q, 1/q^2, f/q^2 and f^2/q^2.

    The last ``TIED_DIRECT`` terms, which may come close to q = 0, are added
    one by one and the smooth rest in closed form, so a time costs the same
    whatever its number of events.
    """
    result = np.zeros((len(d), 6))
    d = d.astype(np.int64)
    back = np.arange(TIED_DIRECT)
    for low in range(0, len(d), TIED_ROWS):
        part = slice(low, low + TIED_ROWS)
        place = d[part, None] - 1 - back
        f = np.where(place >= 0, place, 0) / d[part, None]
        q = s[part, None] - f * e[part, None]
        for column, value in enumerate((np.log(q), 1 / q, f / q, 1 / q**2, f / q**2, f**2 / q**2)):
            result[part, column] = np.where(place >= 0, value, 0.0).sum(axis=1)
    many = np.flatnonzero(d > TIED_DIRECT)
    if len(many):
        result[many] += _smooth_sums(d[many].astype(float), s[many], e[many])
    return result


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def _smooth_sums(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The terms before the last ``TIED_DIRECT`` by the Euler-Maclaurin formula.

    With c = e / d and a = s / c, q is c (a - l): sums over l = 0..n-1 of
    log x, 1 / x, l / x, 1 / x^2, l / x^2 and l^2 / x^2 with x = a - l.
    Integrals have closed forms; far from x = 0, where those of the terms
    with l cancel, quadrature is exact.
    """
    n, c = d - TIED_DIRECT, e / d
    a = s / c
    z, fall = a - n, -np.log1p(-n / a)
    spot = n[:, None] * (_NODES + 1) / 2
    x = a[:, None] - spot

    def either(closed, values):
        return np.where(a < 2 * n, closed, (values * _WEIGHTS).sum(axis=1) * n / 2)

    def total(integral, value, first, third, fifth):
        """First, third and fifth derivative by l, as functions of x."""
        return (integral - (value(z) - value(a)) / 2 + (first(z) - first(a)) / 12
                - (third(z) - third(a)) / 720 + (fifth(z) - fifth(a)) / 30240)

    gap = 1 / z - 1 / a
    sums = (
        total(n * np.log(a) + z * fall - n, np.log, lambda x: -1 / x, lambda x: -2 / x**3, lambda x: -24 / x**5) + n * np.log(c),
        total(fall, lambda x: 1 / x, lambda x: 1 / x**2, lambda x: 6 / x**4, lambda x: 120 / x**6) / c,
        total(either(a * fall - n, spot / x), lambda x: (a - x) / x, lambda x: a / x**2, lambda x: 6 * a / x**4,
              lambda x: 120 * a / x**6) / e,
        total(gap, lambda x: 1 / x**2, lambda x: 2 / x**3, lambda x: 24 / x**5, lambda x: 720 / x**7) / c**2,
        total(either(a * gap - fall, spot / x**2), lambda x: (a - x) / x**2, lambda x: (2 * a - x) / x**3,
              lambda x: (24 * a - 6 * x) / x**5, lambda x: (720 * a - 120 * x) / x**7) / (c * e),
        total(either(a * (a * gap - 2 * fall) + n, (spot / x) ** 2), lambda x: ((a - x) / x) ** 2,
              lambda x: 2 * a * (a - x) / x**3, lambda x: 12 * a * (2 * a - x) / x**5,
              lambda x: 240 * a * (3 * a - x) / x**7) / e**2)
    return np.column_stack(sums)


@dataclass
class _Block:
    """Event-time quantities of one range, times ascending."""

    rows: float
    time: np.ndarray
    deaths: np.ndarray
    at_risk: np.ndarray
    loglik: np.ndarray
    residual: np.ndarray
    info: np.ndarray
    hazard: np.ndarray
    hazard_mean: np.ndarray
    own_hazard: np.ndarray
    own_mean: np.ndarray
    tied_mean: np.ndarray


def _evaluate(p: int, beta: np.ndarray, time: np.ndarray, sums: np.ndarray, later: np.ndarray) -> _Block:
    """Likelihood pieces per event time; ``later`` holds the sums of all later ranges."""
    # Coefficients that run away overflow; the step control rejects the result.
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        layout = _Layout(p)
        time, sums = _add_by(time, sums)
        at_or_after = sums[::-1].cumsum(axis=0)[::-1] + later
        here = sums[:, layout.deaths] > 0
        d = sums[here, layout.deaths]
        s0, s1, s2 = layout.split(at_or_after[here][:, layout.risk])
        e0, e1, e2 = layout.split(sums[here][:, layout.tied])
        log_q, a0, a1, b0, b1, b2 = _tied_sums(d, s0, e0).T
        covariates = sums[here][:, layout.covariates]

        def scaled(factor, array):
            return factor.reshape(-1, *([1] * (array.ndim - 1))) * array

        cross = s1[:, :, None] * e1[:, None, :]
        info = (scaled(a0, s2) - scaled(a1, e2) - scaled(b0, s1[:, :, None] * s1[:, None, :])
                + scaled(b1, cross + cross.transpose(0, 2, 1)) - scaled(b2, e1[:, :, None] * e1[:, None, :]))
        mean_sum = scaled(a0, s1) - scaled(a1, e1)
        return _Block(
            sums[:, layout.at_risk].sum(), time[here], d, at_or_after[here, layout.at_risk], covariates @ beta - log_q, covariates - mean_sum, info,
            a0, scaled(b0, s1) - scaled(b1, e1), a0 - a1,
            scaled(b0 - b1, s1) - scaled(b1 - b2, e1), mean_sum / d[:, None])


def _pack(block: _Block, p: int, survival_before: float | None) -> np.ndarray:
    """Sums of a range: likelihood, score and information, and if asked for
    the score and information weighted by 1 - survival just before the event."""
    parts = [[block.rows, block.loglik.sum()], block.residual.sum(axis=0), block.info.sum(axis=0).ravel()]
    if survival_before is not None:
        step = 1.0 - block.deaths / block.at_risk
        before = survival_before * np.concatenate([[1.0], np.cumprod(step)[:-1]]) if len(step) else step
        g = 1.0 - before
        parts += [g @ block.residual, np.tensordot(g, block.info, 1).ravel(),
                  np.tensordot(g**2, block.info, 1).ravel()]
    return np.concatenate([np.asarray(v, dtype=float) for v in parts])


def _later(frame: SurvivalFrame, models, betas) -> list[np.ndarray]:
    """Per model and range the sums of all later ranges; a single range has none and needs no pass."""
    totals = [np.zeros((frame.ranges, _Layout(len(m.terms)).width)) for m in models]
    if not frame.cuts:
        return totals

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": rows["model"][:1], "part": rows["part"][:1],
                             "sums": [np.sum(np.stack(rows["sums"]), axis=0)]})

    partial = _sums(frame, models, betas, per_range=True).drop("time")
    merged = partial.groupBy("model", "part").applyInPandas(merge, "model int, part int, sums array<double>")
    for row in merged.collect():
        totals[row["model"]][row["part"]] = row["sums"]
    return [t[::-1].cumsum(axis=0)[::-1] - t for t in totals]


def _step(frame: SurvivalFrame, models, betas, weighted: bool = False) -> list[np.ndarray]:
    """Packed sums of every model at its coefficients.

    One pass over the rows for a single range; one more for the totals of
    several, and one more for the survival before each if ``weighted``.
    """
    models = list(models)
    later = _later(frame, models, betas)
    sizes = [len(m.terms) for m in models]

    def evaluate(rows: pd.DataFrame) -> tuple[int, int, _Block]:
        k, part = int(rows["model"].iloc[0]), int(rows["part"].iloc[0])
        return k, part, _evaluate(sizes[k], betas[k], rows["time"].to_numpy("float64"), np.stack(rows["sums"]), later[k][part])

    def log_survival(rows: pd.DataFrame) -> pd.DataFrame:
        k, part, block = evaluate(rows)
        with np.errstate(divide="ignore"):
            value = np.log1p(-block.deaths / block.at_risk).sum()
        return pd.DataFrame({"model": [k], "part": [part], "value": [value]})

    groups = _sums(frame, models, betas, per_range=False).groupBy("model", "part")
    before = np.ones((len(models), frame.ranges))
    if weighted and frame.cuts:
        logs = np.zeros(before.shape)
        for row in groups.applyInPandas(log_survival, "model int, part int, value double").collect():
            logs[row["model"], row["part"]] = row["value"]
        before[:, 1:] = np.exp(np.cumsum(logs, axis=1)[:, :-1])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        k, part, block = evaluate(rows)
        packed = _pack(block, sizes[k], before[k, part] if weighted else None)
        return pd.DataFrame({"model": [k], "part": [part], "packed": [packed]})

    result = [_pack(_evaluate(p, beta, np.zeros(0), np.zeros((0, _Layout(p).width)), np.zeros(_Layout(p).width)), p,
                    1.0 if weighted else None) for p, beta in zip(sizes, betas)]
    # In the order of the ranges, so that the sums don't depend on which task ends first.
    for row in sorted(groups.applyInPandas(pack, "model int, part int, packed array<double>").collect(), key=lambda r: r["part"]):
        result[row["model"]] = result[row["model"]] + np.array(row["packed"])
    return result


def _unpack(packed: np.ndarray, p: int):
    """Log-likelihood, score and information; the first entry counts the rows."""
    return packed[1], packed[2:2 + p], packed[2 + p:2 + p + p * p].reshape(p, p)


# -- fitting ---------------------------------------------------------------

def fit_cox(frame: SurvivalFrame, models, robust: bool = False) -> list[Fit]:
    """Fit several models in step: every Newton step of all of them is one
    pass over the pinned rows.

    Terms that depend linearly on others are left out and reported as null;
    terms that diverge are null too and their model has not converged.
    ``robust`` gives the variance clustered on the frame's cluster column.
    """
    asked = list(models)
    start = _step(frame, asked, [np.zeros(len(m.terms)) for m in asked])
    models, sums = [], []
    for model, packed in zip(asked, start):
        loglik, score, info = _unpack(packed, len(model.terms))
        dropped = dependent_columns(info)
        kept = [c for c in range(len(model.terms)) if c not in dropped]
        models.append(model.without({model.terms[c].name for c in dropped}))
        sums.append((loglik, score[kept], info[np.ix_(kept, kept)]))
    betas = [np.zeros(len(m.terms)) for m in models]
    steps = [np.zeros(len(m.terms)) for m in models]
    best = [-np.inf] * len(models)
    infos: list = [None] * len(models)
    open_models = [k for k, m in enumerate(models) if m.terms]
    for number in range(MAX_STEPS):
        if not open_models:
            break
        if number == 0:
            current = [sums[k] for k in open_models]
        else:
            packed = _step(frame, [models[k] for k in open_models], [betas[k] for k in open_models])
            current = [_unpack(v, len(models[k].terms)) for k, v in zip(open_models, packed)]
        still_open = []
        for k, (loglik, score, info) in zip(open_models, current):
            if loglik < best[k] - 1e-10 * abs(best[k]) or not np.isfinite(loglik):
                steps[k] = steps[k] / 2.0
                betas[k] = betas[k] - steps[k]
                still_open.append(k)
                continue
            infos[k], best[k] = info, loglik
            step = inverse(info) @ score
            if not np.all(np.isfinite(step)):
                continue
            if np.max(np.abs(step) * np.sqrt(np.diag(info))) > 1e-9:
                steps[k], betas[k] = step, betas[k] + step
                still_open.append(k)
        open_models = still_open
    covs = [inverse(i) if i is not None else np.zeros((0, 0)) for i in infos]
    lost = [separated(s[2], i) if i is not None else np.zeros(0, bool) for s, i in zip(sums, infos)]
    extra = [{"loglik": best[k], "model_cov": covs[k], "beta": betas[k], "fitted": models[k],
              "converged": k not in open_models and not lost[k].any()} for k in range(len(models))]
    if robust:
        for k, model in enumerate(models):
            if not model.terms:
                continue
            meat = cluster_meat(frame, model, betas[k])
            covs[k] = covs[k] @ meat @ covs[k]
    fits = []
    for k, (model, fitted) in enumerate(zip(asked, models)):
        n_frame, events = frame.counts.get(model.group, (0, 0)) if model.group is not None else (
            sum(v[0] for v in frame.counts.values()), sum(v[1] for v in frame.counts.values()))
        coef, cov = expand(fitted.names, model.names, np.where(lost[k], np.nan, betas[k]), covs[k])
        fits.append(Fit(model, coef, cov, n_frame, int(round(start[k][0])), events, extra[k]))
    return fits


# -- clustered variance ----------------------------------------------------

def _hazard_table(frame: SurvivalFrame, model: Model, beta: np.ndarray) -> DataFrame:
    """Per distinct time the cumulative hazard and hazard-weighted mean, for
    rows still at risk and for events at that time."""
    p = len(model.terms)
    schema = "time double, hazard double, mean array<double>, own_hazard double, own_mean array<double>, tied array<double>"
    spark = frame.rows.sparkSession

    def table(block: _Block, all_times: np.ndarray, base: np.ndarray) -> pd.DataFrame:
        before = np.vstack([base, base + np.cumsum(np.column_stack([block.hazard, block.hazard_mean]), axis=0)])
        at = np.searchsorted(block.time, all_times, side="right")
        event = np.isin(all_times, block.time)
        own = before[at - event] + np.where(event[:, None], np.column_stack(
            [block.own_hazard, block.own_mean])[np.maximum(at - 1, 0)], 0.0) if len(block.time) else before[at]
        tied = block.tied_mean[np.maximum(at - 1, 0)] if len(block.time) else np.zeros((len(all_times), p))
        return pd.DataFrame({
            "time": all_times, "hazard": before[at, 0], "mean": list(before[at, 1:]),
            "own_hazard": own[:, 0], "own_mean": list(own[:, 1:]), "tied": list(tied)})

    later = _later(frame, [model], [beta])[0]

    def evaluate(rows: pd.DataFrame) -> tuple[int, _Block]:
        part = int(rows["part"].iloc[0])
        return part, _evaluate(p, beta, rows["time"].to_numpy("float64"), np.stack(rows["sums"]), later[part])

    def increments(rows: pd.DataFrame) -> pd.DataFrame:
        part, block = evaluate(rows)
        return pd.DataFrame({"part": [part], "sums": [np.concatenate([[block.hazard.sum()], block.hazard_mean.sum(axis=0)])]})

    groups = _sums(frame, [model], [beta], per_range=False).groupBy("part")
    steps = np.zeros((frame.ranges, 1 + p))
    if frame.cuts:
        for row in groups.applyInPandas(increments, "part int, sums array<double>").collect():
            steps[row["part"]] = row["sums"]
    bases = np.cumsum(steps, axis=0) - steps

    def tabulate(rows: pd.DataFrame) -> pd.DataFrame:
        part, block = evaluate(rows)
        return table(block, np.unique(rows["time"].to_numpy("float64")), bases[part])

    return groups.applyInPandas(tabulate, schema)


def cluster_meat(frame: SurvivalFrame, model: Model, beta: np.ndarray) -> np.ndarray:
    """Sum over clusters of the outer product of their score residuals.

    The hazard table is joined to the rows by time, residuals are column
    expressions and clusters an ordinary grouped sum.
    """
    p = len(model.terms)
    rows = frame.rows.dropna(subset=list(model.columns))
    if model.group is not None:
        rows = rows.where(F.col("role") == model.group)
    joined = attach(rows, _hazard_table(frame, model, beta), "time", how="inner")
    centers = frame.centers.get(model.group, {})
    x = [t.expression() - F.lit(float(centers.get(t.column, 0.0)) if t.level is None else 0.0) for t in model.terms]
    linear = sum((xj * F.lit(float(b)) for xj, b in zip(x, beta)), F.lit(0.0))
    risk, event = F.exp(linear), F.col("event") == 1
    hazard = F.when(event, F.col("own_hazard")).otherwise(F.col("hazard"))
    residuals = []
    for j, xj in enumerate(x):
        mean = F.when(event, F.col("own_mean")[j]).otherwise(F.col("mean")[j])
        jump = F.when(event, xj - F.col("tied")[j]).otherwise(F.lit(0.0))
        residuals.append((F.col("n") * (jump - risk * (xj * hazard - mean))).alias(f"u{j}"))
    per_cluster = joined.select(frame.cluster, *residuals).groupBy(frame.cluster).agg(
        *[F.sum(f"u{j}").alias(f"u{j}") for j in range(p)])
    return sum_of_products(per_cluster.select(*[f"u{j}" for j in range(p)]))


# -- proportional-hazards test ---------------------------------------------

def proportional_hazards_test(frame: SurvivalFrame, fit: Fit) -> list[tuple[str, float, int, float]]:
    """Score test for an interaction of each term with 1 - survival.

    Indicators of one factor are tested together.  Returns rows of
    (term, chi-square, degrees of freedom, p), the global test last.
    """
    model, beta = fit.extra["fitted"], fit.extra["beta"]
    p = len(model.terms)
    packed = _step(frame, [model], [beta], weighted=True)[0]
    _, _, info = _unpack(packed, p)
    rest = packed[2 + p + p * p:]
    score = rest[:p]
    cross, weighted = rest[p:].reshape(2, p, p)
    columns: dict[str, list[int]] = {}
    for k, term in enumerate(model.terms):
        columns.setdefault(term.column if term.level is not None else term.name, []).append(k)
    tests = [(name, index) for name, index in columns.items()] + [("GLOBAL", list(range(p)))]
    rows = []
    for name, index in tests:
        reduced = weighted[np.ix_(index, index)] - cross[index] @ inverse(info) @ cross[:, index]
        statistic = float(score[index] @ inverse(reduced) @ score[index])
        known = np.isfinite(statistic)
        rows.append((name, statistic if known else None, len(index),
                     chi_square_tail(statistic, len(index)) if known else None))
    return rows


ZPH_SCHEMA = "term string, chisq double, df int, p_value double"
