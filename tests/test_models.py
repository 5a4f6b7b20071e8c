import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwave.functions.distributions import inverse
from pairwave.operators.cox import cluster_meat, fit_cox, proportional_hazards_test, survival_frame, _tied_sums
from pairwave.operators.design import Model, Term, dependent_columns, factor, numeric
from pairwave.operators.glm import fit_glms, model_patterns
from pairwave.plans import reports

COUNTS = {(0, 0): 2356, (1, 0): 532, (0, 1): 727, (1, 1): 412}


def counted(spark):
    cells = spark.createDataFrame([(w, h, n) for (w, h), n in COUNTS.items()], "w int, h int, n int")
    return cells.select(F.col("w").alias("dm_biomarker0_wife"), F.col("h").alias("dm_biomarker0_husb"),
                        F.explode(F.sequence(F.lit(1), "n")).alias("k")).repartition(5)


def test_crude_logit_is_the_log_odds_ratio(spark):
    fit = reports.concordance_logit(counted(spark))
    b, se = fit.estimate(fit.model.names[0])
    assert math.isclose(b, math.log(2356 * 412 / (532 * 727)), rel_tol=1e-10)
    assert math.isclose(se, math.sqrt(sum(1 / n for n in COUNTS.values())), rel_tol=1e-9)


def test_large_counts_do_not_upset_the_solver(spark):
    patterns = spark.createDataFrame([(None, h, w, n * 10**7) for (w, h), n in COUNTS.items()],
                                     "role string, y int, x int, n long")
    fit = fit_glms(patterns, "y", [Model("m", (Term("x", "x"),))])[0]
    b, se = fit.estimate("x")
    assert math.isclose(b, math.log(2356 * 412 / (532 * 727)), rel_tol=1e-9)
    assert math.isclose(se, math.sqrt(sum(1 / n for n in COUNTS.values()) / 10**7), rel_tol=1e-6)
    assert fit.n_model == 4027 * 10**7


def test_crude_poisson_with_robust_variance(spark):
    frame = counted(spark).withColumn("role", F.lit("all"))
    model = Model("m", (Term("x", "dm_biomarker0_wife"),), "all")
    patterns = model_patterns(frame, "dm_biomarker0_husb", [model])
    plain = fit_glms(patterns, "dm_biomarker0_husb", [model], "poisson")[0]
    robust = fit_glms(patterns, "dm_biomarker0_husb", [model], "poisson", robust=True)[0]
    assert math.isclose(plain.estimate("x")[0], 0.61563, rel_tol=1e-4)
    assert math.isclose(plain.estimate("x")[1], 0.06167, rel_tol=1e-3)
    p1, p0 = 412 / 944, 727 / 3083
    assert math.isclose(robust.estimate("x")[1], math.sqrt((1 - p1) / 412 + (1 - p0) / 727), rel_tol=1e-9)


def simulated(spark, seed=3, n=400, ties=True, days=60):
    rng = np.random.default_rng(seed)
    x, z = rng.integers(0, 2, n), rng.normal(50, 10, n).round(1)
    t = rng.exponential(30 / np.exp(0.5 * x + 0.02 * (z - 50)))
    t = np.ceil(np.minimum(t, days)) if ties else np.minimum(t, days) + rng.uniform(0, 1e-3, n)
    e = ((rng.uniform(size=n) < 0.8) & (t < days)).astype(int)
    g = rng.integers(1, 4, n)
    rows = [("all", float(a), int(b), int(c), float(d), int(f), int(k // 2)) for k, (a, b, c, d, f) in
            enumerate(zip(t, e, x, z, g))]
    return spark.createDataFrame(rows, "role string, time double, event int, x int, z double, g int, home int"), rows


def naive_cox(rows, columns, efron=True, steps=30):
    """Risk sets by plain loops, kept apart from the implementation."""
    t = np.array([r[1] for r in rows])
    e = np.array([r[2] for r in rows])
    x = np.array([[float(c(r)) for c in columns] for r in rows])
    center = x.mean(axis=0)
    x = x - center
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        score, info = np.zeros_like(b), np.zeros((len(b), len(b)))
        residuals = np.zeros_like(x)
        r = np.exp(x @ b)
        for s in np.unique(t[e == 1]):
            risk, dead = t >= s, (t == s) & (e == 1)
            d = dead.sum()
            for l in range(d):
                f = l / d if efron else 0.0
                w = r * risk - f * r * dead
                q = w.sum()
                mean = w @ x / q
                score += x[dead].mean(axis=0) - mean
                info += (x * w[:, None]).T @ x / q - np.outer(mean, mean)
                residuals += dead[:, None] * (x - mean) / d - (w / q)[:, None] * (x - mean)
        step = np.linalg.solve(info, score)
        b = b + step
        if np.abs(step).max() < 1e-12:
            break
    return b, info, residuals


LINEAR = [lambda r: r[3], lambda r: r[4], lambda r: r[5] == 2, lambda r: r[5] == 3]
TERMS = (Term("x", "x"), *numeric("z"), *factor("g", (1, 2, 3)))


@pytest.mark.parametrize("ties", [True, False])
def test_cox_equals_the_naive_fit(spark, ties):
    frame, rows = simulated(spark, ties=ties)
    b, info, _ = naive_cox(rows, LINEAR)
    fit = fit_cox(survival_frame(frame, "time", "event", ("x", "z", "g")), [Model("m", TERMS, "all")])[0]
    assert np.allclose(fit.coef, b, atol=1e-8) and np.allclose(inverse(fit.cov), info, rtol=1e-6)
    assert (fit.n_frame, fit.n_model, fit.events) == (400, 400, sum(r[2] for r in rows))


def test_efron_equals_breslow_without_ties(spark):
    frame, rows = simulated(spark, ties=False)
    b, _, _ = naive_cox(rows, LINEAR, efron=False)
    fit = fit_cox(survival_frame(frame, "time", "event", ("x", "z", "g")), [Model("m", TERMS, "all")])[0]
    assert np.allclose(fit.coef, b, atol=1e-8)


def test_ranges_of_time_give_the_same_fit(spark):
    frame, _ = simulated(spark, n=600)
    model = Model("m", TERMS, "all")
    whole = survival_frame(frame, "time", "event", ("x", "z", "g"), cluster="home")
    cut = survival_frame(frame, "time", "event", ("x", "z", "g"), cluster="home", times_per_range=7)
    assert whole.ranges == 1 and cut.ranges >= 5
    a, b = fit_cox(whole, [model], robust=True)[0], fit_cox(cut, [model], robust=True)[0]
    assert np.allclose(a.coef, b.coef, atol=1e-10) and np.allclose(a.cov, b.cov, rtol=1e-8)
    for one, other in zip(proportional_hazards_test(whole, a), proportional_hazards_test(cut, b)):
        assert one[0] == other[0] and math.isclose(one[1], other[1], rel_tol=1e-8)


def test_a_time_of_a_third_of_the_rows_and_short_ranges(spark):
    frame, rows = simulated(spark, n=500)
    rows = [(*r[:1], 3.0, *r[2:]) if k % 3 == 0 else r for k, r in enumerate(rows)]
    frame = spark.createDataFrame(rows, frame.schema).repartition(6)
    b, info, _ = naive_cox(rows, LINEAR)
    survival = survival_frame(frame, "time", "event", ("x", "z", "g"), times_per_range=1)
    assert 6 <= survival.ranges <= 10  # the square root of the number of times
    fit = fit_cox(survival, [Model("m", TERMS, "all")])[0]
    assert np.allclose(fit.coef, b, atol=1e-8) and np.allclose(inverse(fit.cov), info, rtol=1e-6)


@pytest.mark.parametrize("per_range", [1, 5_000])
def test_cox_without_rows_or_with_missing_times(spark, per_range):
    frame, rows = simulated(spark, n=300)
    make = lambda f: survival_frame(f, "time", "event", ("x", "z", "g"), cluster="home", times_per_range=per_range)
    none = fit_cox(make(frame.limit(0)), [Model("m", TERMS, "all")], robust=True)[0]
    assert (none.n_frame, none.n_model, none.events) == (0, 0, 0) and none.ratio("x", 1.96) == (None, None, None, None)
    holes = frame.withColumn("time", F.when(F.col("home") % 4 != 0, F.col("time"))).withColumn("sums", F.lit("x"))
    fit = fit_cox(make(holes), [Model("m", TERMS, "all")])[0]
    kept = naive_cox([r for r in rows if r[6] % 4], LINEAR)[0]
    assert np.allclose(fit.coef, kept, atol=1e-8) and fit.n_frame == sum(r[6] % 4 != 0 for r in rows)


def test_clustered_variance(spark):
    frame, rows = simulated(spark)
    b, info, residuals = naive_cox(rows, LINEAR)
    model = Model("m", TERMS, "all")
    homes = np.array([r[6] for r in rows])
    by_home = np.array([residuals[homes == h].sum(axis=0) for h in np.unique(homes)])
    inner = np.linalg.inv(info)
    fit = fit_cox(survival_frame(frame, "time", "event", ("x", "z", "g"), cluster="home"), [model], robust=True)[0]
    assert np.allclose(fit.cov, inner @ by_home.T @ by_home @ inner, rtol=1e-6)
    alone = frame.withColumn("own", F.monotonically_increasing_id())
    lone = survival_frame(alone, "time", "event", ("x", "z", "g"), cluster="own")
    assert np.allclose(cluster_meat(lone, model, b), residuals.T @ residuals, rtol=1e-6)


def test_sessions_without_arrow_conversion(spark):
    frame, _ = simulated(spark, n=120)
    model = Model("m", TERMS, "all")
    fits = []
    for enabled in ("true", "false"):
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", enabled)
        rows = survival_frame(frame, "time", "event", ("x", "z", "g"), cluster="home")
        fits.append(fit_cox(rows, [model], robust=True)[0])
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    assert np.allclose(fits[0].cov, fits[1].cov)


def test_a_separating_covariate_does_not_fail(spark):
    rows = [("all", float(k + 1), int(k < 5), float(k < 5)) for k in range(10)]
    frame = spark.createDataFrame(rows, "role string, time double, event int, x double")
    fit = fit_cox(survival_frame(frame, "time", "event", ("x",)), [Model("m", numeric("x"), "all")])[0]
    ratio = fit.ratio("x", 1.96)
    assert ratio[0] is None or ratio[0] > 1000


def test_partitioning_does_not_change_the_fit(spark):
    frame, _ = simulated(spark)
    model = Model("m", TERMS, "all")
    fits = [fit_cox(survival_frame(frame.repartition(k), "time", "event", ("x", "z", "g")), [model])[0] for k in (1, 9)]
    assert np.allclose(fits[0].coef, fits[1].coef, atol=1e-12)


def test_models_with_missing_covariates_and_dependent_terms(spark):
    frame, rows = simulated(spark)
    frame = frame.withColumn("z", F.when(F.col("home") % 10 != 0, F.col("z"))).withColumn("same", 1 - F.col("x"))
    survival = survival_frame(frame, "time", "event", ("x", "z", "same"))
    plain, short, twice = fit_cox(survival, [
        Model("x", (Term("x", "x"),), "all"), Model("z", numeric("x", "z"), "all"), Model("d", numeric("x", "same"), "all")])
    assert plain.n_model == 400 and short.n_frame == 400 and short.n_model == 360
    assert twice.ratio("same", 1.96) == (None, None, None, None) and math.isclose(twice.coef[0], plain.coef[0])
    assert twice.ratio("absent", 1.96) == (None, None, None, None)
    kept = naive_cox([r for r in rows if r[6] % 10], LINEAR[:2])[0]
    assert np.allclose(short.coef, kept, atol=1e-8)


def test_single_event_and_event_at_time_zero(spark):
    rows = [("all", 0.0, 1, 1.0), ("all", 2.0, 0, 0.0), ("all", 3.0, 0, 2.0)]
    frame = spark.createDataFrame(rows, "role string, time double, event int, x double")
    fit = fit_cox(survival_frame(frame, "time", "event", ("x",)), [Model("m", numeric("x"), "all")])[0]
    # One event with the middle covariate: the likelihood peaks where the weighted mean is 1.
    assert math.isclose(fit.coef[0], 0.0, abs_tol=1e-9) and fit.events == 1


def test_tied_sums_equal_direct_summation():
    for d in (1, 2, 127, 128, 129, 200, 5_000, 300_000):
        for ratio in (1.0, 1 + 1e-9, 1.01, 1.9, 2.1, 50, 1e6):
            e = 0.7 * d
            s, f = np.longdouble(e * ratio), np.arange(d, dtype=np.longdouble) / d
            q = s - f * np.longdouble(e)
            want = [float(np.sum(v)) for v in (np.log(q), 1 / q, f / q, 1 / q**2, f / q**2, f**2 / q**2)]
            got = _tied_sums(np.array([float(d)]), np.array([e * ratio]), np.array([e]))[0]
            assert np.allclose(got, want, rtol=1e-10, atol=1e-10), (d, ratio)


def test_tied_sums_of_many_events_take_no_time():
    start = time.perf_counter()
    _tied_sums(np.array([1e9]), np.array([3e9]), np.array([1e9]))
    assert time.perf_counter() - start < 0.5


def test_logistic_equals_newton_and_scores_vanish(spark):
    frame, rows = simulated(spark)
    model = Model("m", TERMS, "all")
    fit = fit_glms(model_patterns(frame, "event", [model]), "event", [model])[0]
    x = np.array([[1.0, *(float(c(r)) for c in LINEAR)] for r in rows])
    y = np.array([r[2] for r in rows], float)
    beta = np.array([fit.extra["intercept"], *fit.coef])
    mu = 1 / (1 + np.exp(-x @ beta))
    assert np.allclose(x.T @ (y - mu) / len(y), 0, atol=1e-7)
    cov = np.linalg.inv((x * (mu * (1 - mu))[:, None]).T @ x)
    assert np.allclose(np.sqrt(np.diag(fit.cov)), np.sqrt(np.diag(cov))[1:], rtol=1e-6)


def test_dependent_columns_in_order():
    x = np.array([[1, 0, 1, 2.0], [1, 1, 0, 0.5], [1, 0, 1, 1.0], [1, 1, 0, 3.0]])
    assert dependent_columns(x.T @ x) == [2]
    assert dependent_columns(np.diag([1.0, 0.0, 2.0])) == [1]
