"""Model tables: which models are fitted on which frame, and how they print."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwave.functions.distributions import NORMAL_975
from pairwave.functions.joins import first_per_key, null_safe_left_join
from pairwave.operators.cox import (
    ZPH_SCHEMA, fit_cox, proportional_hazards_test, survival_frame)
from pairwave.operators.design import Fit, Model, Term, factor, levels_of, numeric, term_table
from pairwave.operators.glm import Z, fit_glms, model_patterns
from pairwave.sources.reports import literal_table

ROLES = ("Women", "Men")
PARTNER = Term("partner_dm_statusDiabetes", "partner_baseline_dm", 1)
MODEL_NAMES = ("Age adjusted", "Model 1", "Model 2")
# Fixed covariate lists of the published models.
MODEL_1 = ("edu_category", "famhx_dm")
MODEL_2 = (*MODEL_1, "morbidity_category", "bmi_category")
BEHAVIOURS = {"Women": (), "Men": ("alc_overall", "smk_overall")}


def model_frame(roles: DataFrame, with_time: bool = False) -> DataFrame:
    """Baseline event-free members with known partner status and outcome."""
    frame = roles.where(F.col("baseline_dm") == 0).dropna(subset=["partner_baseline_dm", "dm_incident"])
    return frame.where(F.col("time_to_dm") >= 0) if with_time else frame


def nested_models(levels: dict, behaviours=None) -> list[Model]:
    """Age-adjusted model, Model 1 and Model 2 for each role, factors coded."""
    behaviours = BEHAVIOURS if behaviours is None else behaviours
    models = []
    for role in ROLES:
        base = (PARTNER, *numeric("age"))
        for name, covariates in zip(MODEL_NAMES, ((), MODEL_1, (*MODEL_2, *behaviours[role]))):
            coded = [t for c in covariates for t in factor(c, levels.get((role, c), ()))]
            models.append(Model(name, (*base, *coded), role))
    return models


def fit_partner_glms(roles: DataFrame, family: str = "binomial", robust: bool = False) -> list[Fit]:
    """The three nested models per role, on one set of covariate patterns."""
    covariates = tuple(dict.fromkeys((*MODEL_2, *BEHAVIOURS["Men"])))
    probe = [Model("all", (PARTNER, *numeric("age", *covariates)), role) for role in ROLES]
    patterns = model_patterns(model_frame(roles), "dm_incident", probe)
    models = nested_models(levels_of(patterns, covariates))
    return fit_glms(patterns, "dm_incident", models, family, robust)


def fit_crude_rr(roles: DataFrame) -> list[Fit]:
    """Risk ratio by partner status alone, robust variance, per role."""
    models = [Model("Crude", (PARTNER,), role) for role in ROLES]
    patterns = model_patterns(model_frame(roles), "dm_incident", models)
    return fit_glms(patterns, "dm_incident", models, "poisson", robust=True)


def partner_counts(roles: DataFrame, with_time: bool = False) -> dict:
    rows = model_frame(roles, with_time).groupBy("role", "partner_baseline_dm").count().collect()
    return {(r["role"], int(r["partner_baseline_dm"])): r["count"] for r in rows}


def estimate_rows(fits, z: float = Z) -> list[tuple]:
    return [(f.model.group, f.model.name, *f.ratio(PARTNER.name, z)[:3], f.n_frame, f.n_model, f.converged) for f in fits]


def estimate_table(spark, fits, z: float = Z) -> DataFrame:
    """Numeric partner estimates: one row per role and model."""
    return literal_table(spark, estimate_rows(fits, z),
                         "sex string, model string, ratio double, low double, high double, "
                         "n_frame bigint, n_model bigint, converged boolean")


def ratio_text(ratio, low, high) -> str:
    return "NA" if ratio is None else f"{ratio:.2f} ({low:.2f} - {high:.2f})"


def ratio_table(spark, fits, counts: dict, measure: str = "OR", z: float = Z, totals: dict | None = None) -> DataFrame:
    """Printed layout: a reference row of 1.00 and the estimates below it."""
    rows = []
    for role in ROLES:
        mine = [f for f in fits if f.model.group == role]
        total = (totals or {}).get(role, sum(counts.get((role, k), 0) for k in (0, 1)))
        label = f"{role} without diabetes at baseline (n={total})"
        texts = [ratio_text(*f.ratio(PARTNER.name, z)[:3]) for f in mine]
        rows.append((len(rows), label, f"No diabetes (n={counts.get((role, 0), 0)})", *["1.00"] * len(mine)))
        rows.append((len(rows), label, f"Diabetes (n={counts.get((role, 1), 0)})", *texts))
    columns = ", ".join(f"`{n}{'' if k == 0 else ' adjusted'} {measure} (95% CI)` string"
                        for k, n in enumerate(MODEL_NAMES))
    return literal_table(spark, rows, "position int, `Individual's status at baseline` string, "
                         "`Individuals with following partner's status at baseline` string, " + columns)


def concordance_logit(dyads: DataFrame, outcome: str = "dm_biomarker0") -> Fit:
    """Husband's baseline status on the wife's, one binary term."""
    couples = dyads.select(
        F.lit(None).cast("string").alias("role"), f"{outcome}_husb", f"{outcome}_wife").dropna(
        subset=[f"{outcome}_husb", f"{outcome}_wife"])
    model = Model("concordance", (Term(f"{outcome}_wife (1 vs 0)", f"{outcome}_wife"),))
    patterns = model_patterns(couples, f"{outcome}_husb", [model], group=None)
    return fit_glms(patterns, f"{outcome}_husb", [model])[0]


# -- Cox -------------------------------------------------------------------

SPOUSE = Term("partner_baseline_dm", "partner_baseline_dm")
# Fixed model names and covariates, numeric as published.
COX_MODELS = (
    ("spouse status", ()),
    ("spouse status + age", ("age",)),
    ("spouse status + Model 1", ("age", "edu_category", "famhx_dm")),
    ("spouse status + Model 2", ("age", "edu_category", "famhx_dm", "morbidity_category", "bmi_category")))
COX_LABELS = {"Women": "Female", "Men": "Male"}


def fit_spouse_cox(roles: DataFrame) -> list[Fit]:
    """Crude and adjusted models per role with numeric covariates."""
    at_risk = roles.where((F.col("baseline_dm") == 0) & (F.col("dyad_at_risk") == 1))
    models = []
    for role in ROLES:
        for name, covariates in COX_MODELS:
            if covariates and name.endswith("Model 2"):
                covariates = (*covariates, *reversed(BEHAVIOURS[role]))
            models.append(Model(f"{COX_LABELS[role]}: {name}", (SPOUSE, *numeric(*covariates)), role))
    columns = dict.fromkeys(c for m in models for c in m.columns)
    frame = survival_frame(at_risk, "time_to_dm", "dm_incident", columns)
    return fit_cox(frame, models)


def spouse_cox_table(spark, fits) -> DataFrame:
    """Model, n, events and the spouse hazard ratio with limits and p-value."""
    rows = [(k, f.model.name, f.n_frame, f.n_model, f.events, *f.ratio(SPOUSE.name, NORMAL_975), f.converged)
            for k, f in enumerate(fits)]
    return literal_table(spark, rows, "position int, model string, n bigint, n_model bigint, events bigint, "
                         "hr_spouse double, hr_lcl double, hr_ucl double, p_value double, converged boolean")


BASELINE_FACTORS = ("sex", "edu_category", "employ_category", "hhincome", "site", "carrs", "famhx_dm")


def baseline_covariates(long: DataFrame) -> DataFrame:
    """Baseline rows' covariates, one row per (study, person)."""
    columns = ("sex", "age", "edu_category", "employ_category", "hhincome", "site", "famhx_dm", "baseline_dm")
    rows = long.where(F.col("fup") == 0).select(
        "carrs", "pid", "hhid", F.col("bmi").alias("bmi_baseline"), *columns)
    return first_per_key(rows, ("carrs", "pid"), ("hhid",))


def event_frame(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """Event rows with time-fixed baseline covariates of people at risk."""
    joined = null_safe_left_join(events.select("carrs", "pid", "hhid", "dm_incident", "time_to_dm"), baseline,
                                 ("carrs", "pid", "hhid"))
    return joined.where((F.col("baseline_dm") == 0) & (F.col("time_to_dm") >= 0)).dropna(subset=["dm_incident"])


def fit_clustered_cox(frame: DataFrame, cluster: str = "hhid"):
    """Main model of the longitudinal variant with household-clustered variance."""
    covariates = ("age", "bmi_baseline", *BASELINE_FACTORS)
    rows = survival_frame(frame, "time_to_dm", "dm_incident", covariates, group=None, cluster=cluster,
                          factors=BASELINE_FACTORS)
    terms = [*factor("sex", rows.levels[None, "sex"]), *numeric("age", "bmi_baseline")]
    for c in BASELINE_FACTORS[1:]:
        terms += factor(c, rows.levels[None, c])
    return rows, fit_cox(rows, [Model("clustered", tuple(terms))], robust=True)[0]


def hazard_ratio_table(spark, fit: Fit) -> DataFrame:
    return term_table(spark, [fit], NORMAL_975).select(
        "position", "term", F.col("ratio").alias("hazard_ratio"), F.col("conf_low").alias("conf_low_95"),
        F.col("conf_high").alias("conf_high_95"), "p_value", "converged")


def without_smallest(table: DataFrame, n: int = 2, by: str = "hazard_ratio", key: str = "term") -> DataFrame:
    """Drop the n rows with the smallest value; the table has one row per model term."""
    smallest = table.orderBy(F.col(by).asc_nulls_last(), key).limit(n).select(key)
    return table.join(smallest, key, "left_anti")


def zph_table(spark, rows, fit: Fit) -> DataFrame:
    return literal_table(spark, proportional_hazards_test(rows, fit), ZPH_SCHEMA)


def wave_roles(waves: DataFrame, events: DataFrame) -> DataFrame:
    """Role view of the baseline dyad waves with each member's outcome."""
    baseline = waves.where(F.col("fup") == 0)
    outcome = first_per_key(events.select("carrs", "pid", "time_to_dm", "dm_incident"), ("carrs", "pid"), ("time_to_dm",))
    columns = ("age", "edu_category", "famhx_dm", "morbidity_category", "bmi_category")
    views = [F.struct(
        F.lit(role).alias("role"), "hhid", "carrs", F.col(f"{own}_pid").alias("pid"),
        F.col(f"{own}_baseline_dm").alias("baseline_dm"),
        F.col(f"{partner}_baseline_dm").alias("partner_baseline_dm"),
        *[F.col(f"{own}_{c}").alias(c) for c in columns])
        for role, own, partner in (("Women", "female", "male"), ("Men", "male", "female"))]
    roles = baseline.select(F.inline(F.array(*views))).distinct()
    return roles.join(outcome, ["carrs", "pid"], "left")


def fit_partner_cox(roles: DataFrame) -> list[Fit]:
    """Cox by partner status with factor covariates, three models per role."""
    frame = survival_frame(model_frame(roles, with_time=True), "time_to_dm", "dm_incident",
                           ("partner_baseline_dm", "age", *MODEL_2), factors=MODEL_2)
    return fit_cox(frame, nested_models(frame.levels, {role: () for role in ROLES}))
