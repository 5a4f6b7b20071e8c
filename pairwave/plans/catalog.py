"""Every registered query: a function of (session, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwave.functions.distributions import NORMAL_975
from pairwave.operators import describe, dyads, events, households, recode, visits
from pairwave.operators.design import term_table
from pairwave.operators.glm import Z
from pairwave.plans import archive, current, reports
from pairwave.session import checkpoint_folder, pin
from pairwave.sources import cohort, tables
from pairwave.sources.reports import read_report, write_report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PERSON_WAVE = ("pid", "carrs", "fup")
MODEL_CASE_COLUMNS = ("age", "sex", "edu_category", "famhx_dm")
WAVE_VALUES = ("pid", "age", "edu_category", "famhx_dm", "morbidity_category", "bmi_category", "baseline_dm",
               "dm_biomarker", "dm_incident", "time_to_dm")


def comparable(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and dates as text, so that engines agree on the values."""
    forms = {"double": f"round({{0}}, {digits}) + 0D as {{0}}", "date": "cast({0} as string) as {0}"}
    return frame.selectExpr(*[forms.get(kind, "{0}").format(f"`{c}`") for c, kind in frame.dtypes])


def query(function: Query, digits: int = 6) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return comparable(function(spark, folder), digits)

    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return run


# Biomarker values have seven decimals; rounding them to six would meet ties.
exact_query = partial(query, digits=9)


# -- inputs shared by the queries --------------------------------------------

def _analytic(spark, folder):
    return current.analytic_wide(cohort.visit(spark, folder), cohort.baseline(spark, folder),
                                 cohort.dyad_flags(spark, folder))


def _dyads(spark, folder):
    return current.dyads(cohort.visit(spark, folder), cohort.baseline(spark, folder),
                         cohort.dyad_flags(spark, folder))


def _roles(spark, folder):
    return dyads.role_view(_dyads(spark, folder))


def _dated(spark, folder):
    return archive.dated_visits(cohort.visit_extra(spark, folder))


def _recoded_visits(spark, folder):
    return recode.recode_visit_covariates(_dated(spark, folder))


def _extra_outcomes(spark, folder):
    return current.visit_outcomes(cohort.visit_extra(spark, folder))


def _model_couples(spark, folder):
    """Visits of complete couples with their event columns, and the event rows."""
    couples = archive.complete_couples(_dated(spark, folder), MODEL_CASE_COLUMNS)
    long = pin(archive.event_rows(recode.recode_visit_covariates(couples)))
    return long, long.where("dm_incident is not null").select("carrs", "pid", "hhid", "dm_incident", "time_to_dm")


# -- visits ------------------------------------------------------------------

@exact_query
def visit_outcomes(spark, folder):
    """Completion, visit date and the three outcome definitions."""
    return current.visit_outcomes(cohort.visit(spark, folder)).drop("doi", "reason")


@query
def archive_outcomes(spark, folder):
    """Response flag, biomarker waves and the response-gated outcomes."""
    flagged = visits.flag_response(cohort.visit_extra(spark, folder))
    return visits.define_gated_outcomes(visits.keep_schedule(flagged)).select(
        *PERSON_WAVE, "respond", "dm_self_report", "dm_biomarker")


@query
def missingness_profile(spark, folder):
    """Missing biomarkers per study and visit."""
    return visits.missingness_profile(cohort.visit(spark, folder))


@exact_query
def visits_wide(spark, folder):
    """Ten outcome columns spread over four main visits."""
    return visits.visits_to_wide(current.visit_outcomes(cohort.visit(spark, folder)))


@query
def trim_nonresponse(spark, folder):
    """Waves up to a person's last response."""
    flagged = visits.flag_response(cohort.visit_extra(spark, folder))
    return visits.trim_trailing_nonresponse(flagged).select(*PERSON_WAVE, "respond", "reason")


@query
def impute_visit_date(spark, folder):
    """Responders' missing dates replaced by the wave midpoint."""
    main = archive.main_visits(cohort.visit_extra(spark, folder))
    return visits.impute_visit_dates(main).select(*PERSON_WAVE, "respond", "doi", "doi_day")


@query
def locf_midpoint(spark, folder):
    """Baseline day, last observation carried forward, prior day, midpoint."""
    linked = visits.carry_forward(_dated(spark, folder), "doi_day")
    return linked.select(*PERSON_WAVE, "doi_day", "baseline_day", "doi_day_last_obs", "prior_day", "midpoint_day")


# -- baseline, eligibility, events, recodes ------------------------------------

@query
def baseline_clean(spark, folder):
    """Sites 1 and 2 with labels, derived BMI and year."""
    return recode.clean_baseline(cohort.baseline(spark, folder))


@exact_query
def analytic_wide(spark, folder):
    """Baseline people with wide outcomes and dyad flag."""
    return _analytic(spark, folder)


@query
def eligibility_flags(spark, folder):
    """Household rule, data availability, cohort and at-risk flags."""
    return households.eligibility_flags(_analytic(spark, folder)).select(
        "pid", "hhid", "sum_spouse", "count_hh", "valid_dyad", "baseline_bio_all", "baseline_bio_one",
        "baseline_self", "nfollowup", "onefollowup", "completefollowup", "onefollowupbio",
        "completefollowupbio", "biocohort", "valid_at_risk")


@query
def first_event(spark, folder):
    """First follow-up event, status and event-or-censor date."""
    return events.find_first_event(_analytic(spark, folder)).select(
        "pid", "firstvisit_DMbiomarker", "event_DMbiomarker", "DateDMbiomarker")


@query
def recoded_covariates(spark, folder):
    """Education, occupation, BMI and multimorbidity categories."""
    return recode.recode_covariates(_analytic(spark, folder)).select(
        "pid", "educcat", "educcat2", "employocccat", "bmicat", "bmicat2", "htn", "dm", "chd", "cva", "ckd",
        "multimorbidity", "multimorbiditycat", "multimorbiditycat2")


@query
def archive_recodes(spark, folder):
    """Per-visit blood pressure, conditions, behaviours and categories."""
    return _recoded_visits(spark, folder).select(
        *PERSON_WAVE, "sbp", "dbp", "overweight", "hypertension", "high_tg", "chd", "morbidity_number",
        "morbidity_category", "famhx_cvd", "famhx_htn", "famhx_dm", "alc_overall", "smk_overall", "bmi_category")


@query
def event_or_censor_long(spark, folder):
    """Visits with the person's event or censor row and baseline status."""
    return archive.event_rows(_recoded_visits(spark, folder)).select(
        *PERSON_WAVE, "hhid", "dm_biomarker", "dm_incident", "dm_incident_day", "time_to_dm", "baseline_dm")


@query
def baseline_ids(spark, folder):
    """People known to have, or to be free of, the event at baseline."""
    recoded = _extra_outcomes(spark, folder)
    return events.baseline_ids(recoded, event=True).withColumn("baseline_event", F.lit(1)).unionByName(
        events.baseline_ids(recoded, event=False).withColumn("baseline_event", F.lit(0)))


@query
def event_or_censor(spark, folder):
    """One event or censor row per person free of the event at baseline."""
    return events.event_or_censor(_recoded_visits(spark, folder))


@query
def annotated_visits(spark, folder):
    """Event rows joined back on the visits by study, wave, person and household."""
    recoded = _recoded_visits(spark, folder)
    return events.annotate_events(recoded, events.event_or_censor(recoded)).select(
        *PERSON_WAVE, "hhid", "dm_biomarker", "dm_incident", "dm_incident_day", "time_to_dm", "baseline_dm")


@query
def person_event_summary(spark, folder):
    """Follow-up event, its first date and baseline status of valid spouses."""
    spouses = households.keep_spouses(households.distinct_member_dyads(
        _extra_outcomes(spark, folder)), valid="valid_dyad")
    measured = spouses.where(F.col("visit").isNotNull())
    return events.person_event_summary(measured).drop("_n")


@query
def biomarker_available(spark, folder):
    """People measured at baseline and at least once later."""
    return households.biomarker_available(_extra_outcomes(spark, folder).where("visit is not null"))


# -- households and dyads ------------------------------------------------------

@query
def distinct_member_dyads(spark, folder):
    """Valid dyads by distinct members of a household."""
    return households.distinct_member_dyads(cohort.visit_extra(spark, folder)).select(
        *PERSON_WAVE, "hhid", "valid_dyad")


@query
def followup_completeness(spark, folder):
    """Distinct main visits per person against the study's plan."""
    return households.followup_completeness(cohort.visit(spark, folder))


@query
def household_composition(spark, folder):
    """Visits of households with exactly one male and one female member."""
    return households.keep_mixed_couples(cohort.visit_extra(spark, folder)).select(*PERSON_WAVE, "hhid", "sex")


@query
def age_gap_filter(spark, folder):
    """Visits of two-person households close in age."""
    return households.keep_close_in_age(cohort.visit_extra(spark, folder)).select(*PERSON_WAVE, "hhid", "age")


@query
def members_histogram(spark, folder):
    """Households by number of distinct members."""
    return households.members_histogram(cohort.visit(spark, folder))


@query
def complete_cases(spark, folder):
    """Spouses' visits restricted to people with complete baseline covariates."""
    spouses = households.keep_spouses(_dated(spark, folder))
    return households.keep_complete_persons(spouses, archive.COMPLETE_CASE_COLUMNS).select(*PERSON_WAVE, "hhid")


@query
def complete_persons(spark, folder):
    """Distinct spouses with complete baseline covariates, as a semi-join key."""
    spouses = households.keep_spouses(cohort.visit_extra(spark, folder))
    ids = households.complete_persons(spouses, MODEL_CASE_COLUMNS)
    return households.keep_persons(cohort.person(spark, folder), ids).select("pid", "hhid", "age")


@query
def complete_couples(spark, folder):
    """Complete cases in mixed couples close in age."""
    return archive.complete_couples(_dated(spark, folder)).select(*PERSON_WAVE, "hhid", "sex", "age")


@query
def dyad_table(spark, folder):
    """Husband and wife side by side with at-risk flags."""
    return _dyads(spark, folder)


@query
def cohort_household_summary(spark, folder):
    """Cohort members per household."""
    people = current.cohort_persons(current.recoded_persons(_analytic(spark, folder)))
    return households.household_summary(people, flag="biocohort", total="sum_biocohort")


@query
def dyad_waves_wide(spark, folder):
    """Both members of a household side by side per wave."""
    long = archive.event_rows(_recoded_visits(spark, folder)).select("hhid", "carrs", "fup", "sex", *WAVE_VALUES)
    return dyads.members_to_wide(long)


@query
def wave_dyads_at_risk(spark, folder):
    """At-risk flags of baseline dyad waves."""
    recoded = recode.recode_visit_covariates(_extra_outcomes(spark, folder))
    waves = dyads.members_to_wide(recoded.select(
        "hhid", "carrs", "fup", "sex", "pid", "dm_biomarker", *dyads.WAVE_COVARIATES, *dyads.WAVE_BEHAVIOURS))
    return dyads.flag_waves_at_risk(waves).select(
        "hhid", "carrs", "female_pid", "male_pid", "dyad_at_risk", "female_at_risk", "male_at_risk")


@query
def event_free_couples(spark, folder):
    """Baseline rows of couples with an event-free member."""
    recoded = recode.recode_visit_covariates(_extra_outcomes(spark, folder))
    long = recoded.withColumn("dm_biomarker0", F.when(F.col("fup") == 0, F.col("dm_biomarker")))
    waves = dyads.members_to_wide(long.select("hhid", "carrs", "fup", "sex", "pid", "age", "dm_biomarker0"))
    return dyads.event_free_couples(waves)


@query
def role_view(spark, folder):
    """The dyads seen from each member."""
    return _roles(spark, folder)


# -- descriptive tables ----------------------------------------------------------

@query
def risk_by_partner(spark, folder):
    """Incident outcome by partner's baseline status."""
    return describe.risk_by_partner(_roles(spark, folder))


@query
def risk_report(spark, folder):
    """The same as printed text."""
    return describe.risk_report(describe.risk_by_partner(_roles(spark, folder)))


@query
def mean_table(spark, folder):
    """Mean, sum and errors of the event by partner status."""
    at_risk = _roles(spark, folder).where("baseline_dm = 0")
    return describe.mean_table(at_risk, "dm_incident", ("role", "partner_baseline_dm"))


@query
def ratio_table(spark, folder):
    """Events per year of follow-up by partner status."""
    at_risk = _roles(spark, folder).where("baseline_dm = 0")
    return describe.ratio_table(at_risk, "dm_incident", "time_to_dm", ("role", "partner_baseline_dm"))


@query
def incidence_report(spark, folder):
    """Risk and incidence per 100 person-years with t-limits."""
    return describe.incidence_report(_roles(spark, folder))


@query
def events_with_rates(spark, folder):
    """Mean and ratio tables joined on group, variable and N."""
    at_risk = _roles(spark, folder).where("baseline_dm = 0")
    groups = ("role", "partner_baseline_dm")
    return describe.join_events_and_rates(
        describe.mean_table(at_risk, "dm_incident", groups, limits=False),
        describe.ratio_table(at_risk, "dm_incident", "time_to_dm", groups, limits=False), groups)


@query
def continuous_summary(spark, folder):
    """Mean, SD, missing share and correlation of partners."""
    return describe.continuous_summary(_dyads(spark, folder))


@query
def binary_summary(spark, folder):
    """Counts and percentages of binary variables."""
    return describe.binary_summary(_dyads(spark, folder))


@query
def level_shares(spark, folder):
    """Level shares of categorical variables."""
    return describe.level_shares(_dyads(spark, folder))


@query
def contingency(spark, folder):
    """Observed pairs of partners' education."""
    return describe.contingency(_dyads(spark, folder), "educcat_wife", "educcat_husb")


@query
def concordance_cells(spark, folder):
    """Partners' baseline status with percentages and cell text."""
    return describe.concordance_cells(_dyads(spark, folder))


@query
def concordance_display(spark, folder):
    """The cell texts as a grid."""
    return describe.concordance_display(describe.concordance_cells(_dyads(spark, folder)))


@query
def fisher_by_variable(spark, folder):
    """Exact odds ratio between partners per binary variable."""
    return describe.fisher_by_variable(_dyads(spark, folder))


@query
def chi_square(spark, folder):
    """Chi-square of level by role."""
    return describe.chi_square(_dyads(spark, folder))


@query
def table_one(spark, folder):
    """The descriptive table as printed."""
    return describe.table_one(pin(_dyads(spark, folder)))


# -- sources and stages --------------------------------------------------------------

def _staged(spark, frame, name) -> str:
    """Write a stage under a name of its own in the shared folder."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid4().hex}"
    tables.write_stage(frame, path)
    return path


@exact_query
def visits_source(spark, folder):
    """The visit table as a stage, read back with its schema and checked key."""
    return tables.read_visits(spark, _staged(spark, cohort.visit(spark, folder), "visits"))


@query
def baseline_source(spark, folder):
    """The baseline table as a stage, read back with its schema."""
    return tables.read_baseline(spark, _staged(spark, cohort.baseline(spark, folder), "baseline"))


@query
def dyad_flags_source(spark, folder):
    """The dyad flags as a stage, read back with their schema."""
    return tables.read_dyad_flags(spark, _staged(spark, cohort.dyad_flags(spark, folder), "flags"))


@query
def staged_outcomes(spark, folder):
    """A stage that continues from the one before: outcomes, then visits per wave and outcome."""
    outcomes = tables.read_stage(spark, _staged(spark, current.visit_outcomes(cohort.visit(spark, folder)), "outcomes"))
    return outcomes.groupBy("carrs", "fup", "dm_biomarker").agg(F.count(F.lit(1)).alias("n"))


@query
def report_round_trip(spark, folder):
    """A report written as CSV in order and read back."""
    path = f"{checkpoint_folder(spark)}/report-{uuid4().hex}"
    write_report(households.members_histogram(cohort.visit(spark, folder)), path, order=["n_pid"])
    return read_report(spark, path, "n_pid bigint, Freq bigint")


@query
def analytic_long(spark, folder):
    """The longitudinal chain end to end: visits of complete couples with events and baseline status."""
    return archive.analytic_long(cohort.visit_extra(spark, folder)).select(
        *PERSON_WAVE, "hhid", "dm_biomarker", "dm_incident", "dm_incident_day", "time_to_dm", "baseline_dm",
        "morbidity_category", "bmi_category")


@query
def analytic_waves(spark, folder):
    """Its last step: both members of a couple side by side per wave."""
    long = archive.analytic_long(cohort.visit_extra(spark, folder))
    return archive.analytic_waves(long.select("hhid", "carrs", "fup", "sex", *WAVE_VALUES))


# -- models ------------------------------------------------------------------------

def _terms(spark, fits, z):
    return term_table(spark, fits, z).select(
        F.col("group").alias("sex"), "model", "position", "term", "estimate", "std_error", "ratio",
        "conf_low", "conf_high", "p_value", "n_frame", "n_model", "events", "converged")


@query
def logit_crude(spark, folder):
    """Husband's baseline status on the wife's."""
    fit = reports.concordance_logit(_dyads(spark, folder))
    return term_table(spark, [fit], Z).select(
        "term", F.col("estimate").alias("estimate_log_odds"), F.col("ratio").alias("odds_ratio"),
        F.col("conf_low").alias("conf_low_95"), F.col("conf_high").alias("conf_high_95"), "p_value", "converged")


@query
def logit_adjusted(spark, folder):
    """All terms of the nested logistic models per role."""
    return _terms(spark, reports.fit_partner_glms(_roles(spark, folder)), Z)


@query
def logit_estimates(spark, folder):
    """Partner odds ratios, one row per role and model."""
    return reports.estimate_table(spark, reports.fit_partner_glms(_roles(spark, folder)))


@query
def logit_report(spark, folder):
    """Partner odds ratios as printed."""
    roles = pin(_roles(spark, folder))
    return reports.ratio_table(spark, reports.fit_partner_glms(roles), reports.partner_counts(roles), "OR")


@query
def poisson_rr_crude(spark, folder):
    """Unadjusted risk ratios with robust variance."""
    return _terms(spark, reports.fit_crude_rr(_roles(spark, folder)), Z)


@query
def poisson_rr_adjusted(spark, folder):
    """All terms of the nested risk-ratio models with robust variance."""
    return _terms(spark, reports.fit_partner_glms(_roles(spark, folder), "poisson", robust=True), Z)


@query
def poisson_report(spark, folder):
    """Partner risk ratios as printed."""
    roles = pin(_roles(spark, folder))
    fits = reports.fit_partner_glms(roles, "poisson", robust=True)
    return reports.ratio_table(spark, fits, reports.partner_counts(roles), "RR")


@query
def cox_spouse(spark, folder):
    """Spouse hazard ratios: crude and three adjusted models per role."""
    return reports.spouse_cox_table(spark, reports.fit_spouse_cox(_roles(spark, folder)))


@query
def cox_adjusted(spark, folder):
    """All terms of the spouse Cox models."""
    return _terms(spark, reports.fit_spouse_cox(_roles(spark, folder)), NORMAL_975)


@query
def cox_factor(spark, folder):
    """Cox by partner status with factor covariates, from dyad waves."""
    long, rows = _model_couples(spark, folder)
    waves = dyads.members_to_wide(long.select("hhid", "carrs", "fup", "sex", *WAVE_VALUES))
    return _terms(spark, reports.fit_partner_cox(reports.wave_roles(waves, rows)), NORMAL_975)


@query
def cox_report(spark, folder):
    """Partner hazard ratios as printed."""
    long, rows = _model_couples(spark, folder)
    waves = dyads.members_to_wide(long.select("hhid", "carrs", "fup", "sex", *WAVE_VALUES))
    roles = pin(reports.wave_roles(waves, rows))
    totals = {r["role"]: r["count"] for r in roles.where("baseline_dm = 0").groupBy("role").count().collect()}
    return reports.ratio_table(spark, reports.fit_partner_cox(roles), reports.partner_counts(roles, with_time=True),
                               "HR", NORMAL_975, totals)


def _clustered(spark, folder):
    long, rows = _model_couples(spark, folder)
    return reports.fit_clustered_cox(reports.event_frame(rows, reports.baseline_covariates(long)))


@query
def cox_cluster(spark, folder):
    """Hazard ratios with household-clustered variance."""
    return reports.hazard_ratio_table(spark, _clustered(spark, folder)[1])


@query
def hr_table(spark, folder):
    """The same without the two smallest ratios."""
    return reports.without_smallest(reports.hazard_ratio_table(spark, _clustered(spark, folder)[1]))


@query
def ph_test(spark, folder):
    """Proportional-hazards test per term and overall."""
    return reports.zph_table(spark, *_clustered(spark, folder))
