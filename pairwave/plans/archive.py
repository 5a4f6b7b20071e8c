"""The longitudinal variant: from long visits to event rows and dyad waves."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairwave.functions.joins import attach
from pairwave.operators.dyads import members_to_wide
from pairwave.operators.events import mark_events
from pairwave.operators.households import eligible_couples, keep_complete_persons, keep_spouses
from pairwave.operators.recode import recode_visit_covariates
from pairwave.operators.visits import (
    define_gated_outcomes, flag_response, impute_visit_dates, keep_schedule, link_visit_dates,
    trim_trailing_nonresponse, wave_midpoints)

# Covariates a complete case must have at baseline.
COMPLETE_CASE_COLUMNS = (
    "dm", "fpg", "hba1c", "age", "sex", "hld", "religion", "caste", "edu_category", "employ_category", "hhincome",
    "bmi", "famhx_dm", "htn", "chd", "smk_overall", "alc_overall")


def main_visits(visits: DataFrame) -> DataFrame:
    """Responses, trailing non-response trimmed, biomarker waves, outcomes."""
    return define_gated_outcomes(keep_schedule(trim_trailing_nonresponse(flag_response(visits))))


def dated_visits(visits: DataFrame) -> DataFrame:
    """Main visits with imputed dates and inter-visit midpoints.

    The trim and the linking windows share one shuffle on (study, person).
    """
    middles = wave_midpoints(flag_response(visits))
    return link_visit_dates(impute_visit_dates(main_visits(visits), middles=middles))


def complete_couples(dated: DataFrame, covariates=COMPLETE_CASE_COLUMNS) -> DataFrame:
    """Spouses with complete baseline covariates in mixed couples close in age."""
    complete = keep_complete_persons(keep_spouses(dated), covariates)
    return attach(complete, eligible_couples(complete), "hhid", how="left_semi")


def event_rows(recoded: DataFrame) -> DataFrame:
    """Visits with the person's event or censor row and baseline status."""
    return mark_events(recoded)


def analytic_long(visits: DataFrame) -> DataFrame:
    return event_rows(recode_visit_covariates(complete_couples(dated_visits(visits))))


def analytic_waves(long: DataFrame) -> DataFrame:
    return members_to_wide(long)
