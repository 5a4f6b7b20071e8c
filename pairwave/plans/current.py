"""From visits and baseline to dyads: the wide, per-person pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwave.operators.dyads import flag_dyads_at_risk, pair_cohort, pair_members
from pairwave.operators.events import elapsed, find_first_event
from pairwave.operators.households import availability_flags, eligibility_flags
from pairwave.operators.recode import clean_baseline, recode_covariates
from pairwave.operators.visits import define_outcomes, flag_completion, visits_to_wide


def visit_outcomes(visits: DataFrame) -> DataFrame:
    return define_outcomes(flag_completion(visits))


def join_dyad_flags(persons: DataFrame, flags: DataFrame) -> DataFrame:
    """Left join on person and household; a missing household matches a missing one."""
    flags = flags.select(F.col("pid").alias("_pid"), F.col("hhid").alias("_hhid"), "spousedyad_new")
    same = (F.col("pid") == F.col("_pid")) & F.col("hhid").eqNullSafe(F.col("_hhid"))
    return persons.join(flags, same, "left").drop("_pid", "_hhid")


def analytic_wide(visits: DataFrame, baseline: DataFrame, flags: DataFrame) -> DataFrame:
    """Baseline people with their wide outcomes and dyad flag.

    The narrow flag join comes first, so that the forty outcome columns are
    shuffled once, as partly combined person rows.
    """
    people = join_dyad_flags(clean_baseline(baseline), flags)
    return people.join(visits_to_wide(visit_outcomes(visits)), "pid", "left")


def recoded_persons(analytic: DataFrame) -> DataFrame:
    """Every person with eligibility flags, events and recoded covariates."""
    return recode_covariates(find_first_event(eligibility_flags(analytic)))


def cohort_persons(recoded: DataFrame) -> DataFrame:
    """The analysis cohort with follow-up time in years."""
    return recoded.where(F.col("biocohort") == 1).withColumn(
        "time_to_dm", elapsed(F.col("DateDMbiomarker"), F.col("visit_date0")))


def dyads_from_cohort(individuals: DataFrame) -> DataFrame:
    return flag_dyads_at_risk(pair_members(individuals))


def dyads(visits: DataFrame, baseline: DataFrame, flags: DataFrame) -> DataFrame:
    """Dyads in one household shuffle, without joining the summary back.

    Same rows as ``dyads_from_cohort(cohort_persons(recoded_persons(...)))``.
    """
    people = find_first_event(availability_flags(analytic_wide(visits, baseline, flags)))
    people = recode_covariates(people).withColumn(
        "time_to_dm", elapsed(F.col("DateDMbiomarker"), F.col("visit_date0")))
    measured = (F.col("baseline_bio_one") == 1) & (F.col("onefollowupbio") == 1)
    return flag_dyads_at_risk(pair_cohort(people, measured))
