"""Household summaries, eligibility flags and household filters.

A household key can be badly skewed (a placeholder number, an institution),
so no operator here opens a window over a household (windows over a person
see at most one row per wave): summaries are
aggregates, combined before the shuffle, and go back to the rows through
``functions.joins.attach``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwave.functions.columns import all_of, count_known, count_null, first_match, is_in, sum_known
from pairwave.functions.joins import attach

# Fixed value: largest age difference within a couple, in years.
MAX_AGE_GAP = 18


def household_summary(persons: DataFrame, flag: str = "spousedyad_new", keys=("hhid",),
                      total: str = "sum_spouse") -> DataFrame:
    """Flag total (0 when nothing is known) and member count per household."""
    return persons.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.coalesce(F.sum(flag), F.lit(0)).cast("long").alias(total), F.count(F.lit(1)).alias("count_hh"))


def add_household_summary(persons: DataFrame, keys=("hhid",)) -> DataFrame:
    """Left join of the household summary; people without a household get nulls."""
    summary = household_summary(persons, keys=keys)
    return attach(persons, summary, keys, how="left")


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def availability_flags(persons: DataFrame, followups=(1, 2, 3), study: str = "carrs") -> DataFrame:
    """Baseline and follow-up data availability by study design.

    Study 1 plans every follow-up, study 2 only the first.
    """
    complete = [f"visitcomplete{i}" for i in followups]
    measured = [f"dm_biomarker{i}" for i in followups]
    long_study, short_study = F.col(study) == 1, F.col(study) == 2
    return persons.withColumns({
        "baseline_bio_all": flag(is_in("dm_biomarker_nomiss0", (0, 1))),
        "baseline_bio_one": flag(F.col("fpg0").isNotNull() | F.col("hba1c0").isNotNull()),
        "baseline_self": flag(F.col("dm").isNotNull()),
        "nfollowup": sum_known(complete),
        "onefollowupbio": flag((long_study & (count_known(measured) > 0))
                               | (short_study & F.col(measured[0]).isNotNull())),
        "completefollowupbio": flag((long_study & (count_null(measured) == 0))
                                    | (short_study & F.col(measured[0]).isNotNull())),
    }).withColumns({
        "onefollowup": flag(F.col("nfollowup") >= 1),
        "completefollowup": flag((long_study & (F.col("nfollowup") == len(followups)))
                                 | (short_study & (F.col(complete[0]) == 1))),
    })


def eligibility_flags(persons: DataFrame) -> DataFrame:
    """Valid dyad, data availability, cohort and at-risk flags per person."""
    flagged = availability_flags(add_household_summary(persons)).withColumn(
        "valid_dyad", flag((F.col("sum_spouse") == 2) & (F.col("count_hh") == 2)))
    usable = (F.col("valid_dyad") == 1) & (F.col("onefollowupbio") == 1)
    return flagged.withColumns({
        "biocohort": flag(usable & (F.col("baseline_bio_one") == 1)),
        "valid_at_risk": flag(usable & (F.col("dm_biomarker0") == 0)),
    })


def distinct_member_dyads(visits: DataFrame, keys=("carrs", "hhid"), person: str = "pid",
                          spouse: str = "spousedyad_new") -> DataFrame:
    """Valid dyad by distinct members: two people, both flagged as spouses."""
    keys = list(keys)
    members = visits.groupBy(*keys, person).agg(
        F.max(F.coalesce((F.col(spouse) == 1).cast("int"), F.lit(0))).alias("_spouse"))
    known = F.col(person).isNotNull().cast("int")
    households = members.groupBy(*keys).agg(
        F.sum(F.col("_spouse") * known).alias("_spouses"), F.sum(known).alias("_members"))
    valid = households.select(*keys, flag((F.col("_spouses") == 2) & (F.col("_members") == 2)).alias("_valid"))
    return (attach(visits, valid, keys, how="left")
            .withColumn("valid_dyad", F.coalesce("_valid", F.lit(0))).drop("_valid"))


def followup_completeness(visits: DataFrame, keys=("carrs", "pid"), index: str = "visit",
                          planned=None, study: str = "carrs") -> DataFrame:
    """Distinct main visits per person and whether the study's plan was met."""
    planned = {1: 4, 2: 2} if planned is None else planned
    return visits.where(F.col(index).isNotNull()).groupBy(*keys).agg(
        F.count_distinct(index).alias("nfollowup")).withColumn(
        "complete_followup",
        first_match(*(((F.col(study) == s) & (F.col("nfollowup") == n), 1) for s, n in planned.items()), default=0))


def members_histogram(visits: DataFrame, household: str = "hhid", person: str = "pid") -> DataFrame:
    """How many households have how many distinct members."""
    return (visits.select(household, person).distinct()
            .groupBy(household).agg(F.count(F.lit(1)).alias("n_pid"))
            .groupBy("n_pid").agg(F.count(F.lit(1)).alias("Freq")))


def mixed_couples(visits: DataFrame, household: str = "hhid", person: str = "pid", sex: str = "sex") -> DataFrame:
    """Households of exactly two people, one male and one female."""
    people = visits.select(household, person, sex).distinct()

    def members(label):
        return F.count(F.when(F.col(sex) == label, 1))

    return people.groupBy(household).agg(
        F.count(F.lit(1)).alias("_people"), members("male").alias("_men"), members("female").alias("_women")
    ).where("_people = 2 and _men = 1 and _women = 1").select(household)


def keep_mixed_couples(visits: DataFrame, household: str = "hhid", **columns) -> DataFrame:
    return attach(visits, mixed_couples(visits, household, **columns), household, how="left_semi")


def close_in_age(visits: DataFrame, household: str = "hhid", person: str = "pid", age: str = "age",
                 wave: str = "fup", limit: float = MAX_AGE_GAP) -> DataFrame:
    """Two-person households whose baseline ages are known and near enough."""
    ages = visits.where(F.col(wave) == 0).select(household, person, age).distinct()
    return ages.groupBy(household).agg(
        F.count(F.lit(1)).alias("_people"), F.count(age).alias("_known"),
        (F.max(age) - F.min(age)).alias("age_diff")
    ).where((F.col("_people") == 2) & (F.col("_known") == 2) & (F.col("age_diff") <= limit)).select(
        household, "age_diff")


def keep_close_in_age(visits: DataFrame, household: str = "hhid", person: str = "pid", age: str = "age",
                      wave: str = "fup", limit: float = MAX_AGE_GAP) -> DataFrame:
    near = close_in_age(visits, household, person, age, wave, limit).select(household)
    return attach(visits, near, household, how="left_semi")


def eligible_couples(visits: DataFrame, household: str = "hhid", person: str = "pid", sex: str = "sex",
                     age: str = "age", wave: str = "fup", limit: float = MAX_AGE_GAP) -> DataFrame:
    """Composition and age gap together, from one row per person.

    Same households as ``mixed_couples`` followed by ``close_in_age`` when a
    person has one baseline row, with a single pass over the visits.
    """
    at_baseline = F.col(wave) == 0
    people = visits.groupBy(household, person, sex).agg(
        F.count(F.when(at_baseline, 1)).alias("_baseline"),
        F.max(F.when(at_baseline, F.col(age))).alias("_age"))

    def members(label):
        return F.count(F.when(F.col(sex) == label, 1))

    return people.groupBy(household).agg(
        F.count(F.lit(1)).alias("_people"), members("male").alias("_men"), members("female").alias("_women"),
        F.count(F.when(F.col("_baseline") > 0, F.col("_age"))).alias("_aged"),
        (F.max("_age") - F.min("_age")).alias("_gap")
    ).where((F.col("_people") == 2) & (F.col("_men") == 1) & (F.col("_women") == 1)
            & (F.col("_aged") == 2) & (F.col("_gap") <= limit)).select(household)


def complete_persons(visits: DataFrame, covariates, person: str = "pid", wave: str = "fup") -> DataFrame:
    """Distinct people whose baseline row has every covariate."""
    return visits.where(F.col(wave) == 0).na.drop(subset=list(covariates)).select(person).distinct()


def keep_persons(visits: DataFrame, persons: DataFrame, key: str = "pid") -> DataFrame:
    """Membership filter as a semi-join; a person has at most one row per wave."""
    return visits.join(persons, key, "left_semi")


def keep_complete_persons(visits: DataFrame, covariates, person: str = "pid", wave: str = "fup") -> DataFrame:
    """Visits of people with every covariate at baseline.

    Same rows as ``keep_persons`` with ``complete_persons``, by a window over
    the person's few rows instead of a second pass and a join.
    """
    known = all_of([F.col(wave) == 0, *(F.col(c).isNotNull() for c in covariates)])
    complete = F.max(F.when(known, 1)).over(Window.partitionBy(person))
    return visits.withColumn("_complete", complete).where(F.col("_complete") == 1).drop("_complete")


def keep_spouses(visits: DataFrame, spouse: str = "spousedyad_new", valid: str | None = None) -> DataFrame:
    conditions = [F.col(spouse) == 1] + ([F.col(valid) == 1] if valid else [])
    return visits.where(all_of(conditions))


def biomarker_available(visits: DataFrame, keys=("carrs", "pid"), wave: str = "fup", outcome: str = "dm_biomarker",
                        missing: str = "missingbiomarkern", person: str = "pid") -> DataFrame:
    """People with a biomarker at baseline and an outcome at any later wave."""
    baseline = visits.where((F.col(wave) == 0) & is_in(missing, (0, 1))).select(person).distinct()
    return (visits.where(F.col(wave) > 0).groupBy(*keys)
            .agg(F.bool_or(F.col(outcome).isNotNull()).alias("has_fup_dm_biomarker"))
            .where("has_fup_dm_biomarker").join(baseline, person, "left_semi").select(*keys))
