"""Covariate recodes: narrow, declarative, evaluated in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwave.functions.columns import (
    count_equal, first_match, is_in, mean_known, recode, sum_known)

# Code lists of the questionnaire.
SITES = {1: "Chennai"}
OTHER_SITE = "Delhi"
CONDITIONS = ("htn", "dm", "chd", "cva", "ckd")


@dataclass(frozen=True)
class Codes:
    """Fixed values of the recodes, as published; pass others to change them."""

    # education code lists by category, in three and in two categories
    education: tuple = ((1, (7, 6, 5)), (2, (3, 4)), (3, (1, 2)))
    education_two: tuple = ((1, (3, 4, 5, 6, 7)), (2, (1, 2)))
    employed: tuple = (1,)
    # occupation codes of the employed, then employment codes, by category
    occupations: tuple = ((4, (3, 4, 5)), (5, (1, 2)))
    employment: tuple = ((1, (2, 3)), (2, (4,)), (3, (5,)))
    overweight: float = 25
    obese: float = 30
    lowest_bmi: float = 15
    systolic: float = 140
    diastolic: float = 90
    triglycerides: float = 150
    drinks_now: tuple = (1, 2)
    drank_before: tuple = (3, 4)
    smokes: tuple = (1, 2)
    chews: tuple = (1, 2)


CODES = Codes()


def clean_baseline(baseline: DataFrame, sites=(1, 2), strict: bool = False) -> DataFrame:
    """Restrict to the sites and add labels, derived BMI, wave and year.

    As published, every sex code but 1 becomes female, a missing one too;
    ``strict`` maps a missing code to a missing label instead.
    """
    sex = [(F.col("sex") == 1, "male")]
    if strict:
        sex.insert(0, (F.col("sex").isNull(), None))
    return baseline.where(F.col("site").isin(*sites)).withColumns({
        "fup": F.lit(0),
        "site": first_match(*((F.col("site") == code, label) for code, label in SITES.items()),
                            default=OTHER_SITE),
        "sex": first_match(*sex, default="female"),
        "bmi": F.coalesce(F.col("bmi"), F.try_divide(F.col("weight_kg"), F.pow(F.col("height_cm") / 100.0, 2.0))),
        "year": F.year("doi"),
    })


def recode_covariates(persons: DataFrame, conditions=CONDITIONS, codes: Codes = CODES) -> DataFrame:
    """Education, occupation, BMI and multimorbidity categories."""
    bmi = F.col("bmi")
    in_work = is_in("employ", codes.employed)
    categories = persons.withColumns({
        "educcat": recode("educstat", dict(codes.education)),
        "educcat2": recode("educstat", dict(codes.education_two)),
        "employocccat": first_match(
            *((in_work & is_in("occ", values), category) for category, values in codes.occupations),
            *((is_in("employ", values), category) for category, values in codes.employment)),
        "bmicat": first_match((bmi < codes.overweight, 0), (bmi < codes.obese, 1), (bmi >= codes.obese, 2)),
        "bmicat2": first_match((bmi < codes.obese, 1), (bmi >= codes.obese, 2)),
    }).na.fill(0, list(conditions))
    return categories.withColumn("multimorbidity", sum_known(conditions)).withColumns({
        "multimorbiditycat": first_match(
            (F.col("multimorbidity") == 0, 0), (F.col("multimorbidity") == 1, 1), (F.col("multimorbidity") >= 2, 2)),
        "multimorbiditycat2": first_match((F.col("multimorbidity") == 0, 0), (F.col("multimorbidity") > 0, 1)),
    })


def recode_visit_covariates(visits: DataFrame, outcome: str = "dm_biomarker", codes: Codes = CODES) -> DataFrame:
    """Per-visit covariates of the longitudinal variant.

    Blood pressure is the mean of the last two readings.  The code 3 for
    "assumed never drinking" at follow-up is kept beside the baseline code 0
    for never, as published.
    """
    reported = F.col("chd_allo")
    visits = visits.withColumns({"sbp": mean_known(("sbp2", "sbp3")), "dbp": mean_known(("dbp2", "dbp3"))})
    visits = visits.withColumns({
        "overweight": first_match((F.col("bmi").isNull(), None), (F.col("bmi") >= codes.overweight, 1), default=0),
        "hypertension": first_match(
            (F.coalesce("sbp", "dbp", "htn", "htn_med", "htn_allo").isNull(), None),
            ((F.col("sbp") > codes.systolic) | (F.col("dbp") > codes.diastolic) | (F.col("htn") == 1)
             | (F.col("htn_med") == 1) | (F.col("htn_allo") == 1), 1), default=0),
        "high_tg": first_match((F.col("tg").isNull(), None), (F.col("tg") > codes.triglycerides, 1), default=0),
        "chd": first_match((reported.isNull(), None), (reported == 1, 1), default=F.col("chd")),
    })
    burden = F.col("morbidity_number")
    bmi = F.col("bmi")
    return visits.withColumn(
        "morbidity_number", count_equal(("hypertension", outcome, "chd", "cva", "ckd"), 1)
    ).withColumns({
        "morbidity_category": first_match(
            (burden == 0, "None"), (burden == 1, "Single morbidity"), default="Multimorbidity"),
        **{c: F.coalesce(F.col(c), F.lit(0)) for c in ("famhx_cvd", "famhx_htn", "famhx_dm")},
        "alc_overall": first_match(
            (F.col("alc_curr") == 1, 1), (F.col("alc_curr") == 0, 3),
            (is_in("alc_often", codes.drinks_now) | (F.col("alc_overall") == 1), 1),
            (is_in("alc_often", codes.drank_before) | (F.col("alc_overall") == 2), 2),
            (F.col("alc_often").isNull() | (F.col("alc_overall") == 0), 0),
            default=F.col("alc_overall")),
        "smk_overall": first_match(
            ((F.col("smk_curr") == 1) | is_in("smk_smoke_freq", codes.smokes) | is_in("smk_chew_freq", codes.chews), 1),
            ((F.col("smk_curr") == 0) | (F.col("smk_ever") == 0) | (F.col("smk_overall") == 0), 0),
            ((F.col("smk_ever") == 1) | (F.col("smk_overall") == 2), 2),
            default=F.col("smk_overall")),
        "bmi_category": first_match(
            ((bmi >= codes.lowest_bmi) & (bmi < codes.overweight), "Underweight or normal weight"),
            ((bmi >= codes.overweight) & (bmi < codes.obese), "Overweight"), (bmi >= codes.obese, "Obese")),
    })
