"""Pairing household members: one row per dyad, or per dyad and wave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwave.functions.columns import any_of, first_match

# Columns of a member and covariates by sex, as published.
MEMBER_COLUMNS = (
    "age", "bmi", "waist_cm", "educcat", "educcat2", "employocccat", "bmicat", "bmicat2",
    "alc_overall", "smk_overall", "famhx_htn", "famhx_dm", "famhx_cvd", "htn", "dm", "chd", "cva", "ckd",
    "multimorbiditycat", "dm_biomarker0", "event_DMbiomarker", "DateDMbiomarker", "time_to_dm", "biocohort")
SUFFIXES = {"male": "husb", "female": "wife"}
FEMALE_COVARIATES = ("age", "bmi", "educcat2", "famhx_dm", "multimorbiditycat")
MALE_COVARIATES = (*FEMALE_COVARIATES, "smk_overall", "alc_overall")


def pair_members(persons: DataFrame, household: str = "hhid", sex: str = "sex", order: str = "pid",
                 columns=MEMBER_COLUMNS, having: Column | None = None, extra=()) -> DataFrame:
    """Husband and wife of each household side by side.

    Equal to splitting by sex, keeping the first person per household and
    joining the two halves, but in one aggregate: each household reaches its
    task as one row per input partition, whatever its size.  The first
    person is the one with the lowest ``order``.  ``having`` filters on
    ``extra`` household aggregates.
    """
    def member(label, suffix):
        row = F.struct(order, *columns)
        return F.min(F.when(F.col(sex) == label, row)).alias(f"_{suffix}")

    pairs = persons.dropna(subset=[household]).groupBy(household).agg(
        *[member(label, suffix) for label, suffix in SUFFIXES.items()], *extra)
    if having is not None:
        pairs = pairs.where(having)
    both = [F.col(f"_{s}").isNotNull() for s in SUFFIXES.values()]
    return pairs.where(both[0] & both[1]).selectExpr(household, *[
        f"_{suffix}.{c} as {c}_{suffix}" for suffix in SUFFIXES.values() for c in columns])


def pair_cohort(persons: DataFrame, eligible: Column, spouse: str = "spousedyad_new",
                household: str = "hhid", **options) -> DataFrame:
    """Dyads of the cohort straight from all persons, in one shuffle.

    The household rule (two members, both spouses) counts all persons while
    only eligible ones are paired, so the summary, the join back, the cohort
    filter and the self-join become one grouped aggregate.
    """
    members = F.count(F.lit(1)).alias("_members")
    spouses = F.sum(F.col(spouse)).alias("_spouses")
    candidates = persons.withColumn("sex", F.when(eligible, F.col("sex"))).withColumn("biocohort", F.lit(1))
    return pair_members(candidates, household, extra=(members, spouses),
                        having=(F.col("_members") == 2) & (F.col("_spouses") == 2), **options)


def dyad_at_risk(husband: str, wife: str) -> Column:
    """Null when both have the condition; an unknown status counts as at risk."""
    return F.when((F.col(husband) == 1) & (F.col(wife) == 1), None).otherwise(F.lit(1))


def member_at_risk(status: str, covariates) -> Column:
    """1 when event-free with complete covariates, else null."""
    return first_match((F.col(status) == 1, None),
                       (any_of([F.col(c).isNull() for c in covariates]), None), default=1)


def flag_dyads_at_risk(dyads: DataFrame, outcome: str = "dm_biomarker0", female=FEMALE_COVARIATES,
                       male=MALE_COVARIATES, wife: str = "{}_wife", husband: str = "{}_husb") -> DataFrame:
    """Dyad and member flags; the patterns name a member's columns, for
    suffixed dyads as well as for the prefixed rows of ``members_to_wide``."""
    return dyads.withColumns({
        "dyad_at_risk": dyad_at_risk(husband.format(outcome), wife.format(outcome)),
        "female_at_risk": member_at_risk(wife.format(outcome), [wife.format(c) for c in female]),
        "male_at_risk": member_at_risk(husband.format(outcome), [husband.format(c) for c in male]),
    })


# Fixed covariate lists of the longitudinal variant's at-risk flags.
WAVE_COVARIATES = ("age", "bmi", "edu_category", "famhx_dm", "morbidity_category")
WAVE_BEHAVIOURS = ("smk_overall", "alc_overall")


def flag_waves_at_risk(waves: DataFrame, outcome: str = "dm_biomarker", wave: str = "fup") -> DataFrame:
    """At-risk flags on the baseline rows of the dyad waves."""
    return flag_dyads_at_risk(waves.where(F.col(wave) == 0), outcome, WAVE_COVARIATES,
                              (*WAVE_COVARIATES, *WAVE_BEHAVIOURS), "female_{}", "male_{}")


ROLE_COLUMNS = {
    "age": "age", "edu_category": "educcat", "famhx_dm": "famhx_dm",
    "morbidity_category": "multimorbiditycat", "bmi_category": "bmicat",
    "alc_overall": "alc_overall", "smk_overall": "smk_overall", "time_to_dm": "time_to_dm"}


def role_view(dyads: DataFrame, columns: dict[str, str] | None = None, baseline: str = "dm_biomarker0",
              event: str = "event_DMbiomarker", unused: dict[str, tuple] | None = None) -> DataFrame:
    """The dyads seen from each member: own and partner status, covariates.

    Behaviours that a role's models do not use become typed nulls.  Both
    views come out of one pass; a union would compute the dyads twice.
    """
    columns = ROLE_COLUMNS if columns is None else columns
    unused = {"Women": ("alc_overall", "smk_overall")} if unused is None else unused
    types = {f.name: f.dataType for f in dyads.schema.fields}
    views = []
    for role, own, partner in (("Women", "wife", "husb"), ("Men", "husb", "wife")):
        skipped = unused.get(role, ())
        views.append(F.struct(
            F.lit(role).alias("role"), "hhid", *(["dyad_at_risk"] if "dyad_at_risk" in types else []),
            F.col(f"{baseline}_{own}").alias("baseline_dm"),
            F.col(f"{baseline}_{partner}").alias("partner_baseline_dm"),
            F.col(f"{event}_{own}").alias("dm_incident"),
            *[(F.lit(None).cast(types[f"{c}_{own}"]) if name in skipped else F.col(f"{c}_{own}")).alias(name)
              for name, c in columns.items()]))
    return dyads.select(F.inline(F.array(*views)))


def members_to_wide(visits: DataFrame, keys=("hhid", "carrs", "fup"), sex: str = "sex", order: str = "pid",
                    labels=("female", "male"), complete: bool = True) -> DataFrame:
    """One row per household and wave with ``{sex}_{value}`` columns.

    Every non-key column is spread; with ``complete`` only rows with both
    members stay.
    """
    values = [c for c in visits.columns if c not in (*keys, sex)]
    rest = [c for c in values if c != order]
    wide = visits.groupBy(*keys).agg(*[
        F.min(F.when(F.col(sex) == label, F.struct(order, *rest))).alias(f"_{label}") for label in labels])
    if complete:
        wide = wide.where(" and ".join(f"_{label}.{order} is not null" for label in labels))
    return wide.selectExpr(*keys, *[f"_{label}.{c} as {label}_{c}" for label in labels for c in values])


def event_free_couples(waves: DataFrame, keys=("carrs", "hhid", "female_pid", "male_pid"),
                       wave: str = "fup", outcome: str = "dm_biomarker0") -> DataFrame:
    """Baseline dyad rows of couples with at least one event-free member.

    One filter on either member is the distinct union of a filter on each.
    """
    free = any_of([F.col(f"{label}_{outcome}") == 0 for label in ("female", "male")])
    ids = waves.where(free).select(*keys).distinct()
    return waves.where(F.col(wave) == 0).join(ids, list(keys), "left_semi")
