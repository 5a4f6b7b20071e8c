"""Operators on the long visit table: one row per (study, person, wave).

The key bounds a person's rows by the number of waves, so windows over a
person are small; ``functions.joins.require_unique`` checks input that is
not known to respect it.  Window keys start with the person: data
partitioned and sorted that way once serves all windows over a person,
within one study or across studies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwave.functions.columns import (
    all_of, any_of, count_null, day_number, day_to_date, first_match, is_in, percent)

# Fixed values of the study protocol.
BIOMARKER_THRESHOLDS = {"fpg": 126.0, "hba1c": 6.5}
REPORTS = ("dm", "dm_allo")
BIOMARKER_WAVES = {1: (0, 2, 4, 7), 2: (0, 2)}
WAVES_WITHOUT_BIOMARKER = {1: (1, 3, 5, 6), 2: (1,)}
WIDE_VALUES = ("fpg", "hba1c", "dm", "dm_allo", "dm_biomarker", "dm_biomarker_nomiss",
               "dm_self", "visit_date", "visitcomplete", "missingbiomarkern")


def flag_completion(visits: DataFrame, reason: str = "reason", date: str = "doi") -> DataFrame:
    """A visit without a drop-out reason is complete; only those keep a date."""
    return visits.withColumn(
        "visitcomplete", F.when(F.col(reason).isNull(), 1).otherwise(0)
    ).withColumn("visit_date", F.when(F.col("visitcomplete") == 1, F.col(date)))


def is_positive(thresholds: dict[str, float], reports) -> Column:
    """Any biomarker at or above its threshold, or any report of the condition."""
    return any_of([*(F.col(c) >= limit for c, limit in thresholds.items()),
                   *(F.col(c) == 1 for c in reports)])


def define_outcomes(visits: DataFrame, thresholds=None, reports=REPORTS,
                    complete: str = "visitcomplete", prefix: str = "dm") -> DataFrame:
    """Outcome per completed visit under three missing-value rules.

    ``_biomarker`` is unknown when every biomarker is missing,
    ``_biomarker_nomiss`` when any is, ``_self`` looks at reports only.
    """
    thresholds = BIOMARKER_THRESHOLDS if thresholds is None else thresholds
    done = F.col(complete) == 1
    positive = is_positive(thresholds, reports)
    missing = [F.col(c).isNull() for c in thresholds]
    return visits.withColumns({
        f"{prefix}_biomarker": first_match((done & all_of(missing), None), (done & positive, 1), (done, 0)),
        f"{prefix}_biomarker_nomiss": first_match(
            (done & any_of(missing), None), (done & positive, 1), (done, 0)),
        f"{prefix}_self": first_match(
            (done & any_of([F.col(c) == 1 for c in reports]), 1), (done, 0)),
        "missingbiomarkern": F.when(done, count_null(thresholds)),
    })


def flag_response(visits: DataFrame, silent_waves=None, study: str = "carrs", wave: str = "fup",
                  reason: str = "reason") -> DataFrame:
    """Responder flag; waves without biomarkers never count as a response."""
    silent_waves = WAVES_WITHOUT_BIOMARKER if silent_waves is None else silent_waves
    silent = in_schedule(silent_waves, study, wave)
    return visits.withColumn("respond", first_match((silent, 0), (F.col(reason).isNull(), 1), default=0))


def define_gated_outcomes(visits: DataFrame, thresholds=None, reports=REPORTS,
                          respond: str = "respond", prefix: str = "dm") -> DataFrame:
    """Outcomes of the longitudinal variant: gated by response, unknown only
    when every biomarker and every report is missing."""
    thresholds = BIOMARKER_THRESHOLDS if thresholds is None else thresholds
    no_biomarker = all_of([F.col(c).isNull() for c in thresholds])
    nothing = no_biomarker & all_of([F.col(c).isNull() for c in reports])
    reported = any_of([F.col(c) == 1 for c in reports])
    return visits.withColumns({
        f"{prefix}_self_report": first_match((nothing, None), (reported & no_biomarker, 1), default=0),
        f"{prefix}_biomarker": first_match(
            (F.col(respond) == 0, None), (nothing, None), (is_positive(thresholds, reports), 1), default=0),
    })


def in_schedule(schedule: dict[int, tuple], study: str = "carrs", wave: str = "fup") -> Column:
    return any_of([(F.col(study) == s) & is_in(wave, waves) for s, waves in schedule.items()])


def keep_schedule(visits: DataFrame, schedule=None, study: str = "carrs", wave: str = "fup") -> DataFrame:
    """Keep the waves listed for each study."""
    return visits.where(in_schedule(BIOMARKER_WAVES if schedule is None else schedule, study, wave))


def missingness_profile(visits: DataFrame, keys=("carrs", "visit"), columns=("fpg", "hba1c")) -> DataFrame:
    """Rows, missing counts and percentages per group, per column and combined."""
    missing = {c: F.col(c).isNull() for c in columns}
    missing["both"] = all_of([F.col(c).isNull() for c in columns])
    missing["either"] = any_of([F.col(c).isNull() for c in columns])
    counts = visits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        *[F.sum(m.cast("long")).alias(f"nmiss_{c}") for c, m in missing.items()])
    measures = []
    for c in missing:
        measures += [F.col(f"nmiss_{c}"), percent(F.col(f"nmiss_{c}"), F.col("n_total")).alias(f"pctmiss_{c}")]
    return counts.select(*keys, "n_total", *measures)


def visits_to_wide(visits: DataFrame, key: str = "pid", index: str = "visit", values=WIDE_VALUES,
                   indexes=(0, 1, 2, 3)) -> DataFrame:
    """One row per person with ``{value}{visit}`` columns.

    Conditional maxima need a single shuffle of partly combined rows, where
    ``pivot`` would first group by person and visit and shuffle twice.
    """
    return visits.where(F.col(index).isNotNull()).groupBy(key).agg(*[
        F.expr(f"max(case when {index} = {i} then {v} end) as {v}{i}") for v in values for i in indexes])


def _person(keys):
    return Window.partitionBy(*keys)


def trim_trailing_nonresponse(visits: DataFrame, keys=("pid", "carrs"), wave: str = "fup",
                              respond: str = "respond") -> DataFrame:
    """Drop the waves after a person's last response, and people without any.

    The wave orders a person's rows, so its maximum among responses stands
    for the last position; an unknown wave comes last.
    """
    place = F.coalesce(F.col(wave), F.lit(2**31 - 1))
    last = F.max(F.when(F.col(respond) == 1, place)).over(_person(keys))
    return visits.withColumn("_last", last).where(place <= F.col("_last")).drop("_last")


def wave_midpoints(visits: DataFrame, schedule=None, study: str = "carrs", wave: str = "fup",
                   date: str = "doi", respond: str = "respond") -> DataFrame:
    """Middle of the observed date range of each scheduled wave, as a half-day number."""
    seen = F.when(F.col(respond) == 1, day_number(F.col(date)))
    return (keep_schedule(visits, schedule, study, wave).groupBy(study, wave)
            .agg(F.min(seen).alias("_first"), F.max(seen).alias("_last"))
            .select(study, wave, (F.col("_first") + (F.col("_last") - F.col("_first")) / 2.0)
                    .alias("doi_midpoint_day")))


def impute_visit_dates(visits: DataFrame, schedule=None, study: str = "carrs", wave: str = "fup",
                       date: str = "doi", respond: str = "respond", middles: DataFrame | None = None) -> DataFrame:
    """Give responders without a date the midpoint of their wave.

    A wave holds a large share of all rows, so its range is an aggregate and
    not a window.  The aggregate has at most one row per entry of the
    schedule, which is the bound that makes the broadcast safe.  ``doi_day``
    is the (possibly half) day number behind the floored date.

    Only responses count towards a midpoint, and trimming drops none, so
    ``middles`` may come from the untrimmed visits: a pruned scan and a small
    aggregate in place of a second run through the person windows.
    """
    if middles is None:
        middles = wave_midpoints(visits, schedule, study, wave, date, respond)
    return (visits.join(F.broadcast(middles), [study, wave], "left")
            .withColumn("doi_day", first_match(
                (F.col(respond) != 1, None),
                ((F.col(respond) == 1) & F.col(date).isNull(), F.col("doi_midpoint_day")),
                default=day_number(F.col(date))))
            .withColumn(date, day_to_date(F.col("doi_day")))
            .drop("doi_midpoint_day"))


def link_visit_dates(visits: DataFrame, keys=("pid", "carrs"), wave: str = "fup",
                     day: str = "doi_day") -> DataFrame:
    """Baseline day, last known earlier day, and the midpoint between visits.

    Carrying the last observation forward and lagging it by one row is the
    last known day among all earlier rows, so one frame serves for both.
    """
    by_wave = _person(keys).orderBy(F.col(wave).asc_nulls_last(), F.col(day).asc_nulls_last())
    earlier = by_wave.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_wave.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (visits
            .withColumn("baseline_day", F.first(day, ignorenulls=True).over(whole))
            .withColumn("prior_day", F.last(day, ignorenulls=True).over(earlier))
            .withColumn("midpoint_day", F.when(
                F.col(day).isNotNull() & F.col("prior_day").isNotNull(),
                F.col("prior_day") + (F.col(day) - F.col("prior_day")) / 2.0)))


def carry_forward(visits: DataFrame, column: str, keys=("pid", "carrs"), wave: str = "fup",
                  name: str | None = None) -> DataFrame:
    """Last known value up to and including the current wave."""
    so_far = (_person(keys).orderBy(F.col(wave).asc_nulls_last(), F.col(column).asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return visits.withColumn(name or f"{column}_last_obs", F.last(column, ignorenulls=True).over(so_far))
