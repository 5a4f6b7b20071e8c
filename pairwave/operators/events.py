"""First event, censoring and follow-up time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwave.functions.joins import null_safe_left_join
from pairwave.functions.columns import count_known, first_match

# Fixed value: the year length the published incidence rates are based on.
DAYS_PER_YEAR = 365.2


def find_first_event(persons: DataFrame, followups=(1, 2, 3), outcome: str = "dm_biomarker",
                     date: str = "visit_date", baseline: int = 0, name: str = "DMbiomarker") -> DataFrame:
    """First event, status and event-or-censor date from wide outcomes.

    Only people known to be event-free at baseline get a value.  The status
    is unknown without any follow-up value; a person without an event is
    censored at the last known visit date.
    """
    states = [f"{outcome}{i}" for i in followups]
    dates = [f"{date}{i}" for i in followups]
    free = F.col(f"{outcome}{baseline}") == 0
    first = F.nullif(F.array_position(F.array(*states), 1), F.lit(0)).cast("int")
    status = first_match(
        (count_known(states) == 0, None), (F.col(f"firstvisit_{name}").isNotNull(), 1), default=0)
    when_event = F.get(F.array(*dates), F.col(f"firstvisit_{name}") - 1)
    when_censored = F.coalesce(*reversed([F.col(d) for d in dates]))
    return (persons
            .withColumn(f"firstvisit_{name}", F.when(free, first))
            .withColumn(f"event_{name}", F.when(free, status))
            .withColumn(f"Date{name}", first_match(
                (F.col(f"event_{name}") == 1, when_event), (F.col(f"event_{name}") == 0, when_censored))))


def elapsed(end: Column, start: Column, unit: str = "years", days_per_year: float = DAYS_PER_YEAR) -> Column:
    """Time between two dates in days, or in years of ``days_per_year`` days."""
    days = F.datediff(end, start).cast("double")
    if unit == "days":
        return days
    if unit == "years":
        return days / F.lit(days_per_year)
    raise ValueError(f"unknown unit {unit!r}")


def person_event_summary(visits: DataFrame, keys=("carrs", "pid"), wave: str = "fup",
                         outcome: str = "dm_biomarker", date: str = "visit_date") -> DataFrame:
    """Follow-up event (unknown when nothing was measured), first event date
    and baseline status, one row per person."""
    later = F.col(wave) > 0
    seen = F.max(F.when(later, F.col(outcome)))
    return visits.groupBy(*keys).agg(
        F.coalesce(F.bool_or(later & F.col(outcome).isNotNull()), F.lit(False)).alias("has_fup_dm_biomarker"),
        F.when(seen.isNotNull(), F.coalesce(
            F.max(F.when(later & (F.col(outcome) == 1), 1)), F.lit(0))).alias("event_dm_biomarker"),
        F.min(F.when(later & (F.col(outcome) == 1), F.col(date))).alias("date_dm_biomarker"),
        F.max(F.when(F.col(wave) == 0, F.col(outcome))).alias("dm_biomarker0"),
        F.count(F.lit(1)).alias("_n"))


def baseline_ids(visits: DataFrame, event: bool, key: str = "pid", wave: str = "fup",
                 outcome: str = "dm_biomarker") -> DataFrame:
    """Distinct people with, or known to be without, the event at baseline."""
    state = F.col(outcome) != 0 if event else F.col(outcome) == 0
    return visits.where((F.col(wave) == 0) & state).select(key).distinct()


def _position(wave: str, day: str) -> Column:
    """Sortable place of a row in its person's history: wave, then day, unknown days last."""
    return F.col(wave).cast("double") * F.lit(1e7) + F.coalesce(F.col(day), F.lit(9e6))


def event_or_censor(visits: DataFrame, keys=("pid", "carrs"), household: str = "hhid", wave: str = "fup",
                    outcome: str = "dm_biomarker", day: str = "doi_day", midpoint: str = "midpoint_day",
                    baseline: str = "baseline_day", event_date: str = "midpoint") -> DataFrame:
    """One row per baseline event-free person: the first event or the last row.

    An event is dated at the inter-visit midpoint (or at the visit), a
    censored person at the day of the last row.  First and last rows are
    picked by one aggregate on a sortable position, so rows are combined
    before the shuffle.  Being event-free is a property of the person across
    studies; the window for it sees one row per study.
    """
    at_event = midpoint if event_date == "midpoint" else day
    position = _position(wave, day)
    hit = F.col(outcome) == 1
    picked = visits.groupBy(*keys).agg(
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("_event"),
        F.max(F.when((F.col(wave) == 0) & (F.col(outcome) == 0), 1)).alias("_free"),
        *[F.min_by(F.col(c), F.when(hit, position)).alias(f"_first_{c}")
          for c in (wave, household, at_event, baseline)],
        *[F.max_by(F.col(c), position).alias(f"_last_{c}") for c in (wave, household, day, baseline)])
    free = F.max("_free").over(Window.partitionBy(keys[0]))
    chosen = picked.withColumn("_free", free).where(F.col("_free") == 1)

    def either(first, last):
        return F.when(F.col("_event"), F.col(f"_first_{first}")).otherwise(F.col(f"_last_{last}"))

    return chosen.select(
        *keys, either(wave, wave).alias(wave), either(household, household).alias(household),
        F.col("_event").cast("int").alias("dm_incident"),
        either(at_event, day).alias("dm_incident_day"),
        (either(at_event, day) - either(baseline, baseline)).alias("time_to_dm"))


def annotate_events(visits: DataFrame, events: DataFrame, keys=("carrs", "fup", "pid", "hhid"),
                    person: str = "pid", wave: str = "fup", outcome: str = "dm_biomarker") -> DataFrame:
    """Join event rows back on the visits and flag baseline cases; a missing household matches itself."""
    return flag_baseline_cases(null_safe_left_join(visits, events, keys), person, wave, outcome)


def _baseline_case(wave: str, outcome: str, person: str) -> Column:
    case = F.when((F.col(wave) == 0) & (F.col(outcome) != 0), 1)
    return F.coalesce(F.max(case).over(Window.partitionBy(person)), F.lit(0))


def flag_baseline_cases(visits: DataFrame, person: str = "pid", wave: str = "fup",
                        outcome: str = "dm_biomarker") -> DataFrame:
    """1 on every row of a person known to have the event at baseline, else 0."""
    return visits.withColumn("baseline_dm", _baseline_case(wave, outcome, person))


def mark_events(visits: DataFrame, keys=("pid", "carrs"), wave: str = "fup", outcome: str = "dm_biomarker",
                day: str = "doi_day", midpoint: str = "midpoint_day", baseline: str = "baseline_day",
                event_date: str = "midpoint") -> DataFrame:
    """Event or censor columns on the row they belong to, and baseline status.

    Same rows as joining ``event_or_censor`` back with ``annotate_events``,
    but as windows over the person: visits that are already partitioned by
    person are neither shuffled nor read again.
    """
    at_event = midpoint if event_date == "midpoint" else day
    within, person = Window.partitionBy(*keys), Window.partitionBy(keys[0])
    hit = F.col(outcome) == 1
    marked = visits.withColumn("_position", _position(wave, day)).withColumns({
        "_free": F.max(F.when((F.col(wave) == 0) & (F.col(outcome) == 0), 1)).over(person),
        "baseline_dm": _baseline_case(wave, outcome, keys[0]),
        "_first": F.min(F.when(hit, F.col("_position"))).over(within),
        "_last": F.max("_position").over(within)})
    event = (F.col("_free") == 1) & hit & (F.col("_position") == F.col("_first"))
    censored = (F.col("_free") == 1) & F.col("_first").isNull() & (F.col("_position") == F.col("_last"))
    marked = marked.withColumns({
        "dm_incident": first_match((event, 1), (censored, 0)),
        "dm_incident_day": first_match((event, F.col(at_event)), (censored, F.col(day)))})
    marked = marked.withColumn("time_to_dm", F.col("dm_incident_day") - F.col(baseline))
    return marked.drop("_position", "_free", "_first", "_last")
