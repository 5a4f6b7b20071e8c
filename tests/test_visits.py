from datetime import date, timedelta
from itertools import product

from pairwave.operators.events import event_or_censor, find_first_event, mark_events, annotate_events, elapsed
from pairwave.operators.visits import (
    carry_forward, define_gated_outcomes, define_outcomes, flag_completion, flag_response, impute_visit_dates,
    keep_schedule, link_visit_dates, missingness_profile, trim_trailing_nonresponse, visits_to_wide)
from pyspark.sql import functions as F


def expected_outcomes(done, fpg, hba1c, dm, allo):
    positive = (fpg is not None and fpg >= 126) or (hba1c is not None and hba1c >= 6.5) or dm == 1 or allo == 1
    if not done:
        return None, None, None, None
    either = None if fpg is None and hba1c is None else int(positive)
    strict = None if fpg is None or hba1c is None else int(positive)
    return either, strict, int(dm == 1 or allo == 1), (fpg is None) + (hba1c is None)


def test_outcomes_over_all_null_patterns(spark):
    cases = list(product((None, "refused"), (None, 100.0, 126.0), (None, 5.0, 6.5), (None, 0, 1), (None, 0, 1)))
    rows = [(k, *case) for k, case in enumerate(cases)]
    frame = spark.createDataFrame(rows, "k int, reason string, fpg double, hba1c double, dm int, dm_allo int")
    frame = frame.withColumn("doi", F.to_date(F.lit("2011-01-01")))
    got = {r["k"]: r for r in define_outcomes(flag_completion(frame)).collect()}
    for k, (reason, *values) in enumerate(cases):
        r = got[k]
        assert (r["dm_biomarker"], r["dm_biomarker_nomiss"], r["dm_self"], r["missingbiomarkern"]) == \
            expected_outcomes(reason is None, *values)
        assert (r["visit_date"] is not None) == (reason is None)


def test_gated_outcomes(spark):
    cases = list(product((0, 1), (None, 100.0, 130.0), (None, 5.0, 7.0), (None, 0, 1), (None, 0, 1)))
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)],
                                  "k int, respond int, fpg double, hba1c double, dm int, dm_allo int")
    got = {r["k"]: r for r in define_gated_outcomes(frame).collect()}
    for k, (respond, fpg, hba1c, dm, allo) in enumerate(cases):
        nothing = fpg is None and hba1c is None and dm is None and allo is None
        reported = dm == 1 or allo == 1
        positive = (fpg or 0) >= 126 or (hba1c or 0) >= 6.5 or reported
        assert got[k]["dm_self_report"] == (None if nothing else int(reported and fpg is None and hba1c is None))
        assert got[k]["dm_biomarker"] == (None if nothing or respond == 0 else int(positive))


def test_event_search_over_all_follow_up_patterns(spark):
    states = list(product((None, 0, 1), repeat=4))
    day = date(2012, 1, 1)
    rows = []
    for k, (base, *follow) in enumerate(states):
        dates = [None if (k + j) % 4 == 0 else day + timedelta(days=100 * j) for j in range(4)]
        rows.append((k, base, *follow, *dates))
    frame = spark.createDataFrame(rows, "k int, " + ", ".join(f"dm_biomarker{i} int" for i in range(4)) + ", "
                                  + ", ".join(f"visit_date{i} date" for i in range(4)))
    for r in find_first_event(frame).collect():
        follow = [r[f"dm_biomarker{i}"] for i in (1, 2, 3)]
        dates = [r[f"visit_date{i}"] for i in (1, 2, 3)]
        first = follow.index(1) + 1 if r["dm_biomarker0"] == 0 and 1 in follow else None
        status = None
        if r["dm_biomarker0"] == 0 and any(f is not None for f in follow):
            status = int(first is not None)
        known = [d for d in dates if d is not None]
        when = None if status is None else dates[first - 1] if status else (known[-1] if known else None)
        assert (r["firstvisit_DMbiomarker"], r["event_DMbiomarker"], r["DateDMbiomarker"]) == (first, status, when)


def test_elapsed_uses_the_published_year(spark):
    frame = spark.sql("select date'2012-01-01' as a, date'2013-01-01' as b")
    years, days = frame.select(elapsed(F.col("b"), F.col("a")), elapsed(F.col("b"), F.col("a"), "days")).first()
    assert years == 366 / 365.2 and days == 366.0


VISITS = "carrs int, pid long, hhid long, fup int, reason string, doi date, dm_biomarker int"


def longitudinal(spark):
    d = date(2010, 1, 1)
    rows = [
        # person 1: leading unknown date, a gap, trailing refusals
        (1, 1, 10, 0, None, None, 0), (1, 1, 10, 2, "refused", d, None), (1, 1, 10, 4, None, d + timedelta(9), 1),
        (1, 1, 10, 7, "refused", d, None),
        # person 2: refuses in the middle, censored at the last row
        (1, 2, 10, 0, None, d, 0), (1, 2, 10, 2, "refused", None, None), (1, 2, 10, 4, None, d + timedelta(4), 0),
        # person 3: never responds
        (1, 3, 11, 0, "refused", d, None),
        # person 4: event at baseline
        (2, 4, 12, 0, None, d + timedelta(1), 1), (2, 4, 12, 2, None, None, 1),
        # person 5: the only responder of the last wave has no date
        (1, 5, 13, 0, None, d + timedelta(3), 0), (1, 5, 13, 7, None, None, 0)]
    return spark.createDataFrame(rows, VISITS), (d - date(1970, 1, 1)).days


def test_trim_impute_and_link(spark):
    visits, day = longitudinal(spark)
    trimmed = trim_trailing_nonresponse(flag_response(visits))
    kept = {(r["pid"], r["fup"]) for r in trimmed.collect()}
    assert kept == {(1, 0), (1, 2), (1, 4), (2, 0), (2, 2), (2, 4), (4, 0), (4, 2), (5, 0), (5, 7)}
    linked = carry_forward(link_visit_dates(impute_visit_dates(trimmed)), "doi_day")
    got = {(r["pid"], r["fup"]): r for r in linked.collect()}
    # the wave-0 range of study 1 is day 0 to day 3, so its midpoint is half a day
    assert got[1, 0]["doi_day"] == day + 1.5 and got[1, 0]["doi"] == date(2010, 1, 2)
    assert got[1, 2]["doi_day"] is None and got[5, 7]["doi_day"] is None and got[4, 2]["doi_day"] is None
    assert got[1, 4]["prior_day"] == day + 1.5 and got[1, 4]["midpoint_day"] == day + (1.5 + 9) / 2
    assert got[1, 2]["doi_day_last_obs"] == day + 1.5 and got[1, 0]["prior_day"] is None
    assert got[2, 4]["baseline_day"] == day and got[2, 4]["midpoint_day"] == day + 2.0
    assert got[5, 7]["prior_day"] == day + 3 and got[5, 7]["midpoint_day"] is None


def test_events_marked_in_place_equal_events_joined_back(spark):
    visits, day = longitudinal(spark)
    linked = link_visit_dates(impute_visit_dates(keep_schedule(trim_trailing_nonresponse(flag_response(visits)))))
    events = event_or_censor(linked)
    got = {r["pid"]: (r["fup"], r["dm_incident"], r["dm_incident_day"], r["time_to_dm"]) for r in events.collect()}
    assert got == {1: (4, 1, day + 5.25, 3.75), 2: (4, 0, day + 4.0, 4.0), 5: (7, 0, None, None)}
    joined, marked = annotate_events(linked, events), mark_events(linked)
    assert joined.select(marked.columns).exceptAll(marked).isEmpty() and joined.count() == marked.count()
    assert {r["pid"] for r in marked.where("baseline_dm = 1").collect()} == {4}
    at_visit = {r["pid"]: r["dm_incident_day"] for r in event_or_censor(linked, event_date="visit").collect()}
    assert at_visit[1] == day + 9.0


def test_wide_visits_and_profile(spark):
    frame = spark.createDataFrame(
        [(1, 1, 0, 1.0, None), (1, 1, 2, 2.0, 3.0), (1, 2, None, 4.0, None), (1, 2, 0, None, None)],
        "carrs int, pid int, visit int, fpg double, hba1c double")
    wide = {r["pid"]: r for r in visits_to_wide(frame, values=("fpg",)).collect()}
    assert (wide[1]["fpg0"], wide[1]["fpg1"], wide[1]["fpg2"], wide[2]["fpg0"]) == (1.0, None, 2.0, None)
    profile = {r["visit"]: r for r in missingness_profile(frame).collect()}
    assert (profile[0]["n_total"], profile[0]["nmiss_both"], profile[0]["pctmiss_either"]) == (2, 1, 100.0)
    assert None in profile
