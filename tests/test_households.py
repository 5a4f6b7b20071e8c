from pyspark.sql import functions as F

from pairwave.operators import households
from pairwave.operators.dyads import flag_dyads_at_risk, members_to_wide, pair_members, role_view
from pairwave.operators.recode import clean_baseline
from pairwave.plans import current
from pairwave.sources import cohort


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_household_summary_leaves_out_missing_households(spark):
    people = spark.createDataFrame([(1, 1, 1), (2, 1, None), (3, None, 1), (4, 2, None)],
                                   "pid int, hhid int, spousedyad_new int")
    got = {r["hhid"]: (r["sum_spouse"], r["count_hh"]) for r in households.household_summary(people).collect()}
    assert got == {1: (1, 2), 2: (0, 1)}
    added = {r["pid"]: r["count_hh"] for r in households.add_household_summary(people).collect()}
    assert added == {1: 2, 2: 2, 3: None, 4: 1}


def test_fused_dyads_equal_the_staged_pipeline(spark, folder):
    inputs = cohort.visit(spark, folder), cohort.baseline(spark, folder), cohort.dyad_flags(spark, folder)
    staged = current.dyads_from_cohort(current.cohort_persons(current.recoded_persons(current.analytic_wide(*inputs))))
    assert same(current.dyads(*inputs), staged)


def test_one_pass_couples_equal_the_two_filters(spark, folder):
    visits = cohort.visit_extra(spark, folder)
    ids = households.eligible_couples(visits).select("hhid")
    staged = households.keep_close_in_age(households.keep_mixed_couples(visits)).select("hhid").distinct()
    assert same(ids, staged)


def test_composition_and_age_gap(spark):
    rows = [(1, 1, "male", 40.0), (1, 2, "female", 58.0), (2, 3, "male", 40.0), (2, 4, "female", 59.0),
            (3, 5, "male", 40.0), (3, 6, "male", 41.0), (4, 7, "male", 40.0), (4, 8, "female", None),
            (5, 9, "male", 30.0), (6, 10, "male", 30.0), (6, 11, "female", 31.0), (6, 12, "female", 32.0)]
    visits = spark.createDataFrame(rows, "hhid int, pid int, sex string, age double").withColumn("fup", F.lit(0))
    assert {r["hhid"] for r in households.mixed_couples(visits).collect()} == {1, 2, 4}
    assert {r["hhid"] for r in households.close_in_age(visits).collect()} == {1, 3}
    assert {r["hhid"] for r in households.eligible_couples(visits).collect()} == {1}


def test_distinct_member_dyads(spark):
    rows = [(1, 1, 1, 1), (1, 1, 1, 1), (1, 1, 2, 1), (1, 2, 3, 1), (1, 2, 4, None), (1, 3, 5, 1), (1, 3, 6, 1),
            (1, 3, 7, 1), (1, None, 8, 1)]
    visits = spark.createDataFrame(rows, "carrs int, hhid int, pid int, spousedyad_new int")
    got = {r["pid"]: r["valid_dyad"] for r in households.distinct_member_dyads(visits).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}
    histogram = {r["n_pid"]: r["Freq"] for r in households.members_histogram(visits).collect()}
    assert histogram == {1: 1, 2: 2, 3: 1}


def test_pairs_take_the_lowest_id_and_need_both(spark):
    rows = [(1, 5, "male", 50.0), (1, 4, "male", 40.0), (1, 6, "female", None), (2, 7, "male", 1.0),
            (None, 8, "male", 1.0), (None, 9, "female", 1.0)]
    people = spark.createDataFrame(rows, "hhid int, pid int, sex string, age double")
    got = [tuple(r) for r in pair_members(people, columns=("age",)).collect()]
    assert got == [(1, 40.0, None)]


def test_members_to_wide(spark):
    rows = [(1, 1, 0, "female", 3, "a"), (1, 1, 0, "male", 2, None), (1, 1, 2, "male", 2, "b")]
    frame = spark.createDataFrame(rows, "hhid int, carrs int, fup int, sex string, pid int, v string")
    assert [tuple(r) for r in members_to_wide(frame).collect()] == [(1, 1, 0, 3, "a", 2, None)]
    assert members_to_wide(frame, complete=False).count() == 2


def test_at_risk_flags_and_roles(spark):
    columns = {f"{c}_{s}": 1 for s in ("husb", "wife") for c in (
        "age", "bmi", "educcat", "educcat2", "famhx_dm", "multimorbiditycat", "bmicat", "smk_overall", "alc_overall",
        "time_to_dm", "event_DMbiomarker")}
    rows = [{"hhid": k, **columns, "dm_biomarker0_husb": h, "dm_biomarker0_wife": w}
            for k, (h, w) in enumerate([(1, 1), (0, 1), (None, 1), (0, None)])]
    rows[3]["bmi_husb"] = None
    schema = ", ".join(f"{c} int" for c in rows[0])
    dyads = flag_dyads_at_risk(spark.createDataFrame([tuple(r.values()) for r in rows], schema))
    got = [(r["dyad_at_risk"], r["female_at_risk"], r["male_at_risk"]) for r in dyads.orderBy("hhid").collect()]
    assert got == [(None, None, None), (1, None, 1), (1, None, 1), (1, 1, None)]
    roles = role_view(dyads)
    assert roles.count() == 8 and roles.where("role = 'Women' and smk_overall is not null").isEmpty()
    assert roles.where("role = 'Men' and smk_overall = 1").count() == 4


def test_sex_codes_fall_through_to_female(spark):
    frame = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, None), (4, 3, 1)], "pid int, site int, sex int").selectExpr(
        "*", "date'2011-05-01' as doi", "cast(null as double) as bmi", "80D as weight_kg", "200D as height_cm")
    got = {r["pid"]: (r["site"], r["sex"], r["bmi"], r["year"]) for r in clean_baseline(frame).collect()}
    assert got == {1: ("Chennai", "male", 20.0, 2011), 2: ("Chennai", "female", 20.0, 2011), 3: ("Delhi", "female", 20.0, 2011)}
    strict = {r["pid"]: r["sex"] for r in clean_baseline(frame, strict=True).collect()}
    assert strict == {1: "male", 2: "female", 3: None}
