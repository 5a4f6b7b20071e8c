import pytest
from pyspark.sql import functions as F

from pairwave.functions.joins import attach, first_per_key, null_safe_left_join, require_unique


def make(spark):
    # One key holds a third of all rows; some keys are missing.
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 50).alias("k"))
    summary = rows.dropna(subset=["k"]).where("k <> 7").groupBy("k").agg(
        F.sum("id").alias("total"))
    return rows, summary


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_attach_is_the_plain_join(spark, how):
    rows, summary = make(spark)
    expected = rows.join(summary, "k", how).select("id", "k", *([] if how == "left_semi" else ["total"]))
    got = attach(rows, summary, "k", how=how).select(expected.columns)
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def test_attach_runs_nothing(spark):
    rows, summary = make(spark)
    tracker, group = spark.sparkContext.statusTracker(), "attach-is-lazy"
    spark.sparkContext.setJobGroup(group, group)
    try:
        attach(rows, summary, "k")
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_missing_households_match(spark):
    left = spark.createDataFrame([(1, None), (1, 5), (2, None)], "a int, h int")
    right = spark.createDataFrame([(1, None, "x"), (2, 7, "y")], "a int, h int, v string")
    got = {tuple(r) for r in null_safe_left_join(left, right, ("a", "h")).collect()}
    assert got == {(1, None, "x"), (1, 5, None), (2, None, None)}


def test_missing_keys_are_spread(spark):
    rows, summary = make(spark)
    joined = attach(rows.repartition(4), summary, "k", how="left")
    assert "_spread" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.where("k is null").count() == rows.where("k is null").count()
    assert joined.where("k is null and total is not null").isEmpty()


def test_first_per_key_keeps_one_whole_row(spark):
    frame = spark.createDataFrame([(1, 5, "b"), (1, 3, "c"), (1, 3, "a"), (2, 9, None), (None, 1, "z")],
                                  "k int, o int, v string")
    got = {tuple(r) for r in first_per_key(frame, ["k"], ["o"]).collect()}
    assert got == {(1, 3, "a"), (2, 9, None), (None, 1, "z")}


def test_require_unique(spark):
    frame = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    assert require_unique(frame, ["a", "b"]) is frame
    with pytest.raises(ValueError):
        require_unique(frame, ["a"])
