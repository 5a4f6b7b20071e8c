import math

from pyspark.sql import functions as F

from pairwave.functions.columns import (
    count_equal, count_known, count_null, day_number, day_to_date, first_match, fixed, is_in, mean_known,
    nan_to_null, percent, recode, sum_known)


def one(frame, *columns):
    return tuple(frame.select(*columns).first())


def test_missing_value_rules(spark):
    frame = spark.createDataFrame([(None, 1, 2.0, float("nan"))], "a int, b int, c double, d double")
    assert one(frame, first_match((F.col("a") == 1, "x"), (F.col("b") == 1, "y"))) == ("y",)
    assert one(frame, ~is_in("a", (0, 1)), is_in("b", (0, 1))) == (True, True)
    clean = nan_to_null(frame)
    assert one(clean, first_match((F.col("d") >= 126, 1), default=0), F.col("c")) == (0, 2.0)
    assert one(clean, sum_known(("a", "d")), mean_known(("a", "d")), mean_known(("a", "c"))) == (0.0, None, 2.0)
    assert one(frame, count_null(("a", "b")), count_known(("a", "b")), count_equal(("a", "b"), 1)) == (1, 1, 1)
    assert one(frame, percent(F.lit(3), F.lit(0)), percent(F.lit(1), F.lit(4))) == (None, 25.0)
    assert one(frame, recode("b", {7: (1, 2)}), recode("a", {7: (1, 2)})) == (7, None)


def test_half_days_floor_to_the_earlier_date(spark):
    frame = spark.sql("select date'1969-12-31' as d, date'2000-03-01' as e")
    assert one(frame, day_number("d"), day_number("e")) == (-1.0, 11017.0)
    middle = (day_number(F.col("d")) + day_number(F.col("d")) + 1.0) / 2.0
    assert str(one(frame, day_to_date(middle))[0]) == "1969-12-31"


def test_fixed_text(spark):
    frame = spark.createDataFrame([(None, 58.50509)], "a double, b double")
    assert one(frame, fixed(F.col("a"), 1), fixed(F.col("b"), 1)) == ("NA", "58.5")
    assert math.isclose(58.50509, one(frame, "b")[0])
