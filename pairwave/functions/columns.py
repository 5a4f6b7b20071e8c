"""Column helpers that carry the missing-value rules of the cohort data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def first_match(*rules: tuple[Column, object], default=None) -> Column:
    """CASE expression from (condition, value) pairs, first true condition wins.

    A null condition counts as false, as in SQL.
    """
    (condition, value), *rest = rules
    chain = F.when(condition, as_column(value))
    for condition, value in rest:
        chain = chain.when(condition, as_column(value))
    return chain.otherwise(as_column(default))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def is_in(name: str, values) -> Column:
    """Set membership that is false, not null, for a missing value."""
    return F.coalesce(F.col(name).isin(*values), F.lit(False))


def recode(name: str, groups: dict[object, tuple], default=None) -> Column:
    """Map sets of codes to new codes: ``{new: (old, old, ...)}``."""
    return first_match(*((F.col(name).isin(*old), new) for new, old in groups.items()), default=default)


def count_null(names) -> Column:
    return reduce(lambda a, b: a + b, (F.col(n).isNull().cast("int") for n in names))


def count_known(names) -> Column:
    return reduce(lambda a, b: a + b, (F.col(n).isNotNull().cast("int") for n in names))


def count_equal(names, value) -> Column:
    """How many of the columns equal ``value``; missing ones do not count."""
    return reduce(lambda a, b: a + b,
                  (F.coalesce((F.col(n) == value).cast("int"), F.lit(0)) for n in names))


def sum_known(names) -> Column:
    """Row sum that skips missing values; 0 when all are missing."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(n), F.lit(0)) for n in names))


def mean_known(names) -> Column:
    """Row mean of the known values; null when all are missing."""
    return F.try_divide(sum_known(names).cast("double"), count_known(names).cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null instead of an error for an empty whole."""
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))


def nan_to_null(frame: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column.

    Spark orders NaN above every number, so an unconverted NaN would pass a
    ``>=`` threshold.
    """
    floating = {f.name for f in frame.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return frame.selectExpr(*[
        f"case when not isnan(`{c}`) then `{c}` end as `{c}`" if c in floating else f"`{c}`" for c in frame.columns])


def day_number(date: Column) -> Column:
    """Days since 1970-01-01 as a double, so that half days can be added."""
    return F.unix_date(date).cast("double")


def day_to_date(day: Column) -> Column:
    """The calendar date a (possibly half) day number falls on."""
    return F.date_from_unix_date(F.floor(day).cast("int"))


def fixed(value: Column, digits: int) -> Column:
    """Number as text with fixed decimals; the text NA for a missing value."""
    return F.coalesce(F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value)), F.lit("NA"))
