"""A deterministic cohort over the ``customer`` and ``orders`` tables.

Customers play the people and their orders the visits.  The expressions give
the same values in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwave.functions.columns import nan_to_null

_COUPLE = "(c_custkey div 2)"
_WEALTH = "(c_acctbal + 1000) / 11000"


def _int(expression: str) -> str:
    return f"cast({expression} as int)"


def _unless(condition: str, expression: str) -> str:
    return f"case when {condition} then null else {expression} end"


PERSON_COLUMNS = {
    "pid": "c_custkey",
    "hhid": f"{_COUPLE} + case when c_custkey % 29 = 0 then 1 else 0 end",
    "carrs": _int(f"1 + {_COUPLE} % 2"),
    "site": _int(f"1 + {_COUPLE} % 3"),
    "sex": _int("case when (c_custkey % 2 = 0) <> (c_custkey % 23 = 0) then 1 else 2 end"),
    "doi": "date_add(date'2010-10-01', cast(c_custkey % 600 as int))",
    "age": f"cast(25 + ({_COUPLE} * 7) % 40 + (c_custkey % 2) * (c_custkey % 25) as double)",
    "educstat": _int("1 + c_custkey % 7"),
    "employ": _int(_unless("c_custkey % 31 = 0", "1 + (c_custkey * 3) % 5")),
    "occ": _int("1 + c_custkey % 5"),
    "height_cm": "cast(150 + c_custkey % 35 as double)",
    "weight_kg": _unless("c_custkey % 13 = 0", f"45 + {_WEALTH} * 50"),
    "bmi": _unless("c_custkey % 5 = 0", f"18 + {_WEALTH} * 20"),
    "waist_cm": _unless("c_custkey % 37 = 0", f"70 + {_WEALTH} * 40"),
    "smk_overall": _int("case when c_custkey % 3 = 0 then 1 else 0 end"),
    "alc_overall": _int("c_custkey % 3"),
    "famhx_dm": _int("case when c_custkey % 19 = 0 then null when c_mktsegment = 'BUILDING' then 1 else 0 end"),
    "famhx_htn": _int("case when c_mktsegment = 'MACHINERY' then 1 else 0 end"),
    "famhx_cvd": _int("case when c_mktsegment = 'FURNITURE' and c_custkey % 2 = 0 then 1 else 0 end"),
    "htn": _int("case when c_custkey % 11 = 0 then null when c_nationkey < 4 then 1 else 0 end"),
    "dm": _int("case when c_custkey % 17 = 0 then null when c_nationkey = 5 then 1 else 0 end"),
    "chd": _int("case when c_nationkey = 6 then 1 else 0 end"),
    "cva": _int("case when c_nationkey = 7 then 1 else 0 end"),
    "ckd": _int("case when c_nationkey = 8 then 1 else 0 end"),
    "spousedyad_new": _int(_unless("c_custkey % 41 = 0", "1")),
}

# Waves of the main visits per study: wave -> visit number.
MAIN_VISITS = {1: {0: 0, 2: 1, 4: 2, 7: 3}, 2: {0: 0, 2: 1}}
# The calendar grid: waves follow each other from the first day, each of so many days per study.
FIRST_DAY, WAVE_DAYS = "date'1995-01-01'", {1: 301, 2: 802}


# Only the columns that are used; a declared schema needs no look at the files.
SCHEMAS = {
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return nan_to_null(spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet"))


def person(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline person table; its dyad flags are ``pid, hhid, spousedyad_new``."""
    customer = _table(spark, folder, "customer")
    return customer.selectExpr(*[f"{e} as {c}" for c, e in PERSON_COLUMNS.items()])


def baseline(spark: SparkSession, folder: str) -> DataFrame:
    return person(spark, folder).drop("spousedyad_new")


def dyad_flags(spark: SparkSession, folder: str) -> DataFrame:
    return person(spark, folder).select("pid", "hhid", "spousedyad_new")


def _waves(spark: SparkSession, folder: str) -> DataFrame:
    """Visits beside their person's columns: a customer's orders in one period of the calendar are a wave.

    Every order belongs to a wave.  The orders of a (person, wave) are combined before the shuffle,
    so it is a key, and a customer with a huge number of orders sends one row per wave and task.
    """
    days = " ".join(f"when {study} then {width}" for study, width in WAVE_DAYS.items())
    study = PERSON_COLUMNS["carrs"].replace("c_custkey", "o_custkey")
    orders = _table(spark, folder, "orders").selectExpr(
        "*", f"cast(datediff(cast(o_orderdate as date), {FIRST_DAY}) div case {study} {days} end as int) as fup")
    combined = orders.groupBy("o_custkey", "fup").agg(
        F.min("o_orderkey").alias("o_orderkey"), F.min("o_orderdate").alias("o_orderdate"),
        F.max("o_totalprice").alias("o_totalprice"), F.min("o_orderpriority").alias("o_orderpriority"),
        F.count(F.lit(1)).alias("orders"))
    people = person(spark, folder).drop("doi").withColumnRenamed("dm", "baseline_dm")
    return combined.join(people, combined["o_custkey"] == people["pid"])


_NUMBER = " ".join(f"when carrs = {s} and fup = {w} then {v}"
                   for s, visits in MAIN_VISITS.items() for w, v in visits.items())
VISIT_COLUMNS = {
    "pid": "pid", "carrs": "carrs", "hhid": "hhid", "fup": "fup",
    "visit": f"case {_NUMBER} end",
    "doi": "case when o_orderkey % 23 = 0 then null else cast(o_orderdate as date) end",
    "reason": "case when o_orderkey % 9 = 0 then 'refused' end",
    "fpg": _unless("o_orderkey % 7 = 0", "70 + o_totalprice / 500000 * 65"),
    "hba1c": _unless("o_orderkey % 8 = 0", "4.5D + ((o_orderkey * 37) % 1000) / 1000.0D * 2.1D"),
    "dm": _int("case when o_orderkey % 6 = 0 then null"
               " when o_orderpriority = '1-URGENT' and o_orderkey % 5 = 0 then 1 else 0 end"),
    "dm_allo": _int("case when o_orderkey % 10 = 0 then null when o_orderkey % 97 = 0 then 1 else 0 end"),
}


def visit(spark: SparkSession, folder: str) -> DataFrame:
    """Long visit table, one row per (study, person, wave)."""
    return _waves(spark, folder).selectExpr(*[f"{e} as {c}" for c, e in VISIT_COLUMNS.items()])


EXTRA_COLUMNS = {
    "sex": "case when sex = 1 then 'male' else 'female' end",
    "age": "age", "bmi": "bmi",
    "sbp2": _unless("(pid + fup) % 11 = 0", "cast(100 + (pid * 7 + fup * 5) % 60 as double)"),
    "sbp3": _unless("(pid + fup) % 12 = 0", "cast(98 + (pid * 3 + fup * 5) % 60 as double)"),
    "dbp2": _unless("(pid + fup) % 11 = 0", "cast(60 + (pid * 7 + fup * 5) % 40 as double)"),
    "dbp3": _unless("(pid + fup) % 12 = 0", "cast(58 + (pid * 3 + fup * 5) % 40 as double)"),
    "htn": "htn",
    "htn_med": _int("case when pid % 14 = 0 then 1 when pid % 3 = 0 then null else 0 end"),
    "htn_allo": _int(_unless("pid % 4 = 0", "0")),
    "tg": _unless("pid % 9 = 0", "cast(80 + (pid * 11 + fup) % 140 as double)"),
    "chd": "chd",
    "chd_allo": _int("case when pid % 6 = 0 then null when pid % 25 = 0 then 1 else 0 end"),
    "cva": "cva", "ckd": "ckd", "famhx_cvd": "famhx_cvd", "famhx_htn": "famhx_htn", "famhx_dm": "famhx_dm",
    "alc_curr": _int(_unless("fup = 0", "pid % 2")),
    "alc_often": _int(_unless("fup > 0 or pid % 5 = 0", "pid % 5")),
    "alc_overall": _int(_unless("fup > 0", "pid % 3")),
    "smk_curr": _int("case when pid % 8 = 0 then null when fup > 0 then pid % 2 end"),
    "smk_ever": _int("case when fup = 0 then pid % 2 end"),
    "smk_overall": _int("case when fup = 0 then pid % 3 end"),
    "smk_smoke_freq": _int("case when pid % 10 = 0 then 1 + pid % 4 end"),
    "smk_chew_freq": _int("case when pid % 21 = 0 then 2 end"),
    "edu_category": _int("case when educstat >= 5 then 1 when educstat >= 3 then 2 else 3 end"),
    "employ_category": "employ",
    "hhincome": _int("1 + hhid % 4"),
    "hld": _int(_unless("pid % 53 = 0", "pid % 2")),
    "religion": _int("1 + pid % 4"),
    "caste": _int(_unless("pid % 47 = 0", "1 + pid % 3")),
    "site": "site",
}


def visit_extra(spark: SparkSession, folder: str) -> DataFrame:
    """The visits with the covariates of the longitudinal variant."""
    columns = {**VISIT_COLUMNS, "spousedyad_new": "spousedyad_new", **EXTRA_COLUMNS}
    return _waves(spark, folder).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])
