"""Reading typed tables and writing stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pairwave.functions.columns import nan_to_null
from pairwave.functions.joins import require_unique

_INT, _LONG, _DOUBLE, _DATE, _TEXT = T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType(), T.StringType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


VISIT_SCHEMA = _schema(
    pid=_LONG, carrs=_INT, hhid=_LONG, fup=_INT, visit=_INT, doi=_DATE, reason=_TEXT,
    fpg=_DOUBLE, hba1c=_DOUBLE, dm=_INT, dm_allo=_INT)
DYAD_FLAG_SCHEMA = _schema(pid=_LONG, hhid=_LONG, spousedyad_new=_INT)
BASELINE_SCHEMA = _schema(
    pid=_LONG, hhid=_LONG, carrs=_INT, site=_INT, sex=_INT, doi=_DATE, age=_DOUBLE, educstat=_INT, employ=_INT,
    occ=_INT, height_cm=_DOUBLE, weight_kg=_DOUBLE, bmi=_DOUBLE, waist_cm=_DOUBLE, smk_overall=_INT,
    alc_overall=_INT, famhx_dm=_INT, famhx_htn=_INT, famhx_cvd=_INT, htn=_INT, dm=_INT, chd=_INT, cva=_INT, ckd=_INT)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               source: str = "parquet", **options) -> DataFrame:
    """Read with a declared schema and turn NaN into null."""
    reader = spark.read.format(source).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.load(path))


def read_visits(spark: SparkSession, path: str, source: str = "parquet", check_key: bool = True,
                **options) -> DataFrame:
    """Long visit table; its key (study, person, wave) is checked unless trusted.

    The key is what bounds a person's rows, and with them every window over
    a person, by the number of waves.
    """
    visits = read_table(spark, path, VISIT_SCHEMA, source, **options)
    return require_unique(visits, ("carrs", "pid", "fup")) if check_key else visits


def read_baseline(spark: SparkSession, path: str, source: str = "parquet", **options) -> DataFrame:
    return read_table(spark, path, BASELINE_SCHEMA, source, **options)


def read_dyad_flags(spark: SparkSession, path: str, source: str = "parquet", **options) -> DataFrame:
    return read_table(spark, path, DYAD_FLAG_SCHEMA, source, **options)


def write_stage(frame: DataFrame, path: str, partition_by=()) -> None:
    """Write a stage's output; the next stage reads it with ``read_stage``."""
    writer = frame.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
