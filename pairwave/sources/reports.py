"""Report tables as CSV, and small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_report(report: DataFrame, path: str, order=()) -> None:
    """One quoted CSV file with a header and NA for missing values.

    A report is an aggregate of a few dozen rows, which is why it may be
    sorted and written by one task.
    """
    if order:
        report = report.orderBy(*order)
    (report.coalesce(1).write.mode("overwrite")
     .option("header", True).option("quoteAll", True).option("nullValue", "NA")
     .option("escape", '"').csv(path))


def read_report(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read a report back; cells may hold line breaks."""
    reader = spark.read.option("header", True).option("multiLine", True)
    reader = reader.option("nullValue", "NA").option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def literal_table(spark: SparkSession, rows, schema) -> DataFrame:
    """A small table of values computed on the driver, such as model terms."""
    return spark.createDataFrame(list(rows), schema)
