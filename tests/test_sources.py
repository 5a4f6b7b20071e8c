import pytest
from pyspark.sql import functions as F

from pairwave.sources.reports import literal_table, read_report, write_report
from pairwave.sources.tables import VISIT_SCHEMA, read_stage, read_table, read_visits, write_stage


def test_nan_is_missing_and_the_key_is_checked(spark, tmp_path):
    path = str(tmp_path / "visits")
    row = dict.fromkeys(VISIT_SCHEMA.fieldNames()) | {"carrs": 1, "pid": 1, "fup": 0, "fpg": float("nan"), "hba1c": 6.0}
    frame = spark.createDataFrame([tuple(row.values())], VISIT_SCHEMA)
    frame.write.parquet(path)
    got = read_visits(spark, path).first()
    assert got["fpg"] is None and got["hba1c"] == 6.0
    frame.unionByName(frame).write.parquet(path + "2")
    assert read_visits(spark, path + "2", check_key=False).count() == 2
    with pytest.raises(ValueError):
        read_visits(spark, path + "2")


def test_csv_source_with_schema(spark, tmp_path):
    path = tmp_path / "flags.csv"
    path.write_text("pid,hhid,spousedyad_new\n1,2,1\n3,,\n")
    got = read_table(spark, str(path), "pid long, hhid long, spousedyad_new int", "csv", header=True)
    assert [tuple(r) for r in got.orderBy("pid").collect()] == [(1, 2, 1), (3, None, None)]


def test_stage_round_trip(spark, tmp_path):
    path = str(tmp_path / "stage")
    frame = spark.range(10).withColumn("carrs", F.col("id") % 2)
    write_stage(frame, path, partition_by=["carrs"])
    assert read_stage(spark, path).where("carrs = 1").count() == 5


def test_report_keeps_line_breaks_missing_values_and_order(spark, tmp_path):
    path = str(tmp_path / "report")
    table = literal_table(spark, [(2, 'say "x"', None), (1, "412 (10.2%)\n(43.6%)", 0.5)], "k int, t string, v double")
    write_report(table, path, order=["k"])
    files = [p for p in (tmp_path / "report").iterdir() if p.name.startswith("part-")]
    assert len(files) == 1 and files[0].read_text().startswith('"k","t","v"\n"1","412')
    got = [tuple(r) for r in read_report(spark, path, "k int, t string, v double").collect()]
    assert got == [(1, "412 (10.2%)\n(43.6%)", 0.5), (2, 'say "x"', None)]
