import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, rows_of
from oracle.queries import MODEL_STATEMENTS, STATEMENTS
from pairwave.plans.catalog import QUERIES

CHECKED = [*STATEMENTS, *MODEL_STATEMENTS]


@pytest.fixture(scope="module")
def connection(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def test_every_query_has_a_reference():
    own = set(STATEMENTS) | set(MODEL_STATEMENTS)
    assert set(QUERIES) == own and own <= set(entry.queries()) and own <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_reference(spark, connection, folder, name):
    frame = entry.queries()[name](spark, folder)
    result = connection.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    got, want = rows_of(frame.columns, [tuple(r) for r in frame.collect()]), rows_of(names, result.fetchall())
    assert len(got) == len(want) and len(got) > 0
    assert [(a, b) for a, b in zip(got, want) if a != b] == []


def test_entry_runs(spark):
    frame = entry.entry(spark)
    assert frame.columns[:2] == ["role", "partner_baseline_dm"] and frame.count() > 0
