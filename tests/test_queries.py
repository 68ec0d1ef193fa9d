"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def database(sf):
    connection = duckdb.connect()
    for file in os.listdir(sf):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{file}'")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, database, name):
    result = entry.queries()[name](spark, sf)
    columns = sorted(result.columns)
    ours = sorted((tuple(row[c] for c in columns) for row in result.collect()), key=repr)
    cursor = database.execute(entry.oracle_sql()[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(row[i] for i in order) for row in cursor.fetchall()), key=repr)
    assert ours == theirs


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark, sf):
    assert entry.entry(spark).count() > 0
