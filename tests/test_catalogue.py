"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from lodestay.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def _same(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_same(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    found = catalogue.queries()[name](spark, SF)
    wanted = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(wanted.columns, wanted.fetchall())


def test_entry_and_import_without_llm(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
