"""Every named query against its SQL twin on the smallest tables, value by value."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from ledgerloom.plans.registry import builders, sql_twins

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def test_every_query_has_a_twin():
    assert set(builders()) == set(sql_twins())
    assert set(builders()) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", builders())
def test_query_equals_its_twin(spark, db, name):
    frame = contract.queries()[name](spark, FOLDER)
    found = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    got = ordered(frame.columns, [tuple(r) for r in frame.collect()])
    want = ordered(columns, found.fetchall())
    assert [repr(r) for r in got] == [repr(r) for r in want]


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 5
