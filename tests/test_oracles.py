"""Every named query against its SQL, on the smallest sample tables."""

from __future__ import annotations

import duckdb
import pytest
from check_oracles import TABLES, compare

from __spark_entry__ import entry, oracle_sql, queries
from ledgerloom.plans.oracles import ORACLES
from ledgerloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def db(small_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small_dir}/{table}.parquet'")
    return connection


def test_every_query_has_sql_or_a_reason():
    assert set(ORACLES) == set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, small_dir, db, name):
    rows = QUERIES[name](spark, small_dir).toPandas()
    assert compare(rows, db.execute(ORACLES[name]).df()).startswith("ok")


def test_entry(spark, small_dir):
    frame = entry(spark)
    assert len(frame.columns) == 23 and frame.count() == 6000
