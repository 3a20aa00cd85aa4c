"""Every registered query against its SQL text in DuckDB, on the test data and on random tables full of edge cases."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import oracle_queries
from ordergauge.plans.shared import with_stored_facts
from tests.random_rows import random_rows
from tests.support import duck_result, duck_tables, spark_result, spark_tables

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(entry.operators())
SLOW = {"metric_values", "scorecard_file"}  # the scorecard covers them, and tests/test_files.py the file


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        path = os.path.join(SF_DIR, file)
        connection.execute(f"create view {file.removesuffix('.parquet')} as select * from '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(entry.operators()) == set(oracle_queries.texts()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", [name for name in NAMES if name not in SLOW])
def test_on_test_data(spark, base, name):
    result = spark_result(entry.queries()[name](spark, SF_DIR))
    assert result == duck_result(base, entry.oracle_sql()[name])


@pytest.fixture(scope="module", params=[1, 2])
def edge_cases(spark, request):
    rows = random_rows(request.param, 220)
    tables = spark_tables(spark, rows)
    for name in rows:
        tables[name].cache()
    return tables, duck_tables(rows)


@pytest.fixture(scope="module")
def stored_joins(spark, edge_cases):
    return with_stored_facts(spark, edge_cases[0])


@pytest.mark.parametrize("name", [name for name in NAMES if name not in SLOW | {"scorecard", "ticket_pages"}])
def test_on_random_tables(spark, edge_cases, name):
    tables, connection = edge_cases
    result = spark_result(entry.operators()[name](spark, tables))
    assert result == duck_result(connection, oracle_queries.bodies()[name])


STORED = ["bounced_orders", "fill_rate_gap", "first_pick_fill_rate", "store_bounce_rate", "unique_fill_rate", "vendor_bounced_orders"]


@pytest.mark.parametrize("name", STORED)
def test_stored_joins_give_the_same(spark, edge_cases, stored_joins, name):
    result = spark_result(entry.operators()[name](spark, stored_joins))
    assert result == duck_result(edge_cases[1], oracle_queries.bodies()[name])


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns[:2] == ["days", "location_sub_type_id"]
    assert result.count() > 0
