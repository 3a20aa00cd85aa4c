"""Small tables from partial rows, and result comparison with DuckDB."""

from __future__ import annotations

import math
from datetime import datetime

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ordergauge.sources.schemas import SCHEMAS, columns_of
from ordergauge.sources.tables import Tables

ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "string": pa.string(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "timestamp_ntz": pa.timestamp("us"),
}

Rows = dict[str, list[dict]]


def _value(kind: str, value):
    if value is None:
        return None
    if kind == "timestamp_ntz" and isinstance(value, str):
        return datetime.fromisoformat(value)
    return float(value) if kind == "double" else value


def _rows(name: str, rows: list[dict]) -> list[tuple]:
    columns = columns_of(name)
    for row in rows:
        assert row.keys() <= columns.keys(), row.keys() - columns.keys()
    return [tuple(_value(kind, row.get(column)) for column, kind in columns.items()) for row in rows]


def spark_tables(spark: SparkSession, data: Rows) -> Tables:
    """Logical tables with the given rows; a column that a row does not name is NULL, other tables are empty."""

    def load(name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        return spark.createDataFrame(_rows(name, data.get(name, [])), SCHEMAS[name])

    return Tables(load)


def duck_tables(data: Rows) -> duckdb.DuckDBPyConnection:
    """The tables in a database that compares texts without case, as the source databases do."""
    connection = duckdb.connect()
    connection.execute("set default_collation = 'nocase'")
    for name in SCHEMAS:
        columns = columns_of(name)
        rows = _rows(name, data.get(name, []))
        arrays = [pa.array([row[i] for row in rows], type=ARROW[kind]) for i, kind in enumerate(columns.values())]
        connection.register(f"{name}_rows", pa.table(arrays, names=list(columns)))
        connection.execute(f"create table {name} as select * from {name}_rows")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def spark_result(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    rows = [row.asDict() for row in df.collect()]
    return names, sorted(tuple(_plain(row[name]) for name in names) for row in rows)


def duck_result(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    given = [item[0] for item in cursor.description]
    names = sorted(given)
    rows = cursor.fetchall()
    return names, sorted(tuple(_plain(row[given.index(name)]) for name in names) for row in rows)
