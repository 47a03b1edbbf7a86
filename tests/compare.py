"""Runs a query and its SQL twin on the same tables and lines the rows up."""

from __future__ import annotations

import math

import duckdb

from comarca.sources import SCHEMAS


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    names = [columns[i] for i in order]
    return names, sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    result = con.execute(sql)
    return rows_of([c[0] for c in result.description], result.fetchall())


# Families of types that a result may use on each side.
SPARK_KIND = {
    "int": "int", "bigint": "bigint", "double": "double", "string": "text", "boolean": "bool",
}
DUCK_KIND = {
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "text", "BOOLEAN": "bool",
}


def spark_types(df):
    return {f.name: SPARK_KIND.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}


def sql_types(con, sql):
    described = con.execute(f"describe {sql}").fetchall()
    return {row[0]: DUCK_KIND.get(row[1], row[1]) for row in described}
