"""Spark results against DuckDB's for the same query."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in data], key=repr)


def differences(spark_df, con, sql, most=3):
    got = rows(spark_df.columns, spark_df.collect())
    found = con.sql(sql)
    expected = rows(found.columns, found.fetchall())
    if sorted(spark_df.columns) != sorted(found.columns):
        return [("columns", spark_df.columns, found.columns)]
    if got == expected:
        return []
    a, b = set(map(repr, got)), set(map(repr, expected))
    return [("rows", len(got), len(expected)), *sorted(a - b)[:most], "expected", *sorted(b - a)[:most]]
