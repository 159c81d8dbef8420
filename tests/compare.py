"""Compares a query with its SQL the way the driver does: by sorted columns and values."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(row[i]) for i in order) for row in data), key=repr)


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    return sorted(found.columns), rows(found.columns, found.fetchall()), [str(t) for _, t in sorted(zip(found.columns, found.types))]


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, df.collect()), [dict(df.dtypes)[c] for c in sorted(df.columns)]


#: Spark's and DuckDB's names of one type.
SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


def differences(df, sql: str, sf_dir: str) -> str:
    """What is not the same, or nothing."""
    (a, x, s), (b, y, t) = spark_rows(df), oracle(sql, sf_dir)
    if a != b:
        return f"columns {a} and {b}"
    types = [(c, p, q) for c, p, q in zip(a, s, t, strict=True) if p in SAME and SAME[p] != q]
    if types:
        return f"types {types}"
    if len(x) != len(y):
        return f"rows {len(x)} and {len(y)}"
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{len(bad)} of {len(x)} rows, as {bad[0]}" if bad else ""
