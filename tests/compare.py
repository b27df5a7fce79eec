"""Compares a query's rows with DuckDB's, whatever their order."""

from __future__ import annotations

import collections
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else int(value) if value == int(value) and abs(value) < 1e15 else float(f"{value:.9g}")
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(sql: str, folder: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], collections.Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
