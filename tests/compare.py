"""Order-insensitive comparison of a Spark result with DuckDB's answer on the same files."""

from __future__ import annotations

import math
from datetime import datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(([plain(row[i]) for i in order] for row in rows), key=repr)


def spark_result(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def duck_result(con, sql):
    found = con.execute(sql)
    return normal([d[0] for d in found.description], found.fetchall())


def kinds(rows):
    return [{type(v).__name__ for v in column if v is not None} for column in zip(*rows)]


def difference(spark_df, con, sql) -> str | None:
    names, rows = spark_result(spark_df)
    expected_names, expected = duck_result(con, sql)
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    for mine, theirs in zip(rows, expected):
        if mine != theirs:
            cells = [(n, str(a)[:300], str(b)[:300]) for n, a, b in zip(names, mine, theirs) if a != b]
            return f"first difference {cells} in {str(mine)[:200]}"
    if kinds(rows) != kinds(expected):
        return f"types {kinds(rows)} != {kinds(expected)} of {names}"
    return None
