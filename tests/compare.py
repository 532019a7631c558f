"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares whole results."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """Values of both engines in one form. Types stay apart: a number is no text."""
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else round(value, 6)
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_kind(dtype):
    return {"int": "int", "bigint": "bigint", "double": "double", "string": "text", "boolean": "bool",
            "timestamp_ntz": "time"}.get(dtype, dtype)


def duck_kind(dtype):
    return {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "text", "BOOLEAN": "bool",
            "TIMESTAMP": "time"}.get(str(dtype), str(dtype))


def differences(df, con, sql):
    """Empty list if names, types and rows agree."""
    result = con.sql(sql)
    found = []
    ours = {c: spark_kind(t) for c, t in df.dtypes}
    theirs = {c: duck_kind(t) for c, t in zip(result.columns, result.types)}
    if ours != theirs:
        found.append(f"schema {sorted(ours.items())} / {sorted(theirs.items())}")
    if set(ours) != set(theirs):
        return found
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b = rows_of(result.columns, result.fetchall())
    if len(a) != len(b):
        found.append(f"rows {len(a)} / {len(b)}")
    if a != b:
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        found.append(f"columns {sorted(ours)}\n  spark only {str(only_a)[:1500]}\n  sql only   {str(only_b)[:1500]}")
    return found
