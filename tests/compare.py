"""Run a query on Spark and its SQL on DuckDB over the same files and compare all values."""

from __future__ import annotations

import datetime
import decimal
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark_df, con, sql) -> str:
    """Empty when equal, else a short description."""
    a_names, a = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    start = time.time()
    rel = con.sql(sql)
    b_names, b = rows_of(rel.columns, rel.fetchall())
    compare.duck = time.time() - start
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if a == b:
        return "" if a else "no rows"
    only_a = list(set(a) - set(b))[:3]
    only_b = list(set(b) - set(a))[:3]
    return f"{sum(x != y for x, y in zip(a, b))} of {len(a)} rows differ, {a_names}: {sorted(only_a, key=repr)} | {sorted(only_b, key=repr)}"
