"""Rows of a Spark query against rows of its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v) + 0.0:.5g}"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.datetime):
        return str(v.date()) if not (v.hour or v.minute or v.second) else str(v)
    return str(v)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def both(con, df, sql):
    """(names, rows) of each side, comparable."""
    r = con.sql(sql)
    return (sorted(df.columns), sorted_rows(df.columns, [tuple(x) for x in df.collect()])), (sorted(r.columns), sorted_rows(r.columns, r.fetchall()))
