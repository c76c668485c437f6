"""Compare a query with its SQL in DuckDB: rows by sorted columns, without order."""

import datetime
import decimal
import math
import os

import duckdb


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    return v


def rows(found):
    return sorted((tuple(map(value, r)) for r in found), key=repr)


def by_sql(sql, tables):
    """(columns, rows) of ``sql`` over ``tables``: a folder of Parquet files, or pandas frames by name."""
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    if isinstance(tables, str):
        for name in os.listdir(tables):
            con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{tables}/{name}'")
    else:
        for name, frame in tables.items():
            con.register(name, frame)
    columns = sorted(con.sql(sql).columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    return columns, rows(con.sql(f"SELECT {listed} FROM ({sql.strip()}) q").fetchall())


def by_spark(df):
    columns = sorted(df.columns)
    return columns, rows(df.select(*columns).collect())
