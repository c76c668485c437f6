"""Registration of queries with their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Queries over literal rows, which the tests hold against their SQL; they read no table and aren't among the registered ones.
EXAMPLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXAMPLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, to: tuple[dict, dict] = (QUERIES, ORACLES)):
    """Register a query over given tables under its function's name, and its SQL if SQL can express it."""

    def add(f):
        key = name or f.__name__
        if key in to[0]:
            raise ValueError(f"query {key} is registered twice")
        to[0][key] = f
        if sql:
            to[1][key] = sql
        return f

    return add


def example(sql: str | None = None, name: str | None = None):
    """Keep a query over literal rows as a test."""
    return query(sql, name, (EXAMPLES, EXAMPLE_SQL))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def inline(spark: SparkSession, values: str, columns: str) -> DataFrame:
    """A small literal table from SQL VALUES, shared with the query's SQL."""
    return spark.sql(f"SELECT * FROM (VALUES {values}) AS t({columns})")
