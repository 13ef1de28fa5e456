"""Named queries, each registered with the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Queries over whole tables that recursive SQL is too slow for; tests hold them against brute force.
WITHOUT_SQL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name, or another one."""

    def put(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
