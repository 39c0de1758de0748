"""Registration of queries: a function of the tables, and SQL that another engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

Tables = Callable[[str], DataFrame]


def tables(spark: SparkSession, folder: str) -> Tables:
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Registers a function of Tables under its name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(tables(spark, folder))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register
