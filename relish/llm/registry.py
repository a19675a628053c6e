"""Queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(table) -> DataFrame`` under ``key``; ``table(name)`` reads one given table."""

    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return wrap
