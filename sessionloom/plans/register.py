"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(read) as a query; read(table) gives a DataFrame of the given tables."""

    def put(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return fn

    return put
