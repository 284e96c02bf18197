"""Sinks: columnar files, JSON lines, first-wins and latest-wins tables, and several at once that don't stop each other."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.governance import first_delivery

log = logging.getLogger(__name__)
Sink = Callable[[DataFrame], None]


def parquet_sink(path: str, partition: str = "session_day", rows_a_file: int = 1_000_000) -> Sink:
    """Columnar files by day, not by session: a folder for each session would be too many."""
    return lambda rows: rows.withColumn(partition, F.to_date("ts")).write.mode("append").option("maxRecordsPerFile", rows_a_file).option("compression", "zstd").partitionBy(partition).parquet(path)


def json_sink(path: str) -> Sink:
    return lambda rows: rows.write.mode("append").json(path)


def first_wins_sink(path: str, key: str = "id") -> Sink:
    """Appends rows whose key isn't there yet."""

    def write(rows: DataFrame) -> None:
        spark = rows.sparkSession
        new = first_delivery(rows, [key], ["ts"])
        try:
            new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(path)

    return write


def by_action(sink: Sink, actions: tuple[str, ...] = ("escalate", "deny"), column: str = "action") -> Sink:
    return lambda rows: sink(rows.where(F.col(column).isin(*actions)))


def by_kind(sink: Sink, *patterns: str) -> Sink:
    """Kinds that are equal to a pattern, or begin with what is before its `.*`."""
    keep = F.lit(False)
    for p in patterns:
        keep = keep | (F.col("kind").startswith(p[:-1]) if p.endswith(".*") else F.col("kind") == p)
    return lambda rows: sink(rows.where(keep))


def fan_out(sinks: dict[str, Sink]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each sink gets the batch; one that fails is logged and doesn't stop the others."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(rows)
                except Exception:
                    log.exception("sink %s failed on batch %s", name, batch)
        finally:
            rows.unpersist()

    return write
