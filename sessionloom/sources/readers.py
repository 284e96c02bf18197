"""Sources: replay of files, incremental tables, spans, and streams of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replayed(files: DataFrame) -> DataFrame:
    """file, seq (place of the line, from 0), line for all lines of files (file, content) that aren't blank."""
    each = files.select("file", F.posexplode(F.split("content", "\n", -1)).alias("seq", "line"))
    return each.where(F.trim("line") != "").withColumn("seq", F.col("seq").cast("long"))


def replay_files(spark: SparkSession, path: str) -> DataFrame:
    """replayed() for the text files of a folder, each whole so that the order of its lines holds."""
    return replayed(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")))


def after_mark(table: DataFrame, order: str, mark, columns: list[str]) -> DataFrame:
    """The rows above a high-water mark, narrowed: both reach the scan."""
    return table.where(F.col(order) > mark).select(*columns)


def next_mark(rows: DataFrame, order: str):
    """The mark to go on from; None if there was nothing."""
    return rows.agg(F.max(order)).first()[0]


def from_database(spark: SparkSession, url: str, table: str, order: str, mark, lower, upper, parts: int = 16) -> DataFrame:
    """A database table above a mark, read in ranges of the order column by many tasks."""
    return spark.read.jdbc(url, table, column=order, lowerBound=lower, upperBound=upper, numPartitions=parts, properties={"pushDownPredicate": "true"}).where(F.col(order) > mark)


def followed(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """Lines of new files of a folder, as a stream."""
    return spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path).select(F.col("value").alias("line"), F.current_timestamp().alias("received_at"))


def span_events(spans: DataFrame, keys: list[str], end: str) -> DataFrame:
    """kind, ts (the span's end), duration_ms (never below 0) of spans (start_ns, end_ns, status)."""
    duration = F.greatest(F.lit(0), F.floor((F.col("end_ns") - F.col("start_ns")) / 1000000)).cast("long")
    return spans.select(*keys, F.when(F.col("status") == "ERROR", "session.error").otherwise("span.completed").alias("kind"), F.col(end).alias("ts"), duration.alias("duration_ms"))
