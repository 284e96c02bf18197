"""What the corpus operators share: the shared folder, written tables, column names, small chunks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as a pattern that Java, Python and DuckDB read alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: what spark.checkpoint.dir names. Where that is unset and all of Spark is one process (local mode, as in
    tests) a temporary folder takes its place; on a cluster nothing else will do, as executors don't see each other's disks."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: later jobs reread it, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Deletes materialized tables that no later job rereads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have yet, whatever the case."""
    had, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in had:
            name += "_"
        had.add(name.lower())
        out.append(name)
    return out


def word_count(text: str = "text"):
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def is_held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def chunks(batches: Iterable[pd.DataFrame], text: str = "text", most_chars: int = 1_500_000, most_rows: int = 512) -> Iterator[pd.DataFrame]:
    """Slices of the batches that hold few characters each, so that array work on them stays small. A longer text is alone in its slice."""
    for batch in batches:
        sizes = [len(t) if isinstance(t, (str, bytes)) else 0 for t in batch[text]]
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > most_chars or i - start >= most_rows):
                yield batch.iloc[start:i]
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.iloc[start:]


def texts_of(column: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in column]


def folded_bytes(column: pd.Series) -> list[bytes]:
    """Texts as UTF-8 bytes (a binary column) with A to Z in small letters; null is empty."""
    return [t.lower() if isinstance(t, bytes) else b"" for t in column]
