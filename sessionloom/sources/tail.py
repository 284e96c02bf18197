"""Growing files as a stream of whole lines."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, position long, line string"
STEP = 1 << 16


@dataclass
class Part(InputPartition):
    """Lines of a file that begin in [low, high). first: low is the beginning of a line."""

    identity: str
    path: str
    low: int
    high: int
    first: bool


def _identity(stat: os.stat_result) -> str:
    return f"{stat.st_dev}:{stat.st_ino}"


def _whole_lines(path: str, size: int) -> int:
    """Where the last whole line of the first size bytes ends, found from behind."""
    with open(path, "rb") as file:
        end = size
        while end > 0:
            low = max(0, end - STEP)
            file.seek(low)
            if (at := file.read(end - low).rfind(b"\n")) >= 0:
                return low + at + 1
            end = low
    return 0


class TailReader(DataSourceStreamReader):
    """An offset is, for each file by its identity, the file's name and how far its whole lines reach. A file that is renamed keeps its place,
    a new one of the old name begins at 0, and so does one that has become shorter."""

    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.at_end = options.get("startat", "beginning") == "end"
        self.part_bytes = int(options.get("partbytes", 64 << 20))
        self.must_find = options.get("failondataloss", "true").lower() == "true"

    def _now(self) -> dict:
        found = {}
        for path in sorted(glob.glob(self.pattern)):
            try:
                stat = os.stat(path)
                if os.path.isfile(path):
                    found[_identity(stat)] = [path, _whole_lines(path, stat.st_size)]
            except FileNotFoundError:  # renamed or removed since it was listed; the next batch sees what became of it
                continue
        return found

    def initialOffset(self) -> dict:
        return {"files": self._now() if self.at_end else {}}

    def latestOffset(self) -> dict:
        return {"files": self._now()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = []
        for identity, (path, high) in sorted(end["files"].items(), key=lambda f: f[1][0]):
            before = start["files"].get(identity, [path, 0])[1]
            low = before if before <= high else 0
            parts += [Part(identity, path, at, min(at + self.part_bytes, high), at == low) for at in range(low, high, self.part_bytes)]
        return parts

    def _find(self, part: Part) -> str | None:
        """The present name of the part's file: it may have been renamed since the offset was taken."""
        for path in [part.path, *sorted(glob.glob(self.pattern))]:
            try:
                if _identity(os.stat(path)) == part.identity:
                    return path
            except FileNotFoundError:
                continue
        if self.must_find:
            raise FileNotFoundError(f"{part.path} is gone with lines that weren't read; set failOnDataLoss to false to go on without them")
        return None

    def read(self, part: Part) -> Iterator[tuple]:
        if (path := self._find(part)) is None:
            return
        with open(path, "rb") as file:
            file.seek(part.low if part.first else part.low - 1)
            if not part.first:
                file.readline()  # the rest of a line that began in the part before
            while (at := file.tell()) < part.high and (line := file.readline()).endswith(b"\n"):
                yield part.path, at, line[:-1].removesuffix(b"\r").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        """Nothing is kept for offsets gone by."""


class Tail(DataSource):
    """spark.readStream.format("line_tail").load("/logs/*.jsonl*"): path, position (of the line's first byte) and line.

    Lines come once they end: what is written of the last one waits. Files may grow, be renamed (if the pattern takes the new name too,
    what was left of them is read under it), be replaced, be cut and written anew; one that is cut and has grown beyond its old length
    between two batches can't be told from one that grew. Bytes that aren't UTF-8 become replacement characters; empty lines are lines.
    Options: startAt (beginning or end), partBytes (a file's new bytes are read in tasks of so many), failOnDataLoss. Files must be where
    all executors see them; an offset holds a name and a number for each file of the pattern.
    """

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})


def tailed(spark: SparkSession, pattern: str, start_at: str = "beginning", **options) -> DataFrame:
    """A stream of the whole lines of growing files; see Tail."""
    if start_at not in ("beginning", "end"):
        raise ValueError(f"start_at must be beginning or end, not {start_at}")
    spark.dataSource.register(Tail)
    return spark.readStream.format("line_tail").options(startAt=start_at, **options).load(pattern)
