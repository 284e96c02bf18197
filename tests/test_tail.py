"""Growing files as a stream: half lines, rotation, truncation, restarts from a checkpoint."""

import random

import pytest

from sessionloom.sources import tail


class Follower:
    """Each call of new() runs a query of its own that goes on from the checkpoint and gives the lines that it added."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.seen = spark, folder, options, []

    def new(self):
        stream = tail.tailed(self.spark, str(self.folder / "log*"), **self.options)
        query = stream.writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "cp")).trigger(once=True).start()
        assert query.awaitTermination(120)
        rows = [r.line for r in self.spark.read.schema(tail.SCHEMA).parquet(str(self.folder / "out")).orderBy("path", "position").collect()]
        fresh = list(rows)
        for line in self.seen:
            fresh.remove(line)
        self.seen = rows
        return fresh


def put(path, text, mode="ab"):
    with open(path, mode) as f:
        f.write(text)


def test_half_lines_wait_and_restarts_lose_nothing(spark, tmp_path):
    follow, log = Follower(spark, tmp_path), tmp_path / "log"
    put(log, b"a\nb\r\nhal")
    assert follow.new() == ["a", "b"]
    put(log, b"f\n\n\xff\n")
    assert follow.new() == ["half", "", "�"]


def test_rotation_reads_the_rest_and_the_new_file(spark, tmp_path):
    follow, log = Follower(spark, tmp_path), tmp_path / "log"
    put(log, b"1\n2\n")
    assert follow.new() == ["1", "2"]
    put(log, b"3\n")
    log.rename(tmp_path / "log.1")
    put(log, b"4\n")
    assert sorted(follow.new()) == ["3", "4"]
    put(log, b"5\n")
    assert follow.new() == ["5"]


def test_truncation_begins_anew(spark, tmp_path):
    follow, log = Follower(spark, tmp_path), tmp_path / "log"
    put(log, b"old 1\nold 2\n")
    assert follow.new() == ["old 1", "old 2"]
    put(log, b"x\n", "wb")
    assert follow.new() == ["x"]


def test_parts_of_a_file_have_each_line_once(tmp_path):
    rng = random.Random(4)
    lines = ["".join(rng.choice("ab é") for _ in range(rng.randrange(12))) for _ in range(300)]
    put(tmp_path / "log", "".join(f"{x}\n" for x in lines).encode() + b"open")
    for size in (1, 3, 7, 64, 10_000):
        reader = tail.TailReader({"path": str(tmp_path / "log"), "partbytes": str(size)})
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        got = sorted((at, line) for p in parts for _, at, line in reader.read(p))
        assert [line for _, line in got] == lines


def test_the_end_of_a_long_open_line_is_found_from_behind(tmp_path):
    put(tmp_path / "log", b"a\n" + b"x" * (3 * tail.STEP))
    assert tail._whole_lines(str(tmp_path / "log"), 2 + 3 * tail.STEP) == 2
    put(tmp_path / "none", b"x" * (2 * tail.STEP))
    assert tail._whole_lines(str(tmp_path / "none"), 2 * tail.STEP) == 0


def test_start_at_the_end_and_files_gone(tmp_path):
    log = tmp_path / "log"
    put(log, b"before\n")
    reader = tail.TailReader({"path": str(log), "startat": "end"})
    start = reader.initialOffset()
    put(log, b"after\n")
    parts = reader.partitions(start, reader.latestOffset())
    assert [r[2] for p in parts for r in reader.read(p)] == ["after"]
    log.unlink()
    with pytest.raises(FileNotFoundError):
        list(reader.read(parts[0]))
    calm = tail.TailReader({"path": str(log), "failondataloss": "false"})
    assert list(calm.read(parts[0])) == [] and calm.latestOffset() == {"files": {}}
