"""The log tail: batch slices, and a stream over files that grow, are cut and rotate."""

import os
import random

import pytest

from quillspark.sources import tail


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(tail.LogTail)
    return spark


def put(path, data, mode="ab"):
    with open(path, mode) as f:
        f.write(data)


def read(spark, path, **options):
    rows = spark.read.format("logtail").options(path=str(path), **options).load().collect()
    return sorted((os.path.basename(r.file), r["at"], r.line, r.reset, r.truncated) for r in rows)


def test_slices(source, tmp_path):
    log = tmp_path / "a.log"
    put(log, b"one\ntwo\nthree\nfour")
    assert [r[2] for r in read(source, log)] == ["one", "two", "three", "four"]
    assert read(source, log, cursor=4) == [("a.log", 4, "two", False, False), ("a.log", 8, "three", False, False), ("a.log", 14, "four", False, False)]
    assert [r[1:3] for r in read(source, log, cursor=5)] == [(8, "three"), (14, "four")]  # the rest of a line is dropped
    assert read(source, log, cursor=99) == [("a.log", 0, "one", True, False), ("a.log", 4, "two", True, False), ("a.log", 8, "three", True, False), ("a.log", 14, "four", True, False)]
    assert read(source, log, cursor=0, maxBytes=6) == [("a.log", 14, "four", True, True)]
    assert read(source, log, maxBytes=5) == [("a.log", 14, "four", False, True)]
    assert read(source, log, cursor=18) == [] == read(source, tmp_path / "none.log")
    put(tmp_path / "b.log", b"")
    put(tmp_path / "c.txt", b"no\n")
    assert {r[0] for r in read(source, tmp_path)} == {"a.log"}
    put(tmp_path / "b.log", b"\xff\xfe\n\n\x85\r\n")
    assert [r[2] for r in read(source, tmp_path / "b.log")] == ["��", "", "�\r"]


def test_splits_read_each_line_once(source, tmp_path, monkeypatch):
    r = random.Random(4)
    lines = ["x" * r.choice([0, 1, 5, 40, 200]) for _ in range(400)]
    path = tmp_path / "s.log"
    put(path, "\n".join(lines).encode() + b"\n")
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(tail, "SPLIT", size)
        parts = tail.TailSlice({"path": str(path)}).partitions()
        assert len(parts) == -(-os.path.getsize(path) // size)
        assert [x[2] for p in parts for x in tail.lines_of(p)] == lines


class Stream:
    """Runs a stream of a folder once for each call, on one checkpoint."""

    def __init__(self, spark, folder, path, **options):
        self.spark, self.folder, self.out, self.state, self.options = spark, folder, f"{path}/out", f"{path}/state", options

    def __call__(self):
        df = self.spark.readStream.format("logtail").options(path=str(self.folder), **self.options).load()
        df.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.state).trigger(availableNow=True).start().awaitTermination()
        rows = self.spark.read.schema(tail.SCHEMA).parquet(self.out).collect()
        new = sorted((os.path.basename(r.file), r["at"], r.line, r.reset) for r in rows)
        fresh = list(new)
        for x in getattr(self, "seen", []):
            fresh.remove(x)
        self.seen = new
        return fresh


def test_stream(source, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    run = Stream(source, folder, tmp_path)
    log = folder / "a.log"
    put(log, b"one\ntwo\nthr")
    assert run() == [("a.log", 0, "one", False), ("a.log", 4, "two", False)]
    put(log, b"ee\nfour\n")
    put(folder / "b.log", b"other\n")
    assert run() == [("a.log", 8, "three", False), ("a.log", 14, "four", False), ("b.log", 0, "other", False)]
    assert run() == []
    put(log, b"cut\n", "wb")  # truncated
    assert run() == [("a.log", 0, "cut", True)]
    put(log, b"anew, and longer than it was\n", "wb")  # truncated and past its old size again
    assert run() == [("a.log", 0, "anew, and longer than it was", True)]
    put(log, b"before\n")
    os.rename(log, folder / "a.log.1")  # rotated: the rest of the old file, then the new one
    put(log, b"after\n")
    assert run() == [("a.log", 0, "after", True), ("a.log.1", 29, "before", False)]
    os.rename(log, folder / "a2.log")  # rotated to a name that is tailed too
    put(folder / "a2.log", b"late\n")
    put(log, b"next\n")
    assert run() == [("a.log", 0, "next", True), ("a2.log", 6, "late", False)]
    os.remove(log)
    assert run() == []


def test_stream_from_the_end_and_bounded(source, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    put(folder / "a.log", b"old\n")
    run = Stream(source, folder, tmp_path, startingPosition="end", maxBytes=8)
    run()
    put(folder / "a.log", b"first\nsecond\nthird\n")
    assert [x[2] for x in run()] == ["third"]
