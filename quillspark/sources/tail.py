"""A data source that tails log files by byte: batch slices and a stream whose offset is a cursor for each file.

    spark.dataSource.register(tail.LogTail)
    spark.readStream.format("logtail").option("path", "/logs").load()                    # all *.log of a folder
    spark.read.format("logtail").option("path", "/logs/a.log").option("cursor", 1200).load()

Columns: file, at (the byte where a line begins), line, reset, truncated. A file's cursor is where its last whole line ends, with its
inode and its first ``HEAD`` bytes. When the file is shorter than the cursor, or begins otherwise, it was cut or rotated: what the
old file still held is read under its new name if a file with its inode stands in the folder, and the new one from byte 0, its lines marked
``reset``. ``maxBytes`` bounds what one file adds to a batch: an older part is passed over, the rest marked ``truncated``. Reading that begins
inside a line drops the rest of that line; an unfinished last line waits for its end (a batch slice gives it, as it reads once).

Files are read in splits of ``SPLIT`` bytes by the tasks; the driver only looks at names, sizes and at most ``SPLIT`` bytes for the last line's end. Paths are
local paths, so driver and executors must mount the folder alike. Bytes that aren't UTF-8 are replaced.
"""

from __future__ import annotations

import glob
import os
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, line string, reset boolean, truncated boolean"
HEAD, SPLIT = 128, 8 << 20


@dataclass
class Slice(InputPartition):
    """Lines that begin in bytes ``start`` to ``end`` of a file known by its inode; none is read past ``stop``."""

    file: str
    inode: int
    start: int
    end: int
    stop: int
    reset: bool = False
    truncated: bool = False


def _plain(path: str) -> str:
    return path.removeprefix("file://")


def _number(options: dict, name: str) -> int | None:
    value = options.get(name)
    return None if value is None else int(value)


def _files(path: str, pattern: str) -> list[str]:
    path = _plain(path)
    return sorted(glob.glob(os.path.join(glob.escape(path), pattern))) if os.path.isdir(path) else [path] if os.path.exists(path) else []


def _last_end(path: str, size: int) -> int:
    """Where the last whole line within ``size`` bytes ends; looked for ``SPLIT`` bytes at a time."""
    with open(path, "rb") as f:
        while size > 0:
            start = max(0, size - SPLIT)
            f.seek(start)
            at = f.read(size - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            size = start
    return 0


def cursor(path: str, whole: bool = True) -> dict:
    """A file as it is now: inode, size (up to its last whole line), head (its first bytes in hex)."""
    s = os.stat(path)
    size = _last_end(path, s.st_size) if whole else s.st_size
    with open(path, "rb") as f:
        return {"inode": s.st_ino, "size": size, "head": f.read(min(HEAD, size)).hex()}


def _continues(before: dict, now: dict) -> bool:
    """Whether a file is the one its cursor is of, only longer."""
    return now["size"] >= before["size"] and now["head"].startswith(before["head"])


def _split(file: str, inode: int, start: int, end: int, most: int | None, reset: bool = False) -> list[Slice]:
    truncated = most is not None and end - start > most
    start = max(start, end - most) if truncated else start
    return [Slice(file, inode, a, min(a + SPLIT, end), end, reset, truncated) for a in range(start, end, SPLIT)]


def lines_of(part: Slice):
    """(file, at, line, reset, truncated) of a slice; a file renamed since it was planned is found by its inode."""
    path = part.file
    if not os.path.exists(path) or os.stat(path).st_ino != part.inode:
        folder = os.path.dirname(path)
        path = next((x.path for x in os.scandir(folder) if x.is_file() and x.inode() == part.inode), None)
        if path is None:
            raise FileNotFoundError(f"{part.file} (inode {part.inode}) was deleted before it was read")
    with open(path, "rb") as f:
        at = part.start
        if at > 0:
            f.seek(at - 1)
            at = at - 1 + len(f.readline())  # the line that goes on here belongs to what comes before, or is cut
        while at < part.end:
            line = f.readline(part.stop - at)
            if not line:
                break
            yield part.file, at, line.removesuffix(b"\n").decode("utf-8", "replace"), part.reset, part.truncated
            at += len(line)


class TailStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("glob", "*.log")
        self.most, self.begin = _number(options, "maxBytes"), options.get("startingPosition", "begin")

    def _now(self) -> dict:
        return {f: cursor(f) for f in _files(self.path, self.pattern)}

    def initialOffset(self) -> dict:
        return {"files": self._now() if self.begin == "end" else {}}

    def latestOffset(self) -> dict:
        return {"files": self._now()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        """Depends on the two offsets alone where files only grow, so a batch that is run again reads the same bytes."""
        before, now, out = start["files"], end["files"], []
        moved = {c["inode"]: f for f, c in now.items()}
        for file, c in now.items():
            was = before.get(file)
            if was is None and (old := next((f for f, b in before.items() if b["inode"] == c["inode"] and now.get(f, {}).get("inode") != c["inode"]), None)):
                was = before[old] if _continues(before[old], c) else None  # a rotated file under its new name: its rest
                out += _split(file, c["inode"], was["size"] if was else 0, c["size"], self.most)
            elif was is None:
                out += _split(file, c["inode"], 0, c["size"], self.most)
            elif _continues(was, c):
                out += _split(file, c["inode"], was["size"], c["size"], self.most)
            else:
                if was["inode"] != c["inode"] and was["inode"] not in moved:
                    out += self._rest(file, was)
                out += _split(file, c["inode"], 0, c["size"], self.most, reset=True)
        return out

    def _rest(self, file: str, was: dict) -> list[Slice]:
        """What a rotated file held after its cursor, where it stands under a name that the pattern doesn't match."""
        for x in os.scandir(os.path.dirname(file)):
            if x.is_file() and x.inode() == was["inode"]:
                c = cursor(x.path, whole=False)
                if _continues(was, c):
                    return _split(x.path, was["inode"], was["size"], c["size"], self.most)
        return []

    def read(self, partition: Slice | None):
        return lines_of(partition) if partition else iter(())  # None: there is nothing to read

    def commit(self, end: dict) -> None:
        pass


class TailSlice(DataSourceReader):
    """One look at files: from ``cursor`` (or their beginning), at most the last ``maxBytes``. A cursor past the end starts over."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Slice]:
        most, at, out = _number(self.options, "maxBytes"), _number(self.options, "cursor"), []
        for file in _files(self.options["path"], self.options.get("glob", "*.log")):
            s = os.stat(file)
            start = 0 if at is None else max(0, at)
            again = start > s.st_size
            parts = _split(file, s.st_ino, 0 if again else start, s.st_size, most, again)
            for p in parts:
                p.reset |= at is not None and p.truncated
            out += parts
        return out

    def read(self, partition: Slice | None):
        return lines_of(partition) if partition else iter(())  # None: there is nothing to read


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TailSlice:
        return TailSlice(self.options)

    def streamReader(self, schema) -> TailStream:
        return TailStream(self.options)
