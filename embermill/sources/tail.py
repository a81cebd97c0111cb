"""Lines of files that grow: a stream that keeps a place for each file, by inode.

``spark.readStream.format("embermill_tail")`` gives (source_name, raw).  An offset
holds, for each file, its inode and the end of its last whole line; a line that is
not ended yet waits.  A file that is now shorter than its place was truncated and
is read from its beginning; a path with another inode was rotated, and what the
old file still held is read under its new name, if that is in the same folder.  A
file cut and grown beyond its old place between two looks cannot be told apart.

Offsets are in the stream's log, so a batch lost with its executor is read again
from the same bytes.  Ranges are cut into pieces of ``pieceBytes``; a piece reads
the lines that begin in it.  Files must be in reach of the driver and all
executors under the same path.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "embermill_tail"


def last_line_end(path: str, low: int, high: int, block: int = 1 << 16) -> int:
    """The place after the last line feed in [low, high) of a file; ``low`` if there is none."""
    with open(path, "rb") as f:
        while high > low:
            at = max(low, high - block)
            f.seek(at)
            found = f.read(high - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            high = at
    return low


@dataclass
class Piece(InputPartition):
    name: str  # of the source, also after its file got another name
    path: str
    inode: int
    low: int
    high: int
    first: bool  # no line reaches into it


class TailReader(DataSourceStreamReader):
    def __init__(self, patterns: list[str], from_start: bool, piece: int):
        self.patterns, self.from_start, self.piece = patterns, from_start, piece
        self._last: dict[str, dict] | None = None

    def _files(self) -> dict[str, os.stat_result]:
        out = {}
        for path in sorted({p for pattern in self.patterns for p in glob.glob(pattern) or [pattern]}):
            try:
                out[path] = os.stat(path)
            except FileNotFoundError:
                continue  # not there yet, or just being rotated
        return out

    def initialOffset(self) -> dict:
        begin = {p: {"inode": s.st_ino, "end": 0 if self.from_start else s.st_size} for p, s in self._files().items()}
        self._last = begin
        return begin

    def latestOffset(self) -> dict:
        last, now = self._last or {}, {}
        for path, stat in self._files().items():
            old = last.get(path)
            same = old is not None and old["inode"] == stat.st_ino and old["end"] <= stat.st_size
            low = old["end"] if same else 0
            try:
                now[path] = {"inode": stat.st_ino, "end": last_line_end(path, low, stat.st_size)}
            except FileNotFoundError:
                continue
            if same and "left" in old and now[path]["end"] == old["end"]:
                now[path] = old
            elif old is not None and old["inode"] != stat.st_ino:
                left = self._renamed(path, old["inode"])
                if left:
                    now[path]["left"] = {"path": left, "inode": old["inode"], "end": os.path.getsize(left)}
        # a path between two files keeps its place
        self._last = {**last, **now}
        return self._last

    @staticmethod
    def _renamed(path: str, inode: int) -> str | None:
        with os.scandir(os.path.dirname(path) or ".") as there:
            return next((e.path for e in there if e.is_file() and e.inode() == inode), None)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out: list[Piece] = []
        for name, to in end.items():
            at = start.get(name)
            if at and at["inode"] != to["inode"]:
                left = to.get("left")
                if not left or left["inode"] != at["inode"]:  # rotated while no stream ran
                    path = self._renamed(name, at["inode"])
                    left = path and {"path": path, "end": os.path.getsize(path)}
                if left:
                    out += self._pieces(name, left["path"], at["inode"], at["end"], left["end"])
            goes_on = at is not None and at["inode"] == to["inode"] and at["end"] <= to["end"]
            out += self._pieces(name, name, to["inode"], at["end"] if goes_on else 0, to["end"])
        return out

    def _pieces(self, name: str, path: str, inode: int, low: int, high: int) -> list[Piece]:
        return [
            Piece(name, path, inode, at, min(high, at + self.piece), at == low) for at in range(low, high, self.piece)
        ]

    def read(self, piece: Piece) -> Iterator[tuple]:
        path = piece.path
        try:
            same = os.stat(path).st_ino == piece.inode
        except FileNotFoundError:
            same = False
        if not same:  # rotated after the batch was planned
            path = self._renamed(path, piece.inode)
            if path is None:
                raise FileNotFoundError(f"{piece.path} was replaced before it was read to its end")
        with open(path, "rb") as f:
            f.seek(piece.low if piece.first else piece.low - 1)
            if not piece.first:
                f.readline()  # begins in the piece before, unless that ends with a line
            while f.tell() < piece.high:
                line = f.readline()
                if not line:
                    break
                yield piece.name, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "source_name string, raw string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(
            self.options["paths"].split("\n"),
            self.options.get("fromStart", "false") == "true",
            int(self.options.get("pieceBytes", 32 << 20)),
        )


def tail_lines(spark: SparkSession, paths: list[str], from_start: bool = False, piece_bytes: int = 32 << 20) -> DataFrame:
    """(source_name, raw) of files or globs, as they grow; from their present ends unless ``from_start``."""
    spark.dataSource.register(TailSource)
    stream = spark.readStream.format(NAME).option("paths", "\n".join(os.path.abspath(p) for p in paths))
    return stream.option("fromStart", str(from_start).lower()).option("pieceBytes", piece_bytes).load()
