"""A data source ``printstream``: structured fields of files, framed in byte-range splits.

What follows a byte depends on later bytes only, and no field is longer than LONGEST.  So of the places
that the walk from the file's beginning attends to, one lies in any stretch of that length (or is the
first 5A behind it).  A split walks from every 5A of such a stretch before its start; chains meet soon, and
where all have met is where the sequential walk goes on.  If they haven't, it begins further back, at
the file's beginning at last.  So every split finds its own start, in its task, exactly; the driver lists
names and sizes only.  Files are read through pyarrow's file systems (local paths and the stores it knows).

    spark.dataSource.register(PrintStream)
    spark.read.format("printstream").option("splitBytes", 64 << 20).load("/folder/*.bin")

    spark.readStream.format("printstream").load("/folder/*.bin")      # new fields of files that grow

The rows have no sf_no: a number in file order would need the splits before (operators/scans.py gives it); offset orders the fields.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from .framing import HEADER, LONGEST, MAGIC, SCHEMA, SHORTEST, batch, chain

SPLIT = 64 << 20
#: More splits than this lie behind each other in a task, up to SPLIT bytes: a task costs more than a short split.
TASKS = 256
COLUMNS = ", ".join(c for c in SCHEMA.split(", ") if not c.startswith("sf_no"))


class Window:
    """A stretch of a file that grows at its front; places are those of the file."""

    def __init__(self, read, size: int, start: int, end: int):
        self.read, self.size, self.low, self.high = read, size, start, min(end, size)
        self.data = read(start, self.high - start)

    def back_to(self, low: int) -> None:
        self.data, self.low = self.read(low, self.low - low) + self.data, low

    def find(self, start: int) -> int:
        """The first 5A at or behind start, or -1."""
        at = self.data.find(b"\x5a", start - self.low)
        return at + self.low if at >= 0 else -1

    def following(self, at: int) -> int:
        """The 5A that the walk attends to behind the one at at, or -1."""
        i = at - self.low
        if at + HEADER > self.size or i + HEADER > len(self.data):
            return -1
        length = self.data[i + 1] << 8 | self.data[i + 2]
        if not SHORTEST <= length <= LONGEST:
            return self.find(at + 1)
        behind = at + 1 + length
        if behind - self.low < len(self.data) and self.data[behind - self.low] == MAGIC:
            return behind
        return self.find(behind)


def first_due(window: Window, start: int) -> int:
    """The place at or behind start that the walk from the file's beginning attends to first, or -1."""
    back = 4 * LONGEST
    while True:
        low = max(0, start - back)
        if low < window.low:
            window.back_to(low)
        if low == 0:
            todo = [window.find(0)]
        else:
            todo, at = [], window.find(low)
            while at >= 0:
                todo.append(at)
                if at > low + LONGEST:
                    break
                at = window.find(at + 1)
        seen, ends = set(), set()
        for at in todo:
            while 0 <= at < start and at not in seen:
                seen.add(at)
                at = window.following(at)
            if at not in seen:
                ends.add(at)
        if len(ends) == 1:
            return ends.pop()
        if not ends or low == 0:
            return -1
        back *= 4


class Split(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


def _system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if re.match(r"[a-z0-9]+:/", path):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), os.path.abspath(path)


def _listed(pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a path with wildcards in its last part, or a folder, names."""
    system, path = _system(pattern)
    prefix = pattern[: len(pattern) - len(path)] if pattern.endswith(path) else ""
    if any(c in os.path.basename(path) for c in "*?["):
        found = system.get_file_info(pyarrow.fs.FileSelector(os.path.dirname(path)))
        found = [f for f in found if fnmatch.fnmatch(f.base_name, os.path.basename(path))]
    else:
        found = [system.get_file_info(path)]
        if found[0].type == pyarrow.fs.FileType.Directory:
            found = system.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
    return [(prefix + f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.type == pyarrow.fs.FileType.File]


class PrintStreamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.split = options.get("path", ""), int(options.get("splitBytes", SPLIT))
        self.payload = options.get("payload", "true").lower() != "false"
        self.types: set[str] | None = None

    def partitions(self) -> list[Split]:
        found = [f for pattern in self.paths.split(",") for f in _listed(pattern)]
        splits = sum(-(-size // self.split) for _, size in found)
        taken = self.split * max(1, min(-(-splits // TASKS), SPLIT // self.split))
        return [Split(path, size, at, min(at + taken, size)) for path, size in found for at in range(0, size, taken)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        system, path = _system(partition.path)
        with system.open_input_file(path) as f:
            window = Window(lambda at, n: f.read_at(n, at), partition.size, partition.start, partition.end + LONGEST + HEADER + 1)
            due = first_due(window, partition.start) if partition.start else 0
        if due < 0 or due >= partition.end:
            return
        # a type that isn't six hex digits is no field's
        wanted = None if self.types is None else {bytes.fromhex(t) for t in self.types if isinstance(t, str) and re.fullmatch("[0-9A-F]{6}", t)}
        low, content = window.low, window.data
        for places in chain(content, due - low, partition.end - low, 4096):
            if wanted is not None:
                places = [at for at in places if content[at + 3 : at + 6] in wanted]
            if places:
                rows = batch(partition.path, 0, content, places, self.payload, low)
                yield rows.select([n.split()[0] for n in COLUMNS.split(", ")])


class FilteringReader(PrintStreamReader):
    """Filters types while framing; for sessions that let Python sources take filters."""

    def pushFilters(self, filters):
        """Types are filtered while framing; everything is also left to Spark."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("type_id",) else set(f.value) if isinstance(f, In) and f.attribute == ("type_id",) else None
            if wanted is not None:
                self.types = wanted if self.types is None else self.types & wanted
            yield f


class PrintStreamTail(DataSourceStreamReader):
    """New fields of growing files: a field belongs to the batch in which its last byte is there.

    An offset is the size of every file.  A task reads its range and, for the chain, what a field can reach back; where the chain
    stands it finds as splits do.  A field that a file's end cuts waits for the rest of it.
    """

    def __init__(self, options: dict):
        self.paths, self.split = options.get("path", ""), int(options.get("splitBytes", SPLIT))
        self.payload = options.get("payload", "true").lower() != "false"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: size for pattern in self.paths.split(",") for path, size in _listed(pattern)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return [Split(path, size, at, min(at + self.split, size)) for path, size in sorted(end.items()) for at in range(start.get(path, 0), size, self.split)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        system, path = _system(partition.path)
        low = max(0, partition.start - LONGEST - HEADER)
        with system.open_input_file(path) as f:
            window = Window(lambda at, n: f.read_at(n, at), partition.end, low, partition.end)
            due = first_due(window, low) if low else 0
        if due < 0:
            return
        content, base = window.data, window.low
        for places in chain(content, due - base, most=4096):
            ends = [base + at + 1 + (content[at + 1] << 8 | content[at + 2]) for at in places]
            whole = [at for at, behind in zip(places, ends, strict=True) if partition.start < behind <= partition.end]
            if whole:
                yield batch(partition.path, 0, content, whole, self.payload, base).select([n.split()[0] for n in COLUMNS.split(", ")])


class PrintStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "printstream"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> PrintStreamReader:
        """Option pushdown: needs spark.sql.python.filterPushdown.enabled."""
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return (FilteringReader if pushing else PrintStreamReader)(self.options)

    def streamReader(self, schema) -> PrintStreamTail:
        return PrintStreamTail(self.options)
