"""Framing: bytes to structured fields.

A field is 5A, a 2-byte length (6 to 32766, counting from itself), a 3-byte type, a flag byte, a
2-byte sequence number and data.  Where no valid field starts, the next 5A is looked for.  A field
that the buffer cuts is kept and marked truncated.  The chain has no memory: what follows a byte
depends on later bytes only, so a file can be framed in splits (see datasource.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAGIC, SHORTEST, LONGEST, HEADER = 0x5A, 6, 32766, 9

SCHEMA = "file_id string, sf_no bigint, offset bigint, length int, type_id string, flags int, seq int, data binary, truncated boolean"
CORRUPT = "file_id string, offset bigint"


def chain(content: bytes, start: int = 0, end: int | None = None, most: int = 1 << 16) -> Iterator[list[int]]:
    """The places of the fields that start at or behind start and before end, in lists of at most so many.

    Only this chain is a loop: each length tells where the next field is.  What is in the headers is gathered from the places.
    """
    size = len(content)
    find, last = content.find, min(size if end is None else end, size - HEADER + 1)
    at, places = find(b"\x5a", start), []
    while 0 <= at < last:
        length = content[at + 1] << 8 | content[at + 2]
        if SHORTEST <= length <= LONGEST:
            places.append(at)
            if len(places) == most:
                yield places
                places = []
            at += 1 + length
            if at >= size or content[at] != MAGIC:
                at = find(b"\x5a", at)
        else:
            at = find(b"\x5a", at + 1)
    if places:
        yield places


def walk(content: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, bool]]:
    """(offset, length, truncated) of the fields that start at or behind start and before end."""
    for places in chain(content, start, end):
        for at in places:
            length = content[at + 1] << 8 | content[at + 2]
            yield at, length, at + 1 + length > len(content)


def corrupt_offsets(content: bytes) -> Iterator[int]:
    """Places of a 5A at which a field is due or looked for but no valid length follows."""
    at, size = content.find(b"\x5a"), len(content)
    while 0 <= at and at + HEADER <= size:
        length = content[at + 1] << 8 | content[at + 2]
        if SHORTEST <= length <= LONGEST:
            at = content.find(b"\x5a", at + 1 + length)
        else:
            yield at
            at = content.find(b"\x5a", at + 1)


#: The two hex digits of every byte.
_HEX = np.frombuffer(bytes(range(256)).hex().upper().encode(), np.uint8).reshape(256, 2)


def batch(file_id: str, first_no: int, content: bytes, places: list[int], with_data: bool = True, base: int = 0) -> pa.RecordBatch:
    """The fields at these places of content, which begins at base of the file, as rows."""
    n, at = len(places), np.array(places, np.int64)
    return _rows(pa.repeat(pa.scalar(file_id, pa.string()), n), np.arange(first_no, first_no + n), content, at, at + base, len(content), with_data)


def _rows(ids: pa.Array, numbers: np.ndarray, content: bytes, at: np.ndarray, offset: np.ndarray, size: int | np.ndarray, with_data: bool) -> pa.RecordBatch:
    """The fields at these places of content as rows; size: where the file of each ends in content."""
    raw, n = np.frombuffer(content, np.uint8), len(at)
    length = raw[at + 1].astype(np.int32) << 8 | raw[at + 2]
    kinds = _HEX[raw[at[:, None] + np.arange(3, 6)]].tobytes()
    type_id = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, 6 * n + 1, 6, dtype=np.int32)), pa.py_buffer(kinds))
    behind = at + 1 + length
    if with_data:
        ends = np.minimum(behind, size)
        offsets = np.zeros(n + 1, np.int32)
        np.cumsum(np.maximum(ends - at - HEADER, 0), out=offsets[1:])
        view = memoryview(content)
        data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join([view[a + HEADER : e] for a, e in zip(at.tolist(), ends.tolist(), strict=True)]))])
    else:
        data = pa.nulls(n, pa.binary())
    arrays = [
        ids, pa.array(numbers), pa.array(offset), pa.array(length), type_id,
        pa.array(raw[at + 6].astype(np.int32)), pa.array(raw[at + 7].astype(np.int32) << 8 | raw[at + 8]), data, pa.array(behind > size),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SCHEMA.split(", ")])


#: Files of up to so many bytes share batches; a batch holds at most so many bytes of them, and a file more.
SMALL, SHARED = 1 << 16, 1 << 22


def _shared(names: pa.Array, held: list[tuple[int, bytes, list[int]]], with_data: bool) -> pa.RecordBatch:
    """The fields of several files, each (row of names, content, places), as one batch."""
    counts = np.array([len(places) for _, _, places in held])
    ends = np.cumsum([len(data) for _, data, _ in held])
    starts = np.repeat(ends - [len(data) for _, data, _ in held], counts)
    offset = np.array([at for _, _, places in held for at in places], np.int64)
    ids = names.take(pa.array(np.repeat([i for i, _, _ in held], counts))).cast(pa.string())
    numbers = np.arange(len(offset)) - np.repeat(np.cumsum(counts) - counts, counts)
    return _rows(ids, numbers, b"".join([data for _, data, _ in held]), starts + offset, offset, np.repeat(ends, counts), with_data)


def frames(files: DataFrame, file_id: str = "file_id", content: str = "content", with_data: bool = True, batch_rows: int = 4096) -> DataFrame:
    """A row per structured field of each file; with_data=False leaves the payloads out (index scans).

    Small files share batches: a batch a file would cost more than its fields.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            names, held, rows, size = given.column(0), [], 0, 0
            for i, raw in enumerate(given.column(1)):
                data, done = raw.as_py() or b"", 0
                small = len(data) <= SMALL
                if held and (not small or rows >= batch_rows or size >= SHARED):
                    yield _shared(names, held, with_data)
                    held, rows, size = [], 0, 0
                for places in chain(data, most=SMALL if small else batch_rows):
                    if small:  # all its places: a field has at least 7 bytes
                        held.append((i, data, places))
                        rows, size = rows + len(places), size + len(data)
                    else:
                        yield batch(names[i].as_py(), done, data, places, with_data)
                        done += len(places)
            if held:
                yield _shared(names, held, with_data)

    return files.select(file_id, content).mapInArrow(run, SCHEMA)


def corrupt_fields(files: DataFrame, file_id: str = "file_id", content: str = "content") -> DataFrame:
    """file_id and offset of every 5A that doesn't start a valid field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, of, found = batch.column(0).cast(pa.string()), [], []
            for i, raw in enumerate(batch.column(1)):
                for at in corrupt_offsets(raw.as_py() or b""):
                    of.append(i)
                    found.append(at)
                    if len(found) == 1 << 16:
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), pa.array(found, pa.int64())], names=["file_id", "offset"])
                        of, found = [], []
            if found:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), pa.array(found, pa.int64())], names=["file_id", "offset"])

    return files.select(file_id, content).mapInArrow(run, CORRUPT)
