"""Streaming: page indexes of growing files and postings of new pages.

A file arrives in numbered chunks of bytes, in any order.  The state of a file is what the chain still needs (the bytes of an
unfinished field, at most a field's length; the place of the next byte; the open page; the page count) and the chunks that came
before their turn, an entry each.  A chunk that is marked as the last ends the file: its cut last field and its unclosed last page come then.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..sources.framing import HEADER, LONGEST, SHORTEST

BEGIN, END = b"\xd3\xa8\xad", b"\xd3\xa9\xad"
PAGE = "file_id string, page_number bigint, byte_offset bigint, byte_length bigint"
STATE = "carry binary, base bigint, opened bigint, pages bigint, due bigint, final bigint, size bigint"


def scan_chunk(content: bytes, base: int, opened: int, pages: int, last: bool) -> tuple[list[tuple[int, int, int]], bytes, int, int, int, int]:
    """(pages found, rest, its place, place of the open page or -1, pages begun, end of the last field or 0) after the bytes from base on."""
    found, size, at = [], 0, content.find(b"\x5a")
    at = len(content) if at < 0 else at
    while at + HEADER <= len(content):
        length = content[at + 1] << 8 | content[at + 2]
        if not SHORTEST <= length <= LONGEST:
            at = content.find(b"\x5a", at + 1)
            at = len(content) if at < 0 else at
            continue
        behind = at + 1 + length
        if behind > len(content) and not last:
            break
        size = base + behind
        kind = content[at + 3 : at + 6]
        if kind == BEGIN:
            opened, pages = base + at, pages + 1
        elif kind == END and opened >= 0:
            found.append((pages, opened, base + behind - opened))
            opened = -1
        at = behind if behind >= len(content) or content[behind] == 0x5A else content.find(b"\x5a", behind)
        at = len(content) if at < 0 else at
    return found, content[at:], base + at, opened, pages, size


class PageScan(StatefulProcessor):
    """The scan of one file at a time, chunk by chunk; early chunks wait in a map."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scan = handle.getValueState("scan", STATE)
        self.early = handle.getMapState("early", "chunk_no bigint", "content binary")

    def advance(self, rows) -> Iterator[tuple[list[tuple[int, int, int]], int, int, bool]]:
        """Takes chunks in; of each whose turn has come the pages it closes, the bytes scanned so far, the last page's number and whether the file is done."""
        carry, base, opened, pages, due, final, size = self.scan.get() if self.scan.exists() else (b"", 0, -1, 0, 0, -1, 0)
        for frame in rows:
            for number, content, last in zip(frame["chunk_no"], frame["content"], frame["last"], strict=True):
                if number >= due:  # others came again
                    self.early.updateValue((int(number),), (b"" if content is None else bytes(content),))
                final = int(number) if last else final
        while self.early.containsKey((due,)):
            content = self.early.getValue((due,))[0]
            self.early.removeKey((due,))
            found, carry, base, opened, pages, end = scan_chunk(bytes(carry) + bytes(content), base, opened, pages, due == final)
            size, due = max(size, end), due + 1
            if due - 1 == final:
                found += [(pages, opened, size - opened)] if opened >= 0 else []
                carry, opened = b"", -1
            yield found, base + len(carry), pages, due - 1 == final
        self.scan.update((bytes(carry), int(base), int(opened), int(pages), int(due), int(final), int(size)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = [p for found, *_ in self.advance(rows) for p in found]
        yield pd.DataFrame({"file_id": pd.Series([key[0]] * len(out), dtype=object), "page_number": [p[0] for p in out], "byte_offset": [p[1] for p in out], "byte_length": [p[2] for p in out]}, columns=[c.split()[0] for c in PAGE.split(", ")])

    def close(self) -> None:
        pass


class PageEvents(PageScan):
    """The same scan as events: a page each, progress at every so many pages, the end of a file."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.told = handle.getValueState("told", "pages bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told, out = self.told.get()[0] if self.told.exists() else 0, []
        for found, scanned, _, done in self.advance(rows):
            for number, offset, length in found:
                told += 1
                out.append(("page", {"type": "page", "page_number": number, "byte_offset": offset, "byte_length": length}))
                if told % self.every == 0:
                    out.append(("progress", {"type": "progress", "pages": told, "bytes_scanned": offset + length}))
            if done:
                out.append(("complete", {"type": "complete", "pages": told, "file_size": scanned}))
        self.told.update((told,))
        plain = lambda values: pd.Series(values, dtype=object)
        yield pd.DataFrame({"file_id": plain([key[0]] * len(out)), "type": plain([t for t, _ in out]), "event": plain([json.dumps(e) for _, e in out])})


def _grouped(chunks: DataFrame):
    last = F.coalesce(F.col("last"), F.lit(False)) if "last" in chunks.columns else F.lit(False)
    return chunks.select("file_id", F.col("chunk_no").cast("long").alias("chunk_no"), "content", last.alias("last")).groupBy("file_id")


def page_stream(chunks: DataFrame) -> DataFrame:
    """Closed pages of chunks(file_id, chunk_no, content, and last if the end of files is told), as they appear.

    Chunks come in any order and may come again; a gap is waited for.  Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass), which keeps each waiting chunk as an entry of its own.
    """
    return _grouped(chunks).transformWithStateInPandas(PageScan(), PAGE, "append", "none")


def event_stream(chunks: DataFrame, every: int = 100, name: str = "pages") -> DataFrame:
    """file_id, type and event (JSON) of chunks as for page_stream(), as the scan goes on: page, progress at every so many pages of a file, complete.

    How many events of each type a batch has is observed under name, for Watch.
    """
    if every < 1:
        raise ValueError("progress is told at every page or more")
    events = _grouped(chunks).transformWithStateInPandas(PageEvents(every), "file_id string, type string, event string", "append", "none")
    return events.observe(name, F.count_if(F.col("type") == "page").alias("pages"), F.count_if(F.col("type") == "complete").alias("files"))


class Watch(StreamingQueryListener):
    """Tells a running scan's progress: after every batch the pages and files so far, at its end complete, or error with a message.

    spark.streams.addListener(Watch(print)); tell gets dicts as the events are.
    """

    def __init__(self, tell: Callable[[dict], None], name: str = "pages"):
        self.tell, self.name, self.pages, self.files = tell, name, 0, 0

    def onQueryStarted(self, event) -> None:
        self.pages = self.files = 0

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None and (seen["pages"] or seen["files"]):
            self.pages, self.files = self.pages + seen["pages"], self.files + seen["files"]
            self.tell({"type": "progress", "batch": event.progress.batchId, "pages": self.pages, "files": self.files})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell({"type": "error", "message": event.exception} if event.exception else {"type": "complete", "pages": self.pages, "files": self.files})


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """New print files of a folder, as file_id (the path) and content."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return raw.select(F.col("path").alias("file_id"), "content")


def index_events(index: DataFrame, every: int = 10_000) -> DataFrame:
    """JSON events: a page event each, a progress event at every so many pages, a complete event a file."""
    page = index.select("file_id", F.col("page_pos").alias("o"), F.lit(0).alias("k"), F.to_json(F.struct(F.lit("page").alias("type"), "page_number", "byte_offset", "byte_length")).alias("event"))
    step = index.where(F.col("page_pos") % every == 0).select("file_id", F.col("page_pos").alias("o"), F.lit(1).alias("k"), F.to_json(F.struct(F.lit("progress").alias("type"), F.col("page_pos").alias("pages"))).alias("event"))
    done = index.groupBy("file_id").agg(F.max("page_pos").alias("o")).select("file_id", "o", F.lit(2).alias("k"), F.to_json(F.struct(F.lit("complete").alias("type"), F.col("o").alias("pages"))).alias("event"))
    return page.unionByName(step).unionByName(done).orderBy("file_id", "o", "k").drop("o", "k")


def write_index(files: DataFrame, target: str, checkpoint: str, make: Callable[[DataFrame], DataFrame]):
    """Runs make over every new batch of files and writes its rows below target, one folder a batch (so a batch that runs again replaces its own)."""

    def put(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
