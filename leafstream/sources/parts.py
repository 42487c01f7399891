"""Made files in the shared store, written in parts by many tasks and published at once: the data source ``binaryparts``.

A made file is a sequence of pieces (rows of name and content).  Every task writes its pieces one behind the other into one
part, and beside it an index of what stands where.  Only when all tasks are done does the driver publish the manifest that
names the parts, in the tasks' order; what no manifest names is never read.  A task that is killed or fails leaves nothing that
counts: its part isn't in any message, and the commit clears the run's folder of it; an aborted write deletes the run.

    parts.write(pieces, folder, F.col("job"), ["section", "f", "file_id"])
    parts.made_files(spark, folder)                                        # name, size, stretches
    parts.digests(spark, folder)                                           # name, size, sha256
    spark.read.format("binaryparts").load(folder)                          # name, task, seq, at, content: in order by the numbers

A write replaces what the folder had (mode overwrite); readers see the old files or the new ones, never both.  The driver handles
one message a task; no row, task or driver holds a made file.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .datasource import _system

INDEX = "name string, task int, seq bigint, part string, start bigint, n bigint"
STRETCH = "struct<part:string,start:bigint,n:bigint,at:bigint>"
#: Bytes of a made file that a row of the reader, or a step of a digest, holds.
SPLIT = 4 << 20
_MANIFEST = "manifest.json"


@dataclass
class Written(WriterCommitMessage):
    task: int
    part: str


def _published(folder: str) -> dict | None:
    system, root = _system(folder)
    path = f"{root}/{_MANIFEST}"
    if system.get_file_info(path).type != pyarrow.fs.FileType.File:
        return None
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        if not overwrite:
            raise ValueError("binaryparts replaces a folder: use mode overwrite")
        self.folder, self.run = options["path"].rstrip("/"), f"run-{uuid.uuid4().hex}"
        self.places = [schema.fieldNames().index(c) for c in ("name", "content")]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        system, root = _system(self.folder)
        part = f"{self.run}/{task:06d}-{uuid.uuid4().hex}"
        system.create_dir(f"{root}/{self.run}", recursive=True)
        names, starts, sizes, at = [], [], [], 0
        try:
            with system.open_output_stream(f"{root}/{part}.bin") as out:
                for batch in iterator:
                    for name, content in zip(*(batch.column(i) for i in self.places), strict=True):
                        name, data = name.as_py(), content.as_buffer() if content.is_valid else b""
                        out.write(data)
                        if not names or names[-1] != name:
                            names.append(name)
                            starts.append(at)
                            sizes.append(0)
                        sizes[-1] += len(data)
                        at += len(data)
            table = pa.table([names, [task] * len(names), range(len(names)), [part] * len(names), starts, sizes], schema=pa.schema([("name", pa.string()), ("task", pa.int32()), ("seq", pa.int64()), ("part", pa.string()), ("start", pa.int64()), ("n", pa.int64())]))
            with system.open_output_stream(f"{root}/{part}.parquet") as out:
                pyarrow.parquet.write_table(table, out)
        except BaseException:
            for kind in ("bin", "parquet"):
                if system.get_file_info(f"{root}/{part}.{kind}").type == pyarrow.fs.FileType.File:
                    system.delete_file(f"{root}/{part}.{kind}")
            raise
        return Written(task, part)

    def commit(self, messages: list[Written | None]) -> None:
        """Clears the run of parts that no message names, publishes the manifest, then deletes the runs before."""
        system, root = _system(self.folder)
        parts = [m.part for m in sorted((m for m in messages if m), key=lambda m: m.task)]
        before = _published(self.folder)
        system.create_dir(f"{root}/{self.run}", recursive=True)
        for left in system.get_file_info(pyarrow.fs.FileSelector(f"{root}/{self.run}")):
            if f"{self.run}/{left.base_name.rpartition('.')[0]}" not in set(parts):
                system.delete_file(left.path)
        passing = f"{root}/.{self.run}.json"
        with system.open_output_stream(passing) as out:
            out.write(json.dumps({"run": self.run, "parts": parts}).encode())
        system.move(passing, f"{root}/{_MANIFEST}")
        if before and before["run"] != self.run:
            system.delete_dir(f"{root}/{before['run']}")

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing was published; the run's parts go."""
        system, root = _system(self.folder)
        if system.get_file_info(f"{root}/{self.run}").type == pyarrow.fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.run}")


class Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PartsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.split = options["path"].rstrip("/"), int(options.get("splitBytes", SPLIT))

    def partitions(self) -> list[Part]:
        found = _published(self.folder)
        return [Part(p) for p in found["parts"]] if found else []

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are no partitions
            return
        system, root = _system(self.folder)
        with system.open_input_file(f"{root}/{partition.path}.parquet") as f:
            rows = pyarrow.parquet.read_table(f).to_pylist()
        with system.open_input_file(f"{root}/{partition.path}.bin") as f:
            for r in rows:
                for at in range(0, r["n"], self.split):
                    data = f.read_at(min(self.split, r["n"] - at), r["start"] + at)
                    columns = [pa.array([r["name"]]), pa.array([r["task"]], pa.int32()), pa.array([r["seq"]], pa.int64()), pa.array([at], pa.int64()), pa.array([data])]
                    yield pa.RecordBatch.from_arrays(columns, names=["name", "task", "seq", "at", "content"])


class BinaryParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binaryparts"

    def schema(self) -> str:
        return "name string, task int, seq bigint, at bigint, content binary"

    def reader(self, schema) -> PartsReader:
        """Rows of a made file are in order by task, seq and at."""
        return PartsReader(self.options)

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options, schema, overwrite)


def write(pieces: DataFrame, folder: str, name: Column, order: list[str], content: str = "content") -> None:
    """Publishes made files from pieces: those of a name one behind the other, by order.

    The pieces are dealt by ranges of (name, order), so a large made file is written by many tasks, each a stretch of it.
    """
    spark = pieces.sparkSession
    spark.dataSource.register(BinaryParts)
    keyed = pieces.select(name.cast("string").alias("name"), *order, F.col(content).alias("content"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed.repartitionByRange(n, "name", *order).sortWithinPartitions("name", *order).select("name", "content").write.format("binaryparts").mode("overwrite").save(folder)


def made_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, size and stretches (part, start, n, and at: their place in the made file, in order) of the published files."""
    found = _published(folder)
    if not found or not found["parts"]:
        return spark.createDataFrame([], f"name string, size bigint, stretches array<{STRETCH}>")
    rows = spark.read.schema(INDEX).parquet(*[f"{folder.rstrip('/')}/{p}.parquet" for p in found["parts"]])
    listed = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("task", "seq", "part", "start", "n"))).alias("s"), F.sum("n").alias("size"))
    placed = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{STRETCH}>").alias("s")), lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), F.concat(a["s"], F.array(F.struct(x["part"].alias("part"), x["start"].alias("start"), x["n"].alias("n"), a["at"].alias("at")))).alias("s")))
    return listed.select("name", "size", placed["s"].alias("stretches"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """name, size and sha256 (lowercase hex) of the published files, read back from the store; a task holds a few megabytes of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                seen = hashlib.sha256()
                for s in row["stretches"]:
                    with system.open_input_file(f"{root}/{s['part']}.bin") as f:
                        for at in range(0, s["n"], SPLIT):
                            seen.update(f.read_at(min(SPLIT, s["n"] - at), s["start"] + at))
                yield pa.RecordBatch.from_arrays([pa.array([row["name"]]), pa.array([row["size"]], pa.int64()), pa.array([seen.hexdigest()])], names=["name", "size", "sha256"])

    return made_files(spark, folder).mapInArrow(run, "name string, size bigint, sha256 string")
