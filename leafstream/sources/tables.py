"""Tables in the folder that executors and driver share: intermediate ones that are deleted, and stores that are reused."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lets Spark delete a query's shuffle files when the query is done: what is written needs them no longer.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Part of every store's name: a store that older code made isn't read.
VERSION = 3


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the context's; a local one only in local mode without either (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return os.path.join(tempfile.gettempdir(), "leafstream-tables")
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")


def written(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """df as read back from path.

    Tables of numbers are written plainly: compressed, they would seem small enough to broadcast when they aren't.
    """
    spark = df.sparkSession
    kinds = " ".join(f.dataType.simpleString() for f in df.schema.fields)
    how = {} if "string" in kinds or "binary" in kinds else {"compression": "uncompressed", "parquet.enable.dictionary": "false"}
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode(mode).options(**how).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """The store's file system and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    system, place = _at(spark, f"{path}/_SUCCESS")
    return system.exists(place)


def deleted(spark: SparkSession, path: str) -> None:
    system, place = _at(spark, path)
    system.delete(place, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    system, place = _at(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def moved(spark: SparkSession, path: str, target: str) -> None:
    """Renames a folder, so that it appears at once."""
    system, place = _at(spark, path)
    if not system.rename(place, _at(spark, target)[1]):
        raise OSError(f"{path} can't become {target}")


#: Lists of kept tables by the owned() that is open.
_OWNERS: list[list[str]] = []


@contextlib.contextmanager
def owned(spark: SparkSession):
    """Results that operators keep as tables inside are deleted on leaving: use what they return within.

    with owned(spark):
        near_duplicates(docs).write.parquet(...)
    """
    paths: list[str] = []
    _OWNERS.append(paths)
    try:
        yield
    finally:
        _OWNERS.remove(paths)
        for path in paths:
            deleted(spark, path)


def sweep(spark: SparkSession, hours: float = 24.0) -> int:
    """Deletes the kept tables and the states of stores in the shared folder that were written so long ago; how many.

    For results that no owned() ends: run it when no query reads them any more.
    """
    folder, gone = shared_folder(spark), 0
    before = (time.time() - 3600 * hours) * 1000
    for under, known in ((folder, r"[0-9a-f]{32}"), (f"{folder}/stores", r"v\d+"), (f"{folder}/stores/v{VERSION}", r".*-[0-9]+-[0-9a-f]{16}-[0-9a-f]{16}")):
        for name in listed(spark, under):
            path = f"{under}/{name}"
            system, place = _at(spark, path)
            if re.fullmatch(known, name) and name != f"v{VERSION}" and system.getFileStatus(place).getModificationTime() < before:
                deleted(spark, path)
                gone += 1
    return gone


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows in what is run inside: for rows of megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Shelf:
    """Tables written to the shared folder: later reads don't compute them again and survive lost executors.

    On leaving, the tables that weren't kept are deleted.  A kept one stays for the frame that reads it, until the
    owned() around ends or sweep() finds it old.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *_) -> None:
        for _, path in self.held:
            deleted(self.spark, path)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        made = written(df, path)
        self.held.append((made, path))
        return made

    def keep(self, df: DataFrame) -> DataFrame:
        """Leaves a table of this shelf to the caller, or to the owned() around."""
        if _OWNERS:
            _OWNERS[-1].extend(path for made, path in self.held if made is df)
        self.held = [h for h in self.held if h[0] is not df]
        return df

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of this shelf at once."""
        for made, path in self.held:
            if made is df:
                deleted(self.spark, path)
        self.held = [h for h in self.held if h[0] is not df]


def signature(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of the files under a path; contents aren't read."""
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    n, mixed, whole = seen.agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return f"{n}-{(mixed or 0) & (1 << 64) - 1:016x}-{int(whole or 0) & (1 << 64) - 1:016x}"


def reused(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table made from the files under source: built once, then read; built again when the files change."""
    path = f"{shared_folder(spark)}/stores/v{VERSION}/{name}-{signature(spark, source)}"
    if exists(spark, path):
        return spark.read.parquet(path)
    return written(make(), path, "overwrite")
