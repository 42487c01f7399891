"""File sources: print files as rows of binary content, with the checks that an upload gets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import estimated_pages, safe_name

LARGEST = 2**31
EXTENSIONS = "*.{afp,afp2,AFP,AFP2}"
_NAME = re.compile(r"[\w.\-]+")


def _raw(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def print_files(spark: SparkSession, path: str, pattern: str = EXTENSIONS, skip_oversized: bool = False) -> DataFrame:
    """file_id (the path: names can repeat in subfolders), name, size, content of the files of a folder.

    A file of 2 GB or more, which no row can hold, is an error when its content is read; with skip_oversized such files
    are left out here and told by oversized().  Large files are read in splits by the ``printstream`` source.
    """
    raw = _raw(spark, path, pattern)
    raw = raw.where(F.col("length") < LARGEST) if skip_oversized else raw
    return raw.select(F.col("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")


def oversized(spark: SparkSession, path: str, pattern: str = EXTENSIONS) -> DataFrame:
    """name and reason of the files that are too large for a row; contents aren't read."""
    large = _raw(spark, path, pattern).where(F.col("length") >= LARGEST)
    return large.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("too large").alias("reason"))


def listing(spark: SparkSession, path: str, pattern: str = EXTENSIONS) -> DataFrame:
    """name and size of all files, however large; contents aren't read."""
    return print_files(spark, path, pattern).where(~F.col("name").startswith(".")).select("name", "size")


def named(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One file of a folder, by a name without any path."""
    if not _NAME.fullmatch(name) or name in (".", ".."):
        raise ValueError(f"not a file name: {name}")
    return print_files(spark, path, name)


def accepted(files: DataFrame) -> DataFrame:
    """What an upload keeps: files that aren't empty and start with a field; with upload_id, safe names and estimated pages."""
    good = files.where((F.length("content") > 0) & (F.substring("content", 1, 1) == F.lit(b"\x5a")))
    return good.withColumns({"upload_id": F.expr("uuid()"), "safe_name": safe_name(F.col("name")), "estimated_pages": estimated_pages(F.length("content"), 2048)})


def rejected(files: DataFrame) -> DataFrame:
    """name and reason of the files that accepted() leaves out; for those too large to be rows see oversized()."""
    reason = F.when(F.length("content") == 0, "empty").when(F.substring("content", 1, 1) != F.lit(b"\x5a"), "not a print file")
    return files.select("name", reason.alias("reason")).where("reason IS NOT NULL")
