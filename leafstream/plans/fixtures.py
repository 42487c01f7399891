"""Inputs of the engine's own queries, made from the driver's tables.

E: ``events`` as a log of marks by user; D: ``documents`` packed into print files, one a source and
range of doc_id (a file is bounded whatever the table's size); L: ``lineitem`` as records of a byte log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pages, ptoca, tags
from ..operators.asof import interval_join
from ..sources import framing, wire
from ..sources.tables import reused

FILE_DOCS = 20_000
#: Rows of a table whose rows become files, and of a table of records, that a task gets.
TASK_FILES, TASK_RECORDS = 20_000, 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shares(spark: SparkSession, sf_dir: str, name: str, rows: int) -> int:
    """Into how many partitions a table is dealt: the session's number, or more, so that a task's share doesn't grow with the table.

    Files of few bytes can have many rows (their number is read from their footers), and dealt rows can take far more memory than
    the bytes by which adaptive execution puts partitions together.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, name).count() // rows))


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table dealt out by key: a file of few bytes is read in one task, however many rows it has, and each row becomes a print file."""
    return table(spark, sf_dir, name).repartition(shares(spark, sf_dir, name, TASK_FILES), key)


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: view begins a page, purchase ends it, signup begins a document, click is a tag."""
    kind = F.when(F.col("event_type") == "view", "B").when(F.col("event_type") == "purchase", "E").when(F.col("event_type") == "signup", "D").when(F.col("event_type") == "click", "T").otherwise("X")
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", kind.alias("kind"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with file_id and page_pos."""
    docs = table(spark, sf_dir, "documents").withColumn("file_id", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.floor(F.col("doc_id") / FILE_DOCS).cast("string")))
    return docs.withColumn("page_pos", F.row_number().over(Window.partitionBy("file_id").orderBy("doc_id")).cast("long"))


def _encoded(spark: SparkSession, sf_dir: str, garbage: bool) -> DataFrame:
    docs = documents(spark, sf_dir)
    page = wire.page([("DOCID", F.col("doc_id").cast("string")), ("LANG", F.col("lang"))], F.coalesce("text", F.lit("")))
    made = docs.select("file_id", "doc_id", (F.concat(page, F.unhex(F.lit("000D25"))) if garbage else page).alias("page"))
    name = F.upper(F.substring_index(F.col("file_id"), "/", 1))
    return wire.file_content(made, ["file_id"], ["doc_id"], "page", name)


def print_files(spark: SparkSession, sf_dir: str, garbage: bool = False) -> DataFrame:
    """D: file_id, content; garbage puts three bytes between records that belong to none.  Encoded once, then read."""
    return reused(spark, "garbage" if garbage else "files", f"{sf_dir}/documents.parquet", lambda: _encoded(spark, sf_dir, garbage))


def fields(spark: SparkSession, sf_dir: str, garbage: bool = False) -> DataFrame:
    """The files' fields, framed once, then read: a query that needs no payloads doesn't read them."""
    return reused(spark, "garbage-fields" if garbage else "fields", f"{sf_dir}/documents.parquet", lambda: framing.frames(print_files(spark, sf_dir, garbage)))


def print_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(fields, their page index)."""
    sf = fields(spark, sf_dir)
    return sf, reused(spark, "pages", f"{sf_dir}/documents.parquet", lambda: pages.page_index(sf))


def page_texts(sf: DataFrame, index: DataFrame) -> DataFrame:
    """file_id, page_pos, text (empty where a page has none)."""
    return ptoca.page_texts(sf, index)


def page_tags(sf: DataFrame, index: DataFrame) -> DataFrame:
    """file_id, page_pos, seq, key, value."""
    return interval_join(tags.tags(sf), index, ["file_id"], "offset", "byte_offset", "byte_length", ["page_pos"]).withColumnRenamed("offset", "seq")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: file (supplier), offset, length, line key; an order's lines at a supplier lie behind each other."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") + 9).cast("long").alias("length"))
    lines = lines.repartition(shares(spark, sf_dir, "lineitem", TASK_RECORDS), "file")  # what follows by file goes on with it
    by = Window.partitionBy("file").orderBy("l_orderkey", "l_linenumber", "l_partkey").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("offset", F.sum("length").over(by) - F.col("length"))
