"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing to target weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstream.llm import minhash, mixing, packing, quality, secrets
from leafstream.llm.common import Shelf, token_count


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that a host repeats go from the others."""
    return quality.clean(docs, length="n_chars", keep_first=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; of rows repeated with an id and its text, one."""
    gone = minhash.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    # ids that several rows have are few as a rule: only their rows are grouped by text
    several = docs.groupBy(F.col("doc_id").alias("__several")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1 AND __several IS NOT NULL").select("__several")
    once = kept.join(several, F.col("doc_id") == F.col("__several"), "left_anti")
    again = kept.join(several, F.col("doc_id") == F.col("__several"), "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = again.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("__others")).select("doc_id", "text", "__others.*") if others else again.distinct()
    return once.unionByName(one)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret gives way to a mark."""
    return secrets.redact(docs, length="n_chars")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weight of its source asks for, at least once."""
    return mixing.mix(docs, tokens=token_count(F.col("text"))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every part of every document in the training sequences.

    A stage gets the columns of documents only, so the mix's order reaches the sequences by what it
    follows from: copy n of a document belongs to epoch n, and mixing.position() tells its place there.
    """
    return packing.pack(docs, tokens=token_count(F.col("text")), key=mixing.key_of(F.col("doc_id"), F.col("text")), place=mixing.position)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing_sources", mixing_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Sketches, tokens and packing aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's documents are written to the shared folder for the next and deleted behind it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Shelf(spark) as shelf:
        for _, stage in STAGES:
            docs, last = shelf.put(stage(spark, docs, sf_dir)), docs
            shelf.drop(last)
        return shelf.keep(docs)
