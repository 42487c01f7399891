"""File diagnostics: one message per finding, from a few aggregates over the fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.type_dim import KNOWN
from .resources import definitions, references

COLUMNS = ["file_id", "seq", "severity", "category", "message", "offset"]


def field_counts(sf: DataFrame) -> DataFrame:
    """file_id, type_id, n."""
    return sf.groupBy("file_id", "type_id").agg(F.count(F.lit(1)).alias("n"))


def summary(sf: DataFrame) -> DataFrame:
    """One row a file: the counts that the messages tell."""
    t = F.col("type_id")
    return sf.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("fields"), F.count_distinct(t).alias("types"), F.max(F.col("offset") + 1 + F.col("length")).alias("size"), F.min("offset").alias("first_offset"),
        F.count_if(t == "D3A8AD").alias("bpg"), F.count_if(t == "D3A8AF").alias("brs"), F.count_if(t == "D3A090").alias("tags"), F.count_if(t == "D3EE9B").alias("ptx"),
        F.count_if(t == "D3A8A8").alias("bdt"), F.count_if(t == "D3A9A8").alias("edt"), F.count_if(~t.isin(KNOWN)).alias("unknown"),
    )


def resources_by_name(sf: DataFrame) -> DataFrame:
    """file_id, d and r (distinct names defined and referenced), missing (name, last place) and unused (names): one pass."""
    both = definitions(sf).select("file_id", "name", F.lit(None).cast("long").alias("at")).unionByName(references(sf).select("file_id", "name", F.col("offset").alias("at")))
    names = both.groupBy("file_id", "name").agg(F.count_if(F.col("at").isNull()).alias("defs"), F.max("at").alias("at"))
    lacking = F.array_sort(F.collect_list(F.when(F.col("defs") == 0, F.struct("name", "at"))))
    idle = F.array_sort(F.collect_list(F.when(F.col("at").isNull(), F.col("name"))))
    return names.groupBy("file_id").agg(F.count_if(F.col("defs") > 0).alias("d"), F.count("at").alias("r"), lacking.alias("missing"), idle.alias("unused"))


def messages(sf: DataFrame, corrupt: DataFrame | None = None) -> DataFrame:
    """file_id, seq, severity, category, message, offset; corrupt: corrupt_fields() of the same files.

    One row of counts a file (and one of its resource names) says everything; it is exploded into messages.
    """
    s = summary(sf).join(resources_by_name(sf), "file_id", "left")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    c = F.col

    def say(when: Column, seq: int, severity: str | Column, category: str, message: Column, offset: Column | None = None) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(when, F.struct(F.lit(seq).alias("seq"), level.alias("severity"), F.lit(category).alias("category"), message.alias("message"), (F.lit(None) if offset is None else offset).cast("long").alias("offset")))

    always, good = F.lit(True), c("first_offset") == 0
    one = [
        say(always, 1, "info", "File", text("File size: ", c("size"), " bytes")),
        say(always, 2, "info", "Structure", text(c("fields"), " structured fields, ", c("types"), " types")),
        say(always, 3, F.when(good, "success").otherwise("error"), "Structure", F.when(good, "File starts with a structured field").otherwise("File does not start with a structured field")),
        say(c("bdt") == 0, 4, "warning", "Structure", F.lit("No begin-document field")),
        say(c("edt") == 0, 5, "warning", "Structure", F.lit("No end-document field")),
        say(F.greatest("bpg", "brs") > 0, 6, "info", "Pages", text(F.greatest("bpg", "brs"), " pages")),
        say((c("bpg") > 0) & (c("brs") > c("bpg")), 7, "info", "Pages", text("Composite pages: ", F.floor(F.try_divide(c("brs"), c("bpg")) + 0.5), " resources a page")),
        say(c("tags") > 0, 8, "info", "Metadata", text(c("tags"), " tags")),
        say(c("d").isNotNull(), 9, "info", "Resources", text(c("d"), " defined, ", c("r"), " referenced")),
        say(c("unknown") > 0, 13, "warning", "Structure", text(c("unknown"), " fields of unknown type")),
        say(c("ptx") > 0, 14, "info", "Text", text(c("ptx"), " text fields")),
    ]
    if corrupt is not None:
        s = s.join(corrupt.groupBy("file_id").agg(F.count(F.lit(1)).alias("bad")), "file_id", "left")
        bad = F.coalesce("bad", F.lit(0))
        one.append(say(always, 12, F.when(bad > 0, "error").otherwise("success"), "Structure", F.when(bad > 0, text(bad, " corrupt fields")).otherwise("No corrupt fields")))
    none = lambda a: F.coalesce(a, F.array())
    lost = F.transform(none(c("missing")), lambda x: say(always, 10, "error", "Resources", text("Missing resource: ", x["name"]), x["at"]))
    idle = F.transform(none(c("unused")), lambda x: say(always, 11, "warning", "Resources", text("Unused resource: ", x)))
    return s.select("file_id", F.explode(F.array_compact(F.concat(F.array(*one), lost, idle))).alias("m")).select("file_id", "m.*")


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
