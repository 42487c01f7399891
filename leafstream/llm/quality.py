r"""Quality rules: base counts of a text, and cross-document line frequency within a host.

Lines (split at \n) are normalised (lower case, digits to 0, white space to single spaces,
trimmed) and hashed; for each host the distinct documents of a line are counted, exact copies of
a text counting as one document.  A line is above its limit when it stands in more than
``max_docs`` documents; with ``max_share`` it must also stand in more than that share of the host's
distinct documents.  Such lines are removed from every document that has them.  A document left with
less than ``min_left`` of its words is depleted and rejected, as is one that fails the base rules.

With ``keep_first`` a line above its limit stays in the first document that has it (smallest doc_id of
the host).  Where near copies are dropped only later, as in the pipeline, a text that has many near
copies would otherwise be lost with all of them.

DataFrame functions only; no Python runs on the executors.

Defined results: null text counts as empty (0 words, base_failed); a null host is a host of its
own; a null doc_id is an id like others; repeated rows get equal results and count once; lines
without a word are neither counted nor removed; texts are taken whole; an empty table gives an
empty table; further columns are kept by clean() and ignored by report(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Shelf, bind

MIN_WORDS, REPEAT_PERCENT = 50, 50
MAX_DOCS, MAX_SHARE, MIN_LEFT = 20, 0.0, 0.3
_KEY = ("__id", "__host", "__content")
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _has_word(line: Column) -> Column:
    return line.rlike(WORD)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), _has_word)


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), "[\\x20\\x09-\\x0D]+", " "))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def _covered(windows: Column) -> Column:
    """Positions covered by windows of three whose hash occurs twice or more."""

    def repeated(ordered: Column) -> Column:
        twice = lambda s, j: F.coalesce(F.get(ordered, j - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get(ordered, j + 1)["h"] == s["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, twice), lambda s: s["i"]))

    def total(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(bind(bind(ordered, repeated), total))


def repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice or more."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.slice(hashes, 1, F.size(hashes) - 2), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(bind(hashed, windows), _covered))


def metrics(text: Column) -> Column:
    """A struct of the base counts (METRICS, all long)."""
    whole = F.coalesce(text, F.lit(""))

    def counts(words: Column) -> Column:
        chars = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))
        return F.struct(F.size(words).cast("long").alias("n_words"), chars.alias("word_chars"), repeat_words(words).cast("long").alias("n_repeat_words"))

    lines = bind(_lines(whole), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    by_word = bind(F.regexp_extract_all(whole, F.lit(f"({WORD})")), counts)
    return bind(by_word, lambda w: F.struct(
        w["n_words"].alias("n_words"),
        w["word_chars"].alias("word_chars"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        w["n_repeat_words"].alias("n_repeat_words"),
    ))


def _keyed(df: DataFrame, doc_id: str, host: str, text: str) -> list[Column]:
    """What tells rows apart: repeated rows share it and get equal results."""
    return [F.col(doc_id).alias("__id"), F.col(host).alias("__host"), F.xxhash64(F.col(text)).alias("__content")]


def measured(df: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """__id, __host, __content, __m (base counts) and __l (hash and words of each line): all that is read of the texts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(_lines(whole), lambda x: F.struct(line_hash(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    return df.select(*_keyed(df, doc_id, host, text), metrics(F.col(text)).alias("__m"), lines.alias("__l"))


def frequent_lines(rows: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """__host, __line, __first (the document that keeps it), __docs of the lines above their limit; rows: measured()."""
    hashes = F.array_distinct(F.transform("__l", lambda x: x["h"]))
    # exact copies are one document: they are merged before the lines are dealt out
    contents = rows.select(*_KEY, hashes.alias("__lines")).groupBy("__host", "__content").agg(F.min("__id").alias("__id"), F.first("__lines").alias("__lines"))
    lines = contents.select("__host", "__id", F.explode("__lines").alias("__line")).groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__docs"), F.min("__id").alias("__first"))
    often = lines.where(F.col("__docs") > max_docs)
    if not max_share:
        return often
    sizes = rows.select(F.col("__host").alias("__h"), "__content").distinct().groupBy("__h").agg(F.count(F.lit(1)).alias("__all"))
    return often.join(sizes, F.col("__host").eqNullSafe(F.col("__h"))).where(F.col("__docs") > max_share * F.col("__all")).select("__host", "__line", "__first", "__docs")


def removals(rows: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, keep_first: bool = False) -> DataFrame:
    """For each document with lines to remove: its key and the lines' hashes (repeated rows share one); rows: measured()."""
    spread = rows.select(*_KEY, F.explode(F.transform("__l", lambda x: x["h"])).alias("__h"))
    often = frequent_lines(rows, max_docs, max_share).withColumnRenamed("__host", "__in")
    hit = spread.join(often, (F.col("__h") == F.col("__line")) & F.col("__host").eqNullSafe(F.col("__in")))
    hit = hit.where(~F.col("__id").eqNullSafe(F.col("__first"))) if keep_first else hit
    return hit.groupBy(*_KEY).agg(F.collect_set("__h").alias("__cut")).select(*[F.col(k).alias(f"{k}_r") for k in _KEY], "__cut")


def _matched(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left joined with right, whose key columns end in _r."""
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in _KEY], how).drop(*[f"{k}_r" for k in _KEY])


def judged(rows: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, keep_first: bool = False) -> DataFrame:
    """rows (measured()) with __cut, __gone (the removed lines), __lost (their words), __failed and __kept."""
    gone = F.filter("__l", lambda x: F.array_contains(F.coalesce("__cut", F.array().cast("array<bigint>")), x["h"]))
    lost = F.aggregate("__gone", F.lit(0), lambda a, x: a + x["n"])
    n = F.col("__m.n_words")
    out = _matched(rows, removals(rows, max_docs, max_share, keep_first), "left")
    out = out.withColumn("__gone", gone).withColumn("__lost", lost.cast("long")).withColumn("__failed", (n < MIN_WORDS) | (100 * F.col("__m.n_repeat_words") > REPEAT_PERCENT * n))
    return out.withColumn("__kept", ~F.col("__failed") & (n - F.col("__lost") >= min_left * n))


def report(df: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, keep_first: bool = False) -> DataFrame:
    """A row per input row: doc_id, the base counts, base_failed, kept, n_cut_lines, n_cut_words."""
    with Shelf(df.sparkSession) as shelf:
        rows = shelf.put(measured(df, doc_id, host, text))
        out = judged(rows, max_docs, max_share, min_left, keep_first).select(
            F.col("__id").alias(doc_id),
            *[F.col(f"__m.{c}").alias(c) for c in METRICS],
            F.col("__failed").alias("base_failed"),
            F.col("__kept").alias("kept"),
            F.size("__gone").cast("long").alias("n_cut_lines"),
            F.col("__lost").alias("n_cut_words"),
        )
        return shelf.keep(shelf.put(out))


def clean(df: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", length: str | None = None, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, keep_first: bool = False) -> DataFrame:
    """The kept documents, their frequent lines removed; the schema stays (length: a column for the new length)."""
    with Shelf(df.sparkSession) as shelf:
        rows = shelf.put(measured(df, doc_id, host, text))
        found = judged(rows, max_docs, max_share, min_left, keep_first).where("__kept")
        # repeated rows share a key and a verdict
        kept = found.groupBy(*_KEY).agg(F.first("__cut").alias("__cut")).select(*[F.col(k).alias(f"{k}_r") for k in _KEY], "__cut")
        kept = shelf.keep(shelf.put(kept))
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~(_has_word(x) & F.array_contains(F.col("__cut"), line_hash(x)))), "\n")
    out = _matched(df.select("*", *_keyed(df, doc_id, host, text)), kept, "inner")
    out = out.withColumn(text, F.when(F.col("__cut").isNull(), F.col(text)).otherwise(left))
    if length:
        out = out.withColumn(length, F.length(text).cast(df.schema[length].dataType))
    return out.select(*df.columns)
