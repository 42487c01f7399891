"""Page indexes by pairing begin and end marks, with document and group attribution.

All operators are windows over one ordering per file and take the columns' names, so they work on
any log of marks.  Page numbers count begins; page_pos counts pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ebcdic
from . import scans

#: Page strategies: name, begin, end, priority among equals.
STRATEGIES = (("BPG", "D3A8AD", "D3A9AD"), ("BRS", "D3A8AF", "D3A9AF"), ("BDT", "D3A8A8", "D3A9A8"), ("BPF", "D3A8A5", "D3A9A5"))


def pair_marks(log: DataFrame, keys: list[str], order: list[str], kind: str, begin: str = "B", end: str = "E") -> DataFrame:
    """The end rows whose nearest mark before is a begin, with that begin's row and number.

    An end closes the latest begin; a begin without an end still counts (page_number), a later begin
    takes its place.  Adds page_number, page_pos (both from 1) and begin_<c> for every order column.
    """
    marks = log.where(F.col(kind).isin(begin, end))
    by = Window.partitionBy(*keys).orderBy(*order)
    before = {f"begin_{c}": F.lag(c).over(by) for c in order}
    number = F.sum((F.col(kind) == begin).cast("long")).over(by)
    paired = marks.select("*", F.lag(kind).over(by).alias("__before"), number.alias("page_number"), *[c.alias(n) for n, c in before.items()])
    pages = paired.where((F.col(kind) == end) & (F.col("__before") == begin)).drop("__before")
    return pages.withColumn("page_pos", F.row_number().over(by).cast("long"))


_BUCKET = 65536


def _numbered(sf: DataFrame) -> DataFrame:
    """The marks of all strategies (a type belongs to one) with the next mark of theirs, in one pass over the fields.

    Also a row without strategy for the first bucket of each file, and the file's size on every row.
    Fields are merged by buckets of a file before any are dealt out, so only marks and a row a bucket move.
    """
    t = F.col("type_id")
    prio = F.coalesce(*[F.when(t.isin(b, e), i) for i, (_, b, e) in enumerate(STRATEGIES)])
    begins = t.isin(*[b for _, b, _ in STRATEGIES])
    behind = F.col("offset") + 1 + F.col("length")
    mark = F.when(prio.isNotNull(), F.struct(prio.alias("prio"), begins.alias("begins"), F.col("offset").alias("offset"), behind.alias("behind")))
    merged = sf.groupBy("file_id", F.floor(F.col("offset") / F.lit(_BUCKET * 64)).alias("bucket")).agg(F.collect_list(mark).alias("marks"), F.max(behind).alias("size"))
    rows = merged.select("file_id", "size", F.explode(F.concat("marks", F.array(F.struct(F.lit(None).cast("int").alias("prio"), F.lit(False).alias("begins"), F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("bigint").alias("behind"))))).alias("m"))
    rows = rows.select("file_id", "m.*", F.max("size").over(Window.partitionBy("file_id")).alias("size"))
    by = Window.partitionBy("file_id", "prio").orderBy("offset")
    return rows.select("*", F.lead("begins").over(by).alias("next"), F.lead("behind").over(by).alias("closed"), F.sum(F.col("begins").cast("long")).over(by).alias("page_number"))


def _strategy() -> Column:
    return F.coalesce(*[F.when(F.col("prio") == i, n) for i, (n, _, _) in enumerate(STRATEGIES)], F.lit("FILE"))


def _as_pages(seen: DataFrame) -> DataFrame:
    """The begins that a page belongs to: those without another begin behind them."""
    pages = seen.where("begins AND NOT coalesce(next, false)").select("file_id", _strategy().alias("strategy"), "prio", "page_number", F.col("offset").alias("byte_offset"), (F.coalesce("closed", "size") - F.col("offset")).alias("byte_length"))
    return pages.withColumn("page_pos", F.row_number().over(Window.partitionBy("file_id", "prio").orderBy("byte_offset")).cast("long"))


def strategy_pages(sf: DataFrame) -> DataFrame:
    """file_id, strategy, prio, page_number, page_pos, byte_offset, byte_length for every strategy.

    An unclosed begin runs to the end of the file.
    """
    return _as_pages(_numbered(sf))


def best_strategy(pages: DataFrame, keys: list[str], strategy: str = "strategy", prio: str = "prio") -> DataFrame:
    """keys, strategy and n of the strategy with most pages; the first in priority among equals."""
    counts = pages.groupBy(*keys, strategy, prio).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct(strategy, "n"), F.struct(F.col("n"), -F.col(prio))).alias("b")
    return counts.groupBy(*keys).agg(best).select(*keys, f"b.{strategy}", "b.n")


def page_index(sf: DataFrame) -> DataFrame:
    """The pages of each file's best strategy; a file without any is one page.

    One pass over the fields: sizes, counts and the choice are windows over the marks.
    """
    seen = _numbered(sf)
    is_page = F.col("begins") & ~F.coalesce("next", F.lit(False))
    counted = seen.withColumn("n", F.count_if(is_page).over(Window.partitionBy("file_id", "prio")))
    file = Window.partitionBy("file_id")
    best = F.max(F.when(F.col("prio").isNotNull() & (F.col("n") > 0), F.struct("n", (-F.col("prio")).alias("p")))).over(file)
    # a file without pages: one of its rows without strategy stands for it
    alone = F.when(F.col("prio").isNull(), F.row_number().over(Window.partitionBy("file_id", "prio").orderBy("offset")))
    chosen = counted.withColumns({"best": best, "alone": alone}).where((is_page & (F.col("best.p") == -F.col("prio"))) | (F.col("best").isNull() & (F.col("alone") == 1)))
    whole = F.col("prio").isNull()
    begin = F.coalesce("offset", F.lit(0).cast("long"))
    return chosen.select(
        "file_id", _strategy().alias("strategy"), F.when(whole, 1).otherwise(F.col("page_number")).cast("long").alias("page_number"),
        F.row_number().over(Window.partitionBy("file_id").orderBy("offset")).cast("long").alias("page_pos"),
        begin.alias("byte_offset"), (F.coalesce("closed", "size") - begin).alias("byte_length"),
    )


def attributed(log: DataFrame, keys: list[str], order: list[str], document: Column, group: Column, name: Column | None = None, split: Column | None = None) -> DataFrame:
    """document_index (groups so far in the document, from 0) and document_name (last group's name).

    document and group say which rows begin one; a document begins the count again.  With split the key's rows are
    taken in parallel (scans.py).
    """
    if split is not None:
        named = {"document_name": F.when(group, name)} if name is not None else {}
        counted = scans.running(log.withColumn("__group", group.cast("long")), keys, split, order, {"__groups": F.col("__group")})
        out = scans.last_values(counted, keys, split, order, {"__from": F.when(document, F.col("__groups") - F.col("__group")), **named})
        return out.withColumn("document_index", F.greatest(F.col("__groups") - F.coalesce("__from", F.lit(0)) - 1, F.lit(0))).drop("__group", "__groups", "__from")
    by = Window.partitionBy(*keys).orderBy(*order)
    epoch = log.withColumn("__epoch", F.sum(document.cast("long")).over(by))
    inner = Window.partitionBy(*keys, "__epoch").orderBy(*order)
    index = F.greatest(F.sum(group.cast("long")).over(inner) - 1, F.lit(0))
    out = epoch.withColumn("document_index", index)
    if name is not None:
        out = out.withColumn("document_name", F.last(F.when(group, name), ignorenulls=True).over(by))
    return out.drop("__epoch")


def scan_index(sf: DataFrame, split: Column | None = None) -> DataFrame:
    """The full index scan: BPG/EPG pages with what they hold and where they belong.

    An unclosed page ends before the field that closes it (a document's or group's end), or at the
    end of the file.  has_text goes by the one begin-text type, has_text_any by both.  With split a file's fields are taken in parallel.
    """
    by = Window.partitionBy("file_id").orderBy("offset")
    kind = F.when(F.col("type_id") == "D3A8AD", "B").when(F.col("type_id") == "D3A9AD", "E").when(F.col("type_id").isin("D3A9A8", "D3A9CA"), "C")
    group = ebcdic.decode_name(F.substring("data", 1, 8), "group")
    log = attributed(sf.withColumn("kind", kind), ["file_id"], ["offset"], F.col("type_id") == "D3A8A8", F.col("type_id") == "D3ABCA", F.nullif(group, F.lit("")), split)
    counts = {"page_number": (F.coalesce("kind", F.lit("")) == "B").cast("long"), "__closed": F.coalesce(F.col("kind").isin("E", "C"), F.lit(False)).cast("long")}
    log = log.withColumns({n: F.sum(c).over(by) for n, c in counts.items()}) if split is None else scans.running(log, ["file_id"], split, ["offset"], counts)
    inner = log.where("page_number > 0").withColumn("__first", F.max(F.when(F.col("kind") == "B", F.col("__closed"))).over(Window.partitionBy("file_id", "page_number")))
    inside = inner.where((F.col("__closed") == F.col("__first")) | ((F.col("__closed") == F.col("__first") + 1) & F.col("kind").isin("E", "C")))
    size = sf.groupBy("file_id").agg(F.max(F.col("offset") + 1 + F.col("length")).alias("size"))
    behind = F.col("offset") + 1 + F.col("length")
    end = F.min(F.when(F.col("kind") == "E", behind).when(F.col("kind") == "C", F.col("offset")))
    begin = F.coalesce(F.col("kind"), F.lit("")) == "B"
    pages = inside.groupBy("file_id", "page_number").agg(
        F.min("offset").alias("byte_offset"), end.alias("end"),
        F.max(F.when(begin, F.col("document_index"))).alias("document_index"), F.max(F.when(begin, F.col("document_name"))).alias("document_name"),
        F.count_if((F.substring("type_id", 3, 2) == "A8") & ~begin).alias("object_count"),
        F.bool_or(F.col("type_id") == "D3A87B").alias("has_text"), F.bool_or(F.col("type_id").isin("D3A87B", "D3A89B")).alias("has_text_any"),
        F.bool_or(F.col("type_id").isin("D3A8C5", "D3A8FB", "D3A892")).alias("has_images"),
    )
    return pages.join(size, "file_id").select("file_id", "page_number", F.row_number().over(Window.partitionBy("file_id").orderBy("byte_offset")).cast("long").alias("page_pos"), "byte_offset", (F.coalesce("end", "size") - F.col("byte_offset")).alias("byte_length"), "document_index", "document_name", "object_count", "has_text", "has_text_any", "has_images")


def structure(sf: DataFrame) -> DataFrame:
    """file_id, pages, preamble_end (first page's start) and postamble_start (behind the last page)."""
    size = F.max(F.col("offset") + 1 + F.col("length"))
    begin = F.when(F.col("type_id") == "D3A8AD", F.col("offset"))
    end = F.when(F.col("type_id") == "D3A9AD", F.col("offset") + 1 + F.col("length"))
    return sf.groupBy("file_id").agg(F.count(begin).alias("pages"), F.coalesce(F.min(begin), size).alias("preamble_end"), F.coalesce(F.max(end), size).alias("postamble_start"), size.alias("size"))


def quick_page_count(sf: DataFrame) -> DataFrame:
    """Pages by begin-page fields; without any, by begin-document fields."""
    count = lambda t: F.count_if(F.col("type_id") == t)
    return sf.groupBy("file_id").agg(F.coalesce(F.nullif(count("D3A8AD"), F.lit(0)), count("D3A8A8")).alias("pages"))


def batches(pages: DataFrame, keys: list[str], size: int, page_pos: str = "page_pos") -> DataFrame:
    """Consecutive parts of size pages: keys, part, parts, start_page, end_page, page_count."""
    if size < 1:
        raise ValueError("a part has at least one page")
    part = F.ceil(F.col(page_pos) / size).cast("long")
    parts = pages.groupBy(*keys, part.alias("part")).agg(F.min(page_pos).alias("start_page"), F.max(page_pos).alias("end_page"), F.count(F.lit(1)).alias("page_count"))
    totals = pages.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("parts"))
    return parts.join(totals, keys)


def context(log: DataFrame, keys: list[str], order: list[str], is_page: Column, split: Column | None = None) -> DataFrame:
    """page_no (pages begun so far) and context ('document-level' before the first, else 'page-n')."""
    n = is_page.cast("long")
    log = log.withColumn("page_no", F.sum(n).over(Window.partitionBy(*keys).orderBy(*order))) if split is None else scans.running(log, keys, split, order, {"page_no": n})
    return log.withColumn("context", F.when(F.col("page_no") == 0, "document-level").otherwise(F.concat(F.lit("page-"), F.col("page_no").cast("string"))))


def page_bytes(files: DataFrame, pages: DataFrame, page_number: int | None = None) -> DataFrame:
    """pages with their bytes (content); page_number picks one of each file."""
    from .surgery import cut

    wanted = pages if page_number is None else pages.where(F.col("page_number") == page_number)
    cuts = F.array(F.struct(F.col("byte_offset").cast("long").alias("start"), F.col("byte_length").cast("long").alias("n")))
    return cut(files, wanted.withColumn("cuts", cuts)).select(*wanted.columns, "content")
