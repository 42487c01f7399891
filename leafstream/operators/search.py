"""Substring search over pages and tags: trigram postings narrow, exact comparison decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import positions, snippet, trigrams
from ..sources.tables import Shelf

MOST, EDGE = 500, 30


def search_pages(pages: DataFrame, keys: list[str], page: str, text: str) -> DataFrame:
    """keys, page, text and text_lower: what a search reads."""
    return pages.select(*keys, F.col(page).alias("page_pos"), F.col(text).alias("text"), F.lower(text).alias("text_lower"))


def search_tags(tags: DataFrame, keys: list[str], page: str, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    both = F.concat_ws(" = ", key, value)
    return tags.select(*keys, F.col(page).alias("page_pos"), F.col(seq).alias("seq"), F.col(key).alias("key"), F.col(value).alias("value"), both.alias("combined"), F.lower(both).alias("combined_lower"))


def postings(pages: DataFrame, keys: list[str], lower: str, scope: str) -> DataFrame:
    """A row per page and distinct trigram of the text."""
    return pages.select(*keys, F.lit(scope).alias("scope"), F.explode(trigrams(F.col(lower))).alias("trigram"), "page_pos").distinct()


def query_trigrams(query: str) -> list[str]:
    q = query.strip().lower()
    return [q] if len(q) <= 2 else sorted({q[i : i + 3] for i in range(len(q) - 2)})


def candidates(posted: DataFrame, keys: list[str], query: str, scope: str | None = None) -> DataFrame:
    """keys and page_pos of the pages that have all the query's trigrams (the query needs 3 characters or more)."""
    grams = query_trigrams(query)
    some = posted.where(F.col("trigram").isin(grams))
    some = some if scope is None else some.where(F.col("scope") == scope)
    return some.groupBy(*keys, "scope", "page_pos").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(grams)).select(*keys, "page_pos").distinct()


#: Pages of a key that a block of postings covers.
BLOCK_PAGES = 4096


#: Characters of text whose lists are made at once.
LISTED = 4 << 20
_BITS = 21


def _grams(text: str) -> np.ndarray:
    """The distinct trigrams (as trigrams() has them) as numbers, 21 bits a character, 0 for none."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    if len(c) < 3:
        c = np.concatenate([c, np.zeros(3 - len(c), np.int64)])
    return np.unique(c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:]) if text else c[:0]


def _spelled(grams: np.ndarray) -> pa.Array:
    """The trigrams' texts."""
    known, at = np.unique(grams, return_inverse=True)
    codes = np.stack([known >> 2 * _BITS, known >> _BITS & (1 << _BITS) - 1, known & (1 << _BITS) - 1], 1)
    text = (codes[codes > 0] - 1).astype("<u4").tobytes().decode("utf-32-le")
    ends = np.cumsum((codes > 0).sum(1)).tolist()
    return pa.array([text[i:j] for i, j in zip([0, *ends], ends)], pa.string()).take(pa.array(at))


def _listed(scope: str, keys: list[str], rows: pa.RecordBatch, grams: list[np.ndarray]) -> pa.RecordBatch:
    """rows (keys and page_pos) and the trigrams of each as lists of pages."""
    page = rows.column(len(keys)).to_numpy(zero_copy_only=False).astype(np.int64)
    block, known = page // BLOCK_PAGES, {}
    group = np.array([known.setdefault(k, i) for i, k in enumerate(zip(*[rows.column(i).to_pylist() for i in range(len(keys))], block.tolist()))])
    row, gram = np.repeat(np.arange(len(page)), [len(g) for g in grams]), np.concatenate(grams)
    order = np.lexsort((page[row], gram, group[row]))
    row, gram = row[order], gram[order]
    of, at = group[row], (page - block * BLOCK_PAGES)[row]
    new = np.ones(len(row), bool)
    new[1:] = (of[1:] != of[:-1]) | (gram[1:] != gram[:-1])
    once = new.copy()
    once[1:] |= at[1:] != at[:-1]  # rows of a page that have the same trigram
    first = np.flatnonzero(new)
    ends = np.append(np.cumsum(once)[first] - 1, once.sum()).astype(np.int32)
    held = pa.array(of[first])
    columns = [pa.repeat(pa.scalar(scope), len(first)), _spelled(gram[first]), *[rows.column(i).take(held) for i in range(len(keys))], pa.array(block[of[first]])]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(at[once].astype(np.int16)))], names=["scope", "trigram", *keys, "block", "pages"])


def posting_blocks(pages: DataFrame, keys: list[str], lower: str, scope: str) -> DataFrame:
    """Postings as lists: scope, trigram, keys, block (a range of BLOCK_PAGES pages) and pages, ascending, as distances from the block's first page.

    A task lists what pages it has: no row stands for a page and trigram.  A block whose pages several batches hold has several
    lists, which merged_blocks() makes one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"scope string, trigram string, {''.join(f'`{k}` {kinds[k]}, ' for k in keys)}block bigint, pages array<smallint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, size, first = [], 0, 0
            for i, text in enumerate(batch.column(len(keys) + 1)):
                said = text.as_py() or ""
                grams.append(_grams(said))
                size += len(said)
                if size >= LISTED or i == batch.num_rows - 1:
                    if size:
                        yield _listed(scope, keys, batch.slice(first, len(grams)), grams)
                    grams, size, first = [], 0, i + 1

    return pages.select(*keys, "page_pos", lower).mapInArrow(run, schema)


def merged_blocks(lists: DataFrame, keys: list[str]) -> DataFrame:
    """One list of a trigram, scope, keys and block."""
    both = F.flatten(F.collect_list("pages"))
    return lists.groupBy("scope", "trigram", *keys, "block").agg(F.sort_array(F.array_distinct(both)).alias("pages"))


def block_candidates(blocks: DataFrame, keys: list[str], query: str, scope: str | None = None) -> DataFrame:
    """candidates() over posting_blocks(): only the trigrams' lists are read, and met block by block."""
    grams = query_trigrams(query)
    some = blocks.where(F.col("trigram").isin(grams))
    some = some if scope is None else some.where(F.col("scope") == scope)
    lists = some.groupBy(*keys, "scope", "block").agg(F.collect_list("pages").alias("lists")).where(F.size("lists") == len(grams))
    common = F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0))), F.element_at("lists", 1), lambda a, x: F.array_intersect(a, x))
    return lists.select(*keys, "block", F.explode(common).alias("__p")).select(*keys, (F.col("block") * BLOCK_PAGES + F.col("__p")).alias("page_pos")).distinct()


def _narrowed(rows: DataFrame, posted: DataFrame | None, keys: list[str], query: str, scope: str) -> DataFrame:
    if posted is None or len(query.strip()) < 3:
        return rows
    found = block_candidates if "block" in posted.columns else candidates
    return rows.join(found(posted, keys, query, scope), [*keys, "page_pos"], "left_semi")


def _has(column: str, needle: str) -> Column:
    """A blank query is in nothing."""
    return F.contains(column, F.lit(needle)) if needle else F.lit(False)


def text_hits(pages: DataFrame, keys: list[str], query: str, posted: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """A row per occurrence: keys, page_pos, kind, tag_key, match_index, excerpt, seq.

    most: only the first hits by keys, page_pos and place are wanted.  A page that has the query has a hit, so they lie in the first
    pages, by their first hits, and only those are searched on and cut into excerpts.
    """
    needle = query.strip().lower()
    rows = _narrowed(pages, posted, keys, query, "text").where(_has("text_lower", needle))
    if most is not None:
        rows = rows.withColumn("__first", F.locate(needle, F.col("text_lower"))).orderBy(*keys, "page_pos", "__first").limit(most)
    found = rows.select(*keys, "page_pos", "text", F.explode(positions(F.col("text_lower"), needle)).alias("at"))
    found = found if most is None else found.orderBy(*keys, "page_pos", "at").limit(most)
    return found.select(*keys, "page_pos", F.lit("text").alias("kind"), F.lit(None).cast("string").alias("tag_key"), F.col("at").cast("long").alias("match_index"), snippet(F.col("text"), F.col("at"), len(query), EDGE).alias("excerpt"), F.col("at").cast("long").alias("seq"))


def tag_hits(tags: DataFrame, keys: list[str], query: str, posted: DataFrame | None = None) -> DataFrame:
    """A row per tag whose 'key = value' has the query."""
    needle = query.strip().lower()
    rows = _narrowed(tags, posted, keys, query, "tag").where(_has("combined_lower", needle))
    at = (F.locate(needle, F.col("combined_lower")) - 1).cast("long")
    return rows.select(*keys, "page_pos", F.lit("tag").alias("kind"), F.col("key").alias("tag_key"), at.alias("match_index"), F.col("combined").alias("excerpt"), F.col("seq").cast("long").alias("seq"))


def search(pages: DataFrame, tags: DataFrame, keys: list[str], query: str, kind: str = "all", most: int = MOST, posted: DataFrame | None = None) -> DataFrame:
    """The first hits by page, tags before text, then place; posted: postings() or posting_blocks() of both, if there are any."""
    if kind not in ("all", "text", "tag"):
        raise ValueError("kind is all, text or tag")
    if not 1 <= most <= 1000:
        raise ValueError("most is 1 to 1000")
    parts = [] if kind == "text" else [tag_hits(tags, keys, query, posted).withColumn("rank", F.lit(0))]
    parts += [] if kind == "tag" else [text_hits(pages, keys, query, posted, most).withColumn("rank", F.lit(1))]
    hits = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return hits.orderBy(*keys, "page_pos", "rank", "seq").limit(most).drop("rank", "seq")


def element_search(nodes: DataFrame, query: str, order: list[str], most: int = 1000) -> DataFrame:
    """Elements whose search text (abbreviation, name, type, preview) has the query, in tree order."""
    return nodes.where(_has("search_text", query.strip().lower())).orderBy(*order).limit(most)


def search_text(abbrev: Column, full_name: Column, type_id: Column, preview: Column) -> Column:
    return F.lower(F.concat_ws("\0", abbrev, full_name, type_id, preview))


def hit_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def neighbours(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """number, next_number and previous_number of each hit, going round.

    The hits are dealt by ranges of keys and order into a table; each range numbers its own, and how many
    lie before it (a row a range and key) is added, so no key is numbered in one task.
    """
    spark = hits.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Shelf(spark) as shelf:
        dealt = shelf.keep(shelf.put(hits.repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id())))
    key, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__of"), F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("__low"), F.sum("c").over(key).alias("__n"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__part") == F.col("__of")]
    i = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)) + F.col("__low")
    numbered = dealt.join(counts, same).withColumn("number", i.cast("long"))
    n = F.col("__n")
    return numbered.select(*hits.columns, "number", (F.col("number") % n + 1).cast("long").alias("next_number"), (F.pmod(F.col("number") - 2, n) + 1).cast("long").alias("previous_number"))


def highlights(runs: DataFrame, query: str) -> DataFrame:
    """Boxes of text runs that have the query: from the run's left edge, 120 units a character, 240 high."""
    has = F.contains(F.lower("text"), F.lit(query.strip().lower()))
    return runs.where(has).select("*", F.col("x").alias("box_x"), F.col("y").alias("box_y"), (F.length("text") * 120).alias("box_width"), F.lit(240).alias("box_height"))
