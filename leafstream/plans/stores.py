"""Queries over stored files and archives, page assembly and the SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as sql_functions
from ..operators import assembly, diagnostics, pages, scans, sinks
from ..operators.search import search_tags
from ..sources import datasource, framing, wire
from ..sources import files as file_source
from ..sources.tables import VERSION, Shelf, reused, shared_folder, signature
from ..sources.type_dim import is_begin, is_end
from ..sources.wire import field, number
from ..streaming.store import Archive
from . import fixtures as fx
from .decoding import _long
from .registry import DOCUMENTS as _D
from .registry import PAGE_TEXTS as _PT
from .registry import longs, query


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of print files: written once by the file sink, then read."""
    source = f"{sf_dir}/documents.parquet"
    folder = f"{shared_folder(spark)}/stores/v{VERSION}/folder-{signature(spark, source)}"
    named = lambda: fx.print_files(spark, sf_dir).select(F.concat(F.translate("file_id", "/", "-"), F.lit(".afp")).alias("name"), "content")
    reused(spark, "folder-list", source, lambda: sinks.write_files(named(), folder))
    return folder


_NAMED = "replace(file_id, '/', '-') || '.afp'"
_COUNTS = f"""WITH {_D}, c AS (SELECT {_NAMED} AS name, count(*) AS n, sum((n + 24999) // 25000) AS x FROM p GROUP BY 1)
SELECT name, type_id, CAST(k AS BIGINT) AS n FROM (SELECT name, unnest(['D3A8A8', 'D3A9A8', 'D3A8AD', 'D3A9AD', 'D3A090', 'D3A89B', 'D3A99B', 'D3EE9B']) AS type_id, unnest([1, 1, n, n, 2 * n, n, n, x]) AS k FROM c) WHERE k > 0"""


def _by_name(sf: DataFrame) -> DataFrame:
    return diagnostics.field_counts(sf).select(F.element_at(F.split("file_id", "/"), -1).alias("name"), "type_id", "n")


@query(_COUNTS)
def files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Print files of a folder, whole, framed."""
    return _by_name(framing.frames(file_source.accepted(file_source.print_files(spark, _folder(spark, sf_dir)))))


@query(_COUNTS)
def files_in_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files through the data source, in splits of 100,000 bytes."""
    spark.dataSource.register(datasource.PrintStream)
    return _by_name(spark.read.format("printstream").option("splitBytes", 100_000).option("payload", "false").load(f"{_folder(spark, sf_dir)}/*.afp"))


_PLACES = f"""WITH {_D}, k AS (SELECT *, 6 + (n + 24999) // 25000 AS f, 9 + (9 + 4 + 5 + 4 + length(CAST(doc_id AS VARCHAR))) + (9 + 4 + 4 + 4 + length(lang)) AS before_text FROM pg),
o AS (SELECT *, 1 + coalesce(sum(f) OVER (PARTITION BY file_id ORDER BY page_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM k)"""


def _split_fields(spark: SparkSession, sf_dir: str, payload: bool = False) -> DataFrame:
    """The folder's fields through the data source, in splits of 100,000 bytes, with their file's name."""
    spark.dataSource.register(datasource.PrintStream)
    sf = spark.read.format("printstream").option("splitBytes", 100_000).option("payload", str(payload).lower()).load(f"{_folder(spark, sf_dir)}/*.afp")
    return sf.withColumn("file_id", F.element_at(F.split("file_id", "/"), -1))


@query(f"""{_PLACES} SELECT {_NAMED} AS name, CAST(byte_offset AS BIGINT) AS "offset", 'D3A8AD' AS type_id, CAST(no AS BIGINT) AS sf_no, CAST(page_pos AS BIGINT) AS page_number, CAST(1 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS parent FROM o
UNION ALL SELECT {_NAMED}, CAST(byte_offset + before_text AS BIGINT), 'D3A89B', CAST(no + 3 AS BIGINT), CAST(page_pos AS BIGINT), 2, CAST(byte_offset AS BIGINT) FROM o""")
def fields_in_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, pages, depths and parents of all pages' and texts' begins, over files in splits."""
    split = scans.by_offset(100_000)
    with Shelf(spark) as shelf:  # framed once: windows and summaries read the fields many times
        sf = shelf.keep(shelf.put(_split_fields(spark, sf_dir)))
    tree = scans.nested(scans.numbered(sf, split), ["file_id"], split, ["offset"], is_begin(F.col("type_id")), is_end(F.col("type_id")), "offset")
    return tree.where("type_id IN ('D3A8AD', 'D3A89B')").select(F.col("file_id").alias("name"), "offset", "type_id", "sf_no", "page_number", F.col("depth").cast("long").alias("depth"), "parent")


@query(f"""WITH {_D} SELECT {_NAMED} AS name, CAST(page_pos AS BIGINT) AS page_pos, CAST(byte_offset AS BIGINT) AS byte_offset, CAST(page_len AS BIGINT) AS byte_length, CAST(1 AS BIGINT) AS object_count, TRUE AS has_text_any FROM pg""")
def scan_in_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full index scan over files in splits."""
    with Shelf(spark) as shelf:
        named = _split_fields(spark, sf_dir, payload=True).withColumn("data", F.substring("data", 1, 8))  # of payloads the scan reads names
        sf = shelf.keep(shelf.put(named))
    index = pages.scan_index(sf, scans.by_offset(100_000))
    return index.select(F.col("file_id").alias("name"), "page_pos", "byte_offset", "byte_length", "object_count", "has_text_any")


@query(f"WITH {_D} SELECT {_NAMED} AS name, CAST(26 + sum(page_len) AS BIGINT) AS size FROM pg GROUP BY 1")
def files_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes, contents unread."""
    return file_source.listing(spark, _folder(spark, sf_dir))


@query(f"WITH {_D} SELECT {_NAMED} AS name, count(*) AS pages, min(byte_offset) = 17 AS good FROM pg WHERE file_id = (SELECT min(file_id) FROM p) GROUP BY 1")
def file_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file by its name."""
    folder = _folder(spark, sf_dir)
    name = file_source.listing(spark, folder).agg(F.min("name")).first()[0]
    index = pages.page_index(framing.frames(file_source.named(spark, folder, name)))
    return index.groupBy(F.element_at(F.split("file_id", "/"), -1).alias("name")).agg(F.count(F.lit(1)).alias("pages"), (F.min("byte_offset") == 17).alias("good"))


def _archive(spark: SparkSession, sf_dir: str) -> Archive:
    archive = Archive(spark, f"{shared_folder(spark)}/stores/v{VERSION}/archive-{signature(spark, f'{sf_dir}/documents.parquet')}")
    if archive.state()["batches"] < 2:
        archive.reset()
        files = fx.print_files(spark, sf_dir)
        some = F.pmod(F.xxhash64("file_id"), F.lit(2)) == 0
        archive.build(files.where(some))
        archive.build(files)  # the other half; known files are skipped
    return archive


@query(f"WITH {_D} SELECT file_id, CAST(page_pos AS BIGINT) AS page_pos, CAST(byte_offset AS BIGINT) AS byte_offset, CAST(page_len AS BIGINT) AS byte_length FROM pg")
def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored page index of all files, built in two batches."""
    return _archive(spark, sf_dir).page_index().select("file_id", "page_pos", "byte_offset", "byte_length")


@query(f"""WITH {_PT} SELECT file_id, page_pos, 'text' AS kind, CAST(i - 1 AS BIGINT) AS match_index FROM (SELECT *, unnest(range(1, length(text) - 2)) AS i FROM t) WHERE substr(lower(text), i, 4) = 'tion' ORDER BY file_id, page_pos, match_index LIMIT 1000""")
def archive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over the stored postings."""
    return _archive(spark, sf_dir).search("Tion", "text", 1000).select("file_id", "page_pos", "kind", "match_index")


@query(f"WITH {_D} SELECT CAST(2 AS BIGINT) AS batches, count(DISTINCT file_id) AS files, count(*) AS pages FROM pg")
def archive_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an archive holds after a build in two batches and a third that finds nothing new."""
    archive = _archive(spark, sf_dir)
    again = archive.build(fx.print_files(spark, sf_dir))
    state = archive.state()
    return spark.createDataFrame([(state["batches"], state["files"], state["pages"] + again)], "batches bigint, files bigint, pages bigint")


@query(longs("""WITH f AS (SELECT 'p' || p_partkey AS file_id, p_size, p_size % 2 AS k, p_brand FROM part)
SELECT file_id, 1 AS page_pos, unnest([1, 2, 3, 4]) AS object_no, unnest(['text', 'graphics', 'barcode', 'text']) AS kind, unnest([48, 69, 90, 108 + length(p_brand)]) AS "offset", p_size AS x, 2 AS y,
unnest([CASE WHEN k = 1 THEN 100 END, CASE WHEN k = 1 THEN 100 END, CASE WHEN k = 1 THEN 100 ELSE 2880 END, CASE WHEN k = 1 THEN 100 END]) AS w, unnest([CASE WHEN k = 1 THEN 50 END, CASE WHEN k = 1 THEN 50 END, CASE WHEN k = 1 THEN 50 ELSE 1440 END, CASE WHEN k = 1 THEN 50 END]) AS h,
unnest(['one', 'two', p_brand, 'stray']) AS data FROM f""", 'page_pos object_no "offset" x y w h'))
def assembled_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's objects: text that a drawing's begin ends, a barcode's data, text outside any object, sizes told or usual."""
    raw = lambda t: F.lit(t).cast("binary")
    odd = F.col("p_size") % 2
    place = F.concat(number(F.col("p_size"), 3), number(F.lit(2), 3), number(odd * 100, 3), number(odd * 50, 3))
    page = F.concat(
        field("D3A8AD"), field("D3AC6B", place), field("D3A89B"), field("D3EE9B", raw("one")), field("D3A8BB"), field("D3EEBB", raw("two")),
        field("D3A8EB"), field("D3EEEB", F.col("p_brand").cast("binary")), field("D3A9EB"), field("D3EE9B", raw("stray")), field("D3A9AD"),
    )
    made = fx.dealt(spark, sf_dir, "part", "p_partkey").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file_id"), F.concat(field("D3A8A8"), page, field("D3A9A8")).alias("content"))
    sf = framing.frames(made)
    found = assembly.page_objects(sf, pages.page_index(sf))
    return _long(found.select("file_id", "page_pos", "object_no", "kind", "offset", "x", "y", "w", "h", F.col("data").cast("string").alias("data")))


@query("""WITH f AS (SELECT 'p' || p_partkey AS file_id, p_size, p_brand FROM part)
SELECT file_id, 'D3A090' AS type_id, CAST(2 AS BIGINT) AS triplets, CAST(18 AS BIGINT) AS "offset", p_brand AS said FROM f""")
def sql_decoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, triplets and text runs by the functions registered for SQL."""
    sql_functions.register(spark)
    page = wire.page([("BRAND", F.col("p_brand"))], F.col("p_brand"))
    made = fx.dealt(spark, sf_dir, "part", "p_partkey").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file_id"), F.concat(field("D3A8A8"), page, field("D3A9A8")).alias("content"))
    made.createOrReplaceTempView("leafstream_sql_files")
    return spark.sql("""
        WITH fields AS (SELECT f.file_id, t.* FROM leafstream_sql_files f, LATERAL afp_fields(f.content) t),
        tags AS (SELECT file_id, `offset`, type_id, count(*) AS triplets FROM (SELECT s.file_id, s.`offset`, s.type_id, t.id FROM fields s, LATERAL afp_triplets(s.data) t WHERE s.type_id = 'D3A090') GROUP BY ALL),
        runs AS (SELECT file_id, ptoca_runs(data)[0].text AS said FROM fields WHERE type_id = 'D3EE9B')
        SELECT file_id, type_id, triplets, `offset`, said FROM tags JOIN runs USING (file_id)""")


@query("""WITH f AS (SELECT 'p' || p_partkey AS file_id, p_brand AS b FROM part) SELECT file_id, CAST(1 AS BIGINT) AS page_pos, 'brand = ' || lower(b) AS combined_lower FROM f""")
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search over tags reads."""
    made = fx.dealt(spark, sf_dir, "part", "p_partkey").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file_id"), F.lit(1).cast("long").alias("page"), F.lit("BRAND").alias("key"), F.col("p_brand").alias("value"), F.lit(0).alias("seq"))
    return search_tags(made, ["file_id"], "page").select("file_id", "page_pos", "combined_lower")
