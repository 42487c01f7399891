"""Queries that read exports and composed pages back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import once
from ..operators import compose, sinks, tags
from . import fixtures as fx
from .registry import PAGE_TEXTS as _PT
from .registry import query


def _by_file(spark: SparkSession, sf_dir: str, texts: DataFrame) -> DataFrame:
    """Texts dealt out by file into shares that don't grow with the table: a task gathers the texts of so many files only, and none before they are dealt out."""
    return texts.repartition(fx.shares(spark, sf_dir, "documents", fx.FILE_DOCS), "file_id")


@query(f"""WITH {_PT} SELECT file_id, count(*) AS pages, md5(string_agg(CAST(doc_id AS VARCHAR) || ',' || lang, ';' ORDER BY page_pos)) AS tags, md5(string_agg(text, chr(10) ORDER BY page_pos)) AS texts FROM t GROUP BY file_id""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the JSON: all tags and all texts."""
    sf, index = fx.print_pages(spark, sf_dir)
    made = sinks.json_documents(tags.file_metadata(sf), _by_file(spark, sf_dir, fx.page_texts(sf, index)), tags.tags(sf).withColumnRenamed("offset", "seq"))
    read = made.select("file_id", F.from_json("json", "document struct<total_pages:bigint>, metadata struct<tags:array<struct<key:string,value:string>>>, pages array<struct<text:string>>").alias("j"))
    # the values are taken once a file: inside the second lambda they would be taken again for each pair
    pairs = once(F.transform("j.metadata.tags", lambda t: t["value"]), lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(2)), lambda i: F.concat(F.get(v, i), F.lit(","), F.get(v, i + 1))))
    texts = F.array_join(F.transform("j.pages", lambda p: p["text"]), "\n")
    return read.select("file_id", F.col("j.document.total_pages").alias("pages"), F.md5(F.array_join(pairs, ";").cast("binary")).alias("tags"), F.md5(texts.cast("binary")).alias("texts"))


_ESCAPED = """replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')"""


@query(f"WITH {_PT}, e AS (SELECT file_id, page_pos, {_ESCAPED} AS x FROM t) SELECT file_id, count(*) AS sections, md5(string_agg(x, chr(10) ORDER BY page_pos)) AS texts FROM e GROUP BY file_id")
def html_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the HTML: the escaped texts of all sections."""
    made = sinks.html_documents(_by_file(spark, sf_dir, fx.page_texts(*fx.print_pages(spark, sf_dir))))
    texts = F.regexp_extract_all("html", F.lit("(?s)<pre>(.*?)</pre>"))
    return made.select("file_id", F.regexp_count("html", F.lit('<section id="page-')).cast("long").alias("sections"), F.md5(F.array_join(texts, "\n").cast("binary")).alias("texts"))


@query("""WITH b AS (SELECT l_suppkey AS file, l_linenumber * 10 AS x, CAST(floor(l_quantity) AS BIGINT) AS y, l_orderkey * 10 + l_linenumber AS id FROM lineitem)
SELECT file, arg_min(id, (abs(x - 40) + abs(y - 25)) * 1000000000000 + id) AS hit, CAST(min(abs(x - 40) + abs(y - 25)) AS BIGINT) AS far FROM b WHERE 40 BETWEEN x - 5 AND x + 29 AND 25 BETWEEN y - 5 AND y + 17 GROUP BY file""")
def hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as display-list items; the one of each file nearest to a point in it."""
    boxes = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("file_id"), F.lit(1).alias("page_pos"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offset"),
        (F.col("l_linenumber") * 10).alias("x"), F.floor("l_quantity").alias("y"), F.lit(24).alias("w"), F.lit(12).alias("h"),
    )
    items = compose.display_list(compose.object_items(boxes, "box", F.col("offset").cast("string")))
    hit = compose.hit_test(items, ["file_id"], 40, 25)
    return hit.select(F.col("file_id").alias("file"), F.col("hit.payload").cast("long").alias("hit"), (F.abs(F.col("hit.x") - 40) + F.abs(F.col("hit.y") - 25)).cast("long").alias("far"))
