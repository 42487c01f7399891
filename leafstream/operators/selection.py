"""Page selections (file_id, page_pos) as relations, and the element behind a place on a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["file_id", "page_pos"]


def between(pages: DataFrame, first: int, last: int) -> DataFrame:
    """The pages from one to another, in either order."""
    return pages.where(F.col("page_pos").between(min(first, last), max(first, last))).select(*KEY)


def everything(pages: DataFrame) -> DataFrame:
    return pages.select(*KEY)


def inverted(pages: DataFrame, selected: DataFrame) -> DataFrame:
    return pages.select(*KEY).join(selected, KEY, "left_anti")


def toggled(selected: DataFrame, change: DataFrame) -> DataFrame:
    """Pages in just one of the two."""
    return selected.join(change, KEY, "left_anti").unionByName(change.join(selected, KEY, "left_anti"))


def page_elements(tree: DataFrame, pages: DataFrame) -> DataFrame:
    """pages with the tree node that starts where they do."""
    return pages.join(tree.select("file_id", F.col("offset").alias("byte_offset"), "sf_no", "depth", "parent"), ["file_id", "byte_offset"], "left")


def nth_field(sf: DataFrame, pages: DataFrame, types: list[str], n: int) -> DataFrame:
    """file_id, page_pos and offset of each page's n-th field (from 0) of some types."""
    from .asof import interval_join

    inside = interval_join(sf.where(F.col("type_id").isin(types)).select("file_id", "offset"), pages, ["file_id"], "offset", "byte_offset", "byte_length", ["page_pos"]).where("page_pos IS NOT NULL")
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("offset"))
    return inside.withColumn("__n", number).where(F.col("__n") == n + 1).select(*KEY, "offset")
