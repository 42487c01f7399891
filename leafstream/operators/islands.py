"""Runs of rows between boundaries, and latest-value carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.wire import joined


def islands(rows: DataFrame, keys: list[str], order: list[str], boundary: Column, number: str = "island") -> DataFrame:
    """Numbers the runs that begin at boundary rows; rows before the first boundary get 0."""
    return rows.withColumn(number, F.sum(boundary.cast("long")).over(Window.partitionBy(*keys).orderBy(*order)))


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, default: Column | None = None) -> DataFrame:
    """The last value that isn't null, up to the row."""
    last = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(name, last if default is None else F.coalesce(last, default))


def begin_end_islands(sf: DataFrame, begin: str, end: str, payload: list[str], name: Column) -> DataFrame:
    """file_id, begin_offset, name and data (payloads in order) of every begin-to-end run of fields."""
    rows = sf.where(F.col("type_id").isin(begin, end, *payload))
    # windows over one order: a run's place is its begin, and it is closed by an end behind that and before the row
    at = Window.partitionBy("file_id").orderBy("offset")
    last = lambda kind, upto: F.last(F.when(F.col("type_id") == kind, F.col("offset")), ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, upto))
    rows = rows.withColumns({"begin_offset": last(begin, 0), "__end": last(end, -1)}).where("begin_offset IS NOT NULL AND (__end IS NULL OR __end < begin_offset)")
    inside = rows.withColumn("__name", F.when(F.col("type_id") == begin, name))
    chunks = F.transform(F.array_sort(F.collect_list(F.when(F.col("type_id").isin(*payload), F.struct("offset", "data")))), lambda x: x["data"])
    return inside.groupBy("file_id", "begin_offset").agg(F.max("__name").alias("name"), joined(chunks).alias("data"))


def document_groups(pages: DataFrame, keys: list[str], page_pos: str, label: str) -> DataFrame:
    """label, start_page, end_page: every page with a label begins a group, also one of the same value.

    Pages before the first label belong to no group.
    """
    numbered = islands(pages, keys, [page_pos], F.col(label).isNotNull()).where("island > 0")
    return numbered.groupBy(*keys, "island").agg(F.min_by(label, page_pos).alias("label"), F.min(page_pos).alias("start_page"), F.max(page_pos).alias("end_page"))


def page_labels(tags: DataFrame, pages: DataFrame, key: str, back: int = 5000) -> DataFrame:
    """pages with label: the last value of the key from up to back bytes before the page (not before the
    end of the page before) to the page's end."""
    end = F.col("byte_offset") + F.col("byte_length")
    reach = pages.withColumn("__from", F.greatest(F.col("byte_offset") - back, F.coalesce(F.lag(end).over(Window.partitionBy("file_id").orderBy("byte_offset")), F.lit(0))))
    reach = reach.withColumn("__len", end - F.col("__from"))
    from .asof import interval_join

    found = interval_join(tags.where(F.col("key") == key), reach, ["file_id"], "offset", "__from", "__len", ["page_pos"]).where("page_pos IS NOT NULL")
    last = found.groupBy("file_id", "page_pos").agg(F.max_by("value", "offset").alias("label"))
    return pages.join(last, ["file_id", "page_pos"], "left")
