"""As-of and interval joins as unions and windows: sort-based, no range comparison of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _merged(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: list[str], right_first: bool) -> DataFrame:
    payload = F.struct(*left.columns)
    carried = F.struct(F.col(right_at).alias("__at"), *value)
    a = left.select(*keys, F.col(left_at).alias("__o"), F.lit(1 if right_first else 0).alias("__s"), payload.alias("__l"), F.lit(None).cast(_kind(right, carried)).alias("__r"))
    b = right.select(*keys, F.col(right_at).alias("__o"), F.lit(0 if right_first else 1).alias("__s"), F.lit(None).cast(_kind(left, payload)).alias("__l"), carried.alias("__r"))
    return a.unionByName(b)


def _kind(df: DataFrame, column) -> str:
    return df.select(column.alias("x")).schema["x"].dataType.simpleString()


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: list[str], strict: bool = False) -> DataFrame:
    """left with the values of the last right row at or before it (strict: before it)."""
    merged = _merged(left, right, keys, left_at, right_at, value, right_first=not strict)
    by = Window.partitionBy(*keys).orderBy("__o", "__s").rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn("__r", F.last("__r", ignorenulls=True).over(by)).where("__l IS NOT NULL").select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in value], F.col("__r.__at").alias("matched_at"))


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: list[str], strict: bool = True) -> DataFrame:
    """left with the values of the first right row after it (not strict: at or after it)."""
    merged = _merged(left, right, keys, left_at, right_at, value, right_first=strict)
    # in the other order: a frame that runs to the key's end would be computed again for each row
    by = Window.partitionBy(*keys).orderBy(F.desc("__o"), F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn("__r", F.last("__r", ignorenulls=True).over(by)).where("__l IS NOT NULL").select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in value], F.col("__r.__at").alias("matched_at"))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, length: str, value: list[str]) -> DataFrame:
    """points with the values of the interval [start, start + length) that holds them, else null.

    Intervals of a key don't overlap, so the last one that starts at or before a point decides.
    """
    found = asof_backward(points, intervals.withColumn("__len", F.col(length)), keys, at, start, [*value, "__len"])
    inside = F.col(at) < F.col("matched_at") + F.col("__len")
    return found.select(*points.columns, *[F.when(inside, F.col(c)).alias(c) for c in value])


def tag_pages(tags: DataFrame, pages: DataFrame, keys: list[str], at: str = "offset", start: str = "byte_offset", length: str = "byte_length", page: str = "page_pos") -> DataFrame:
    """Tags with their page: the page around them, else the next page, else the last."""
    merged = _merged(tags, pages.select(*keys, start, length, page).withColumn("__len", F.col(length)), keys, at, start, [page, "__len"], right_first=True)
    # tags and pages are dealt out once: both neighbours and the last page are windows over them
    last = lambda *order: F.last("__r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    seen = merged.withColumns({"__before": last("__o", "__s"), "__last": F.max(F.struct("__r.__at", f"__r.{page}")).over(Window.partitionBy(*keys)), "__next": last(F.desc("__o"), F.desc("__s"))})
    held = F.when(F.col("__o") < F.col("__before.__at") + F.col("__before.__len"), F.col(f"__before.{page}"))
    return seen.where("__l IS NOT NULL").select("__l.*", F.coalesce(held, F.col(f"__next.{page}"), F.col(f"__last.{page}")).alias(page))
