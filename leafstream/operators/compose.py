"""Page composition: objects of a page as one display list, page and thumbnail sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import js_round

LARGEST = 16384
COLUMNS = ["file_id", "page_pos", "z", "kind", "x", "y", "w", "h", "payload"]


def canvas(width: Column, height: Column, resolution: Column, dpi: float = 96, zoom: float = 1.0) -> dict[str, Column]:
    """Canvas size in pixels, 1 to LARGEST."""
    side = lambda v: F.greatest(F.lit(1), F.least(F.lit(LARGEST), js_round(v / resolution * dpi * zoom)))
    return {"canvas_width": side(width), "canvas_height": side(height)}


def thumbnail_scale(width: Column, height: Column, most_width: int = 120, most_height: int = 170) -> Column:
    """Fits into the box; never enlarges."""
    return F.least(F.lit(1.0), most_width / width, most_height / height)


def image_box(pels_x: Column, pels_y: Column, resolution: Column, scale: Column) -> dict[str, Column]:
    """An image's size on the page in units of 1/1440 inch."""
    return {"w": pels_x * scale * 1440 / resolution, "h": pels_y * scale * 1440 / resolution}


def text_items(runs: DataFrame) -> DataFrame:
    style = F.to_json(F.struct("text", "font_size", "bold", "underline", "orientation", "r", "g", "b"))
    return runs.select("file_id", "page_pos", F.col("offset").alias("z"), F.lit("text").alias("kind"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.length("text") * 120).cast("double").alias("w"), F.lit(240.0).alias("h"), style.alias("payload"))


def object_items(objects: DataFrame, kind: str, payload: Column) -> DataFrame:
    """objects: file_id, page_pos, offset, x, y, w, h."""
    return objects.select("file_id", "page_pos", F.col("offset").alias("z"), F.lit(kind).alias("kind"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")], payload.alias("payload"))


def display_list(*items: DataFrame) -> DataFrame:
    """All items of a page, in document order of the objects that made them."""
    return reduce(DataFrame.unionByName, [i.select(*COLUMNS) for i in items])


def hit_test(items: DataFrame, keys: list[str], x: float, y: float, margin: float = 5) -> DataFrame:
    """The item of each page nearest (sum of distances to its corner) among those around the point."""
    inside = F.lit(x).between(F.col("x") - margin, F.col("x") + F.col("w") + margin) & F.lit(y).between(F.col("y") - margin, F.col("y") + F.col("h") + margin)
    far = F.abs(F.col("x") - x) + F.abs(F.col("y") - y)
    return items.where(inside).groupBy(*keys).agg(F.min_by(F.struct("kind", "x", "y", "payload"), F.struct(far, "z")).alias("hit"))
