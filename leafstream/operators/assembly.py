"""Page assembly: the fields of a page to its objects, in one pass of windows.

A page's fields between a begin and whatever ends it are one object.  Implicit flush: a begin of any kind
ends the object that is open, as do its own end and the page's end; fields outside an object belong to
none, but text payloads without a begin open a text object.  Each object has the payloads of its kind in
order, its descriptor, the last object position at or before its end, and the sizes of its kind where
nothing tells (images: their descriptor's; barcodes: 2880 by 1440).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ebcdic
from ..sources.wire import joined
from .asof import interval_join
from .resources import object_position

# Begin and end types of the object kinds, their payloads and descriptors.
BEGINS = {"D3A89B": "text", "D3A87B": "text", "D3A8FB": "image", "D3A8BB": "graphics", "D3A8EB": "barcode"}
ENDS = ("D3A99B", "D3A97B", "D3A9FB", "D3A9BB", "D3A9EB")
PAYLOADS = {"text": ("D3EE9B", "D3EE6B"), "image": ("D3EEFB",), "graphics": ("D3EEBB", "D3EECC")}
DESCRIPTORS = ("D3A6FB", "D3ACCE", "D3A6BB", "D3A6EB", "D3AEEB", "D3A69B")
POSITION = "D3AC6B"
#: Barcodes without a size, in L-units.
BARCODE_W, BARCODE_H = 2880, 1440


def _is_payload(kind: Column, type_id: Column) -> Column:
    """Any data field inside a barcode is its data."""
    listed = F.lit(False)
    for k, types in PAYLOADS.items():
        listed = listed | ((kind == k) & type_id.isin(*types))
    return listed | ((kind == "barcode") & type_id.startswith("D3EE"))


def page_objects(sf: DataFrame, pages: DataFrame) -> DataFrame:
    """file_id, page_pos, object_no, kind, offset (of the object's last field), x, y, w, h, descriptor, data."""
    t = F.col("type_id")
    kinds = F.coalesce(*[F.when(t == b, k) for b, k in BEGINS.items()])
    rows = sf.where(t.isin(*BEGINS, *ENDS, *DESCRIPTORS, POSITION) | t.startswith("D3EE")).select("file_id", "offset", "type_id", "data")
    rows = interval_join(rows, pages, ["file_id"], "offset", "byte_offset", "byte_length", ["page_pos"]).where("page_pos IS NOT NULL")
    page = Window.partitionBy("file_id", "page_pos").orderBy("offset")
    place = object_position(F.col("data"))
    mark = F.when(kinds.isNotNull(), kinds).when(t.isin(*ENDS), "")
    rows = rows.withColumns({"__mark": mark, "__at": F.when(t == POSITION, F.struct(*[c.alias(n) for n, c in place.items()]))})
    rows = rows.withColumns({"__open": F.last("__mark", ignorenulls=True).over(page), "__place": F.last("__at", ignorenulls=True).over(page)})
    # text outside any object begins one that ends as others do
    stray = t.isin(*PAYLOADS["text"]) & (F.coalesce("__open", F.lit("")) == "")
    rows = rows.withColumn("kind", F.when(stray, "text").otherwise(F.nullif("__open", F.lit(""))))
    starts = (kinds.isNotNull() | (stray & (F.coalesce(F.lag("kind").over(page), F.lit("")) != "text"))).cast("long")
    rows = rows.withColumn("object_no", F.sum(starts).over(page)).where("kind IS NOT NULL AND object_no > 0")
    chunks = F.transform(F.array_sort(F.collect_list(F.when(_is_payload(F.col("kind"), t), F.struct("offset", "data")))), lambda c: c["data"])
    objects = rows.groupBy("file_id", "page_pos", "object_no", "kind").agg(
        F.max("offset").alias("offset"), F.max_by("__place", F.when(F.col("__place").isNotNull(), F.col("offset"))).alias("__place"),
        F.max_by("data", F.when(t.isin(*DESCRIPTORS), F.col("offset"))).alias("descriptor"), joined(chunks).alias("data"),
    )
    u16 = lambda i: F.conv(F.hex(F.substring("descriptor", i + 1, 2)), 16, 10).cast("long")
    told = lambda v: F.when(v > 0, v)
    at = lambda c: F.col(f"__place.{c}")
    # an image descriptor gives its size in field 94 behind the 6-byte header
    sized = F.when((F.col("kind") == "image") & (F.length("descriptor") >= 12) & (F.hex(F.substring("descriptor", 8, 1)) == "94"), F.struct(u16(8).alias("w"), u16(10).alias("h")))
    usual = lambda barcode: F.when(F.col("kind") == "barcode", barcode).when(F.col("kind") == "image", 1)
    return objects.withColumn("__sized", sized).select(
        "file_id", "page_pos", "object_no", "kind", "offset", F.coalesce(at("x"), F.lit(0)).cast("long").alias("x"), F.coalesce(at("y"), F.lit(0)).cast("long").alias("y"),
        F.coalesce(told(at("w")), told(F.col("__sized.w")), usual(BARCODE_W)).cast("long").alias("w"), F.coalesce(told(at("h")), told(F.col("__sized.h")), usual(BARCODE_H)).cast("long").alias("h"), "descriptor", "data",
    )


def barcode_text(data: Column) -> Column:
    """A barcode's data as text: decoded without control characters, or as ASCII if that leaves nothing."""
    text = ebcdic.strip_controls(ebcdic.decode(data))
    return F.when(F.length(ebcdic.js_trim(text)) > 0, text).otherwise(F.regexp_replace(F.decode(data, "ISO-8859-1"), "[^\\x20-\\x7E]", ""))


#: Types whose content may be edited in place.
EDITABLE = ("D3A090", "D3EEEE", "D3EE9B")


def editable(type_id: Column) -> Column:
    return type_id.isin(*EDITABLE)
