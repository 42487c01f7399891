"""Triplets, tags and comments of structured fields."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import ebcdic
from .pages import context

TRIPLETS = "array<struct<id:int,body:binary>>"


def split_triplets(data: bytes, start: int = 0) -> list[tuple[int, bytes]]:
    """(id, bytes behind the id) of self-sized triplets; a size below 2 or beyond the end stops."""
    out, at = [], start
    while at + 2 <= len(data):
        size = data[at]
        if size < 2 or at + size > len(data):
            break
        out.append((data[at + 1], data[at + 2 : at + size]))
        at += size
    return out


def _found(data, start):
    return data.combine(start, lambda d, s: [{"id": i, "body": b} for i, b in split_triplets(bytes(d or b""), int(s))])


def triplets(data: Column, start: int = 0) -> Column:
    """array<struct<id, body>> of the data's triplets."""
    from pandas import Series

    def found(d, s):
        return _found(d, s)

    found.__annotations__ = dict.fromkeys(("d", "s", "return"), Series)
    return pandas_udf(found, TRIPLETS)(data, F.lit(start))


def last_body(found: Column, id_: int, skip: int = 0) -> Column:
    """The body (less its first bytes) of the last triplet with this id, or null."""
    some = F.filter(found, lambda t: t["id"] == id_)
    body = F.get(some, F.size(some) - 1)["body"]
    return F.substring(body, skip + 1, 1 << 30)


def _tag_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file_id, offset and the bodies of the last key (02) and value (36) triplet, less their first two bytes."""
    for batch in batches:
        keys, values = [], []
        for data in batch.column(2).to_pylist():
            key = value = None
            for kind, body in split_triplets(data or b""):
                if kind == 0x02:
                    key = body[2:]
                elif kind == 0x36:
                    value = body[2:]
            keys.append(key)
            values.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["file_id", "offset", "k", "v"])


def tags(sf: DataFrame, require_key: bool = True, policy: str = "tag") -> DataFrame:
    """file_id, offset, key and value of tag fields; require_key=False also keeps tags without a key."""
    rows = sf.where(F.col("type_id") == "D3A090").select("file_id", "offset", "data").mapInArrow(_tag_bodies, "file_id string, offset bigint, k binary, v binary")
    name = lambda c: F.coalesce(ebcdic.decode_name(F.col(c), policy), F.lit(""))
    out = rows.select("file_id", "offset", name("k").alias("key"), name("v").alias("value"))
    return out.where("key <> ''" if require_key else "key <> '' OR value <> ''")


def comments(sf: DataFrame, most_bytes: int = 256) -> DataFrame:
    """file_id, offset and text of comment fields."""
    rows = sf.where(F.col("type_id").isin("D3EEEE", "D3AFEE", "D3A8EE"))
    text = ebcdic.js_trim(ebcdic.strip_controls(ebcdic.decode(F.substring("data", 1, most_bytes))))
    return rows.select("file_id", "offset", text.alias("text")).where("text <> ''")


def with_context(sf: DataFrame, entries: DataFrame) -> DataFrame:
    """entries (file_id, offset) with page_no and context."""
    placed = context(sf.select("file_id", "offset", "type_id"), ["file_id"], ["offset"], F.col("type_id") == "D3A8AD")
    return entries.join(placed.select("file_id", "offset", "page_no", "context"), ["file_id", "offset"])


def document_level(sf: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries before the first document, resource group, container or page begins."""
    stop = sf.where(F.col("type_id").isin("D3A8A8", "D3A8C6", "D3A8CE", "D3A8AD")).groupBy("file_id").agg(F.min("offset").alias("__stop"))
    return entries.join(stop, "file_id", "left").where(F.col("__stop").isNull() | (F.col("offset") < F.col("__stop"))).drop("__stop")


def file_metadata(sf: DataFrame) -> DataFrame:
    """document_name (first document's), total_pages, file_size, n_tags and n_comments of each file."""
    kind = lambda *t: F.col("type_id").isin(*t)
    # fields are sorted for min_by(): without their payloads
    fields = sf.select("file_id", "offset", "length", "type_id", F.when(kind("D3A8A8"), F.substring("data", 1, 8)).alias("__name"))
    name = F.min_by(F.when(kind("D3A8A8"), ebcdic.decode_name(F.col("__name"), "tag")), F.when(kind("D3A8A8"), F.col("offset")))
    return fields.groupBy("file_id").agg(name.alias("document_name"), F.count_if(kind("D3A8AD")).alias("total_pages"), F.max(F.col("offset") + 1 + F.col("length")).alias("file_size"), F.count_if(kind("D3A090")).alias("n_tags"), F.count_if(kind("D3EEEE", "D3AFEE", "D3A8EE")).alias("n_comments"))


def grouping_keys(sf: DataFrame, pages: int = 3) -> DataFrame:
    """Distinct tag keys (label form, longer than one character) in each file's first pages."""
    keyed = with_context(sf, tags(sf, policy="label")).where(F.col("page_no") <= pages)
    return keyed.where(F.length("key") > 1).select("file_id", "key").distinct().orderBy("file_id", "key")


def data_preview(data: Column) -> Column:
    """The first 50 bytes as text if that gives more than 3 characters, else as ASCII with dots."""
    head = F.substring(data, 1, 50)
    text = ebcdic.js_trim(ebcdic.decode_name(head, "tag"))
    ascii_ = F.regexp_replace(F.decode(head, "ISO-8859-1"), "[^\\x20-\\x7E]", ".")
    return F.when(F.length(text) > 3, text).otherwise(ascii_)


def page_sequence(data: Column) -> Column:
    """The number in the last triplet 62, or null."""
    body = last_body(triplets(data), 0x62)
    return F.conv(F.hex(body), 16, 10).cast("long")


def resource_names(data: Column) -> Column:
    """Names in fully-qualified-name triplets."""
    return F.transform(F.filter(triplets(data), lambda t: t["id"] == 2), lambda t: ebcdic.decode_name(F.substring(t["body"], 3, 1 << 30), "group"))


def coded_fonts(sf: DataFrame) -> DataFrame:
    """Rows of map-coded-font fields: file_id, offset, local_id, coded_font, char_set, bold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_id", "offset", "local_id", "coded_font", "char_set"]
        for batch in batches:
            rows = []
            for file, offset, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for local, font, chars in font_groups(data or b""):
                    rows.append((file, offset, local, font, chars))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    raw = sf.where(F.col("type_id") == "D3AB8A").select("file_id", "offset", "data").mapInArrow(run, "file_id string, offset bigint, local_id int, coded_font binary, char_set binary")
    name = lambda c: F.coalesce(ebcdic.decode_name(F.col(c), "tag"), F.lit(""))
    out = raw.select("file_id", "offset", "local_id", name("coded_font").alias("coded_font"), name("char_set").alias("char_set"))
    return out.withColumn("bold", is_bold(F.col("char_set")))


def font_groups(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(local id, coded font, character set) of each repeating group."""
    at = 0
    while at + 2 <= len(data):
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 4 or at + size > len(data):
            return
        local, font, chars = None, b"", b""
        for kind, body in split_triplets(data[at : at + size], 2):
            if kind == 0x24 and len(body) >= 2:
                local = body[1]
            elif kind == 0x02 and len(body) >= 2 and body[0] == 0x85:
                font = body[2:]
            elif kind == 0x02 and len(body) >= 2 and body[0] == 0x86:
                chars = body[2:]
        if local is not None:
            yield local, font, chars
        at += size


def is_bold(char_set: Column) -> Column:
    """The fourth letter tells the weight: M, B and H are bold."""
    return F.upper(F.substring(char_set, 4, 1)).isin("M", "B", "H")
