"""Code pages embedded in a file's resources, and the fonts' inventory by container."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ebcdic
from .islands import carried, islands

BEGIN, END, INDEX = "D3A889", "D3A989", ("D3AC89", "D3EE89")
UNKNOWN = 0xFFFD
# Punctuation and accented letters that unmapped positions fall back to.
_EXTRA = {0x40: " ", 0x4B: ".", 0x4D: "(", 0x4E: "+", 0x50: "&", 0x5D: ")", 0x5E: ";", 0x60: "-", 0x61: "/", 0x6B: ",", 0x6C: "%", 0x6D: "_", 0x6E: ">", 0x6F: "?", 0x7A: ":", 0x7B: "#", 0x7D: "'", 0x7E: "=", 0x7F: '"', 0xB5: "@", 0xC0: "ä", 0xD0: "ü", 0xDC: "ü", 0x43: "ä", 0x59: "ß", 0xA1: "ß"}
DEFAULTS = {i: ord(c) for i, c in enumerate(ebcdic.CP037) if c.isascii() and c.isalnum()} | {i: ord(c) for i, c in _EXTRA.items()}


def index_entries(data: bytes) -> Iterator[tuple[int, int]]:
    """(byte, code point) pairs of an index: entries that begin with their length (4 to 16), or 10 bytes each from 40 on."""
    if len(data) < 2:
        return
    first = data[0]
    if 4 <= first <= 16 and len(data) >= 2 * first:
        at = 0
        while at + first <= len(data):
            size = data[at]
            if size < 4 or at + size > len(data):
                return
            point, byte = data[at + 2] << 8 | data[at + 3], data[at + 4] if size >= 5 else 0
            if byte and 0 < point < 0xFFFF:
                yield byte, point
            at += size
    elif len(data) % 10 == 0 or len(data) % 8 == 0:
        for i in range(0, len(data) - 9, 10):
            point, byte = data[i] << 8 | data[i + 1], i // 10 + 0x40
            if 0x20 <= point <= 0xFFEF and byte < 256:
                yield byte, point


def mapping(indexes: list[bytes]) -> list[int]:
    """The 256 code points that a code page's indexes and the defaults give."""
    out = [UNKNOWN] * 256
    for data in indexes:
        for byte, point in index_entries(data):
            out[byte] = point
    return [DEFAULTS.get(i, p) if p == UNKNOWN else p for i, p in enumerate(out)]


def embedded(sf: DataFrame) -> DataFrame:
    """file_id, name and mapping array<int> of the code pages; of equal names the last counts.

    Once a file has had one, none is looked for behind the beginning of a document.
    """
    rows = islands(sf.where(F.col("type_id").isin(BEGIN, END, *INDEX, "D3A8A8")), ["file_id"], ["offset"], F.col("type_id") == BEGIN).where("island > 0")
    name = F.when(F.col("type_id") == BEGIN, ebcdic.decode_name(F.substring("data", 1, 8), "tag"))
    closed = F.min(F.when(F.col("type_id") == END, F.col("offset")))
    ends = rows.groupBy("file_id", "island").agg(closed.alias("__end"), F.max(name).alias("name"))
    first_end = ends.groupBy("file_id").agg(F.min("__end").alias("__done"))
    stop = sf.where("type_id = 'D3A8A8'").join(first_end, "file_id").where("offset > __done").groupBy("file_id").agg(F.min("offset").alias("__stop"))
    good = ends.join(stop, "file_id", "left").where("__end IS NOT NULL AND name <> '' AND (__stop IS NULL OR __end < __stop)")
    held = rows.where(F.col("type_id").isin(*INDEX)).join(good, ["file_id", "island"], "right").where("offset IS NULL OR offset < __end")
    listed = held.groupBy("file_id", "name", "island").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("offset").isNotNull(), F.struct("offset", "data")))), lambda x: x["data"]).alias("indexes"))
    last = listed.groupBy("file_id", "name").agg(F.max_by("indexes", "island").alias("indexes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, names, indexes = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(names, pa.string()), pa.array([mapping(i or []) for i in indexes], pa.list_(pa.int32()))], names=["file_id", "name", "mapping"])

    return last.mapInArrow(run, "file_id string, name string, mapping array<int>")


# Weights by the last two characters of a font container's name.
_WEIGHTS = {
    "C0FL": {"60": "Light", "70": "Medium", "80": "Bold", "90": "Light Italic", "A0": "Bold Italic", "B0": "Semi-Bold", "C0": "Condensed", "E0": "Cond. Bold"},
    "C0FM": {"60": "Light", "70": "Medium", "80": "Bold", "90": "Italic", "A0": "Bold Italic", "B0": "Semi-Bold", "C0": "Condensed", "E0": "Cond. Bold", "I0": "Std Italic"},
}


def font_containers(sf: DataFrame) -> DataFrame:
    """file_id, name, type, weight, family, code_page: each font container once, as it first ends.

    The family is that of the container's last descriptor.
    """
    rows = sf.where(F.col("type_id").isin("D3A8CE", "D3A9CE", "D3A689"))
    begun = F.col("type_id") == "D3A8CE"
    name = F.when(begun & (F.length("data") >= 8), ebcdic.decode_name(F.substring("data", 1, 8), "tag"))
    boxed = islands(carried(rows, ["file_id"], ["offset"], name, "name"), ["file_id"], ["offset"], begun, "box")
    family = F.when((F.col("type_id") == "D3A689") & (F.length("data") > 10) & F.col("name").startswith("C0F"), ebcdic.decode_name(F.substring("data", 1, 32), "tag"))
    ends = carried(boxed, ["file_id", "box"], ["offset"], family, "family", F.lit("")).where("type_id = 'D3A9CE' AND (name LIKE 'C0F%' OR name LIKE 'T1%')")
    once = ends.groupBy("file_id", "name").agg(F.min_by("family", "offset").alias("family"))
    suffix = F.substring("name", -2, 2)
    weight = F.coalesce(*[F.when(F.col("name").startswith(p) & (suffix == s), w) for p, t in _WEIGHTS.items() for s, w in t.items()], F.when(F.col("name").startswith("T1"), "—"), F.lit("Regular"))
    kind = F.when(F.col("name").startswith("C0FL"), "Latin").when(F.col("name").startswith("C0FM"), "Math/Symbol").when(F.col("name").startswith("T1"), "Code Page").otherwise("Unknown")
    page = F.when(~F.col("name").startswith("T1"), "").when(F.contains("name", F.lit("1144")), "CP297 (French)").when(F.contains("name", F.lit("0500")), "CP500 (Intl)").otherwise(F.col("name"))
    return once.select("file_id", "name", kind.alias("type"), weight.alias("weight"), "family", page.alias("code_page"))


def font_families(fonts: DataFrame) -> DataFrame:
    return fonts.where("type <> 'Code Page' AND family <> ''").select("file_id", "family").distinct()
