"""Encoders: rows to structured fields, in Catalyst (binary concatenation only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ebcdic
from ..functions.scalars import once

BDT, EDT, BPG, EPG, BNG, ENG = "D3A8A8", "D3A9A8", "D3A8AD", "D3A9AD", "D3ABCA", "D3A9CA"
BPT, EPT, PTX, TLE, NOP = "D3A89B", "D3A99B", "D3EE9B", "D3A090", "D3EEEE"
CONTROL_BYTES, CONTROLS_A_FIELD = 250, 100


def hexed(value: str) -> Column:
    return F.unhex(F.lit(value))


def number(value: Column, size: int) -> Column:
    """An unsigned number in size big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def joined(parts: Column) -> Column:
    """An array of binaries as one binary (through Latin-1 strings: a chain of concat() would copy all before each time)."""
    return F.encode(F.array_join(F.transform(parts, lambda b: F.decode(b, "ISO-8859-1")), ""), "ISO-8859-1")


def field(type_id: str | Column, data: Column | None = None) -> Column:
    """A structured field with this data."""
    data = F.lit(b"") if data is None else data
    kind = hexed(type_id) if isinstance(type_id, str) else F.unhex(type_id)
    return F.concat(hexed("5A"), number(F.length(data) + 8, 2), kind, hexed("000000"), data)


def name8(name: Column, page: str = "cp037") -> Column:
    """A name of 8 bytes, padded with blanks or cut."""
    return ebcdic.encode(F.rpad(name, 8, " "), page)


def tag(key: Column, value: Column) -> Column:
    """A tag field: key triplet 02 and value triplet 36."""
    k, v = ebcdic.encode(key), ebcdic.encode(value)
    data = F.concat(number(F.length(k) + 4, 1), hexed("020B00"), k, number(F.length(v) + 4, 1), hexed("360000"), v)
    return field(TLE, data)


def text_fields(data: Column) -> Column:
    """Text bytes as fields: one chain of controls of at most 250 bytes, 100 controls a field."""
    per_field = CONTROL_BYTES * CONTROLS_A_FIELD

    def fields(whole: Column) -> Column:
        n = F.length(whole)
        control = lambda i: once(F.substring(whole, i, CONTROL_BYTES), lambda c: F.concat(number(F.length(c) + 2, 1), hexed("DB"), c))
        within = lambda j: F.sequence(j, F.least(j + per_field - CONTROL_BYTES, n), F.lit(CONTROL_BYTES))
        prefix = lambda j: F.when(j == 1, hexed("2BD3")).otherwise(F.lit(b""))
        one = lambda j: once(F.concat(prefix(j), joined(F.transform(within(j), control))), lambda d: field(PTX, d))
        return F.when(n > 0, joined(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(per_field)), one))).otherwise(F.lit(b""))

    return once(data, fields)


def page(tags: list[tuple[str, Column]], text: Column, code_page: str = "cp037") -> Column:
    """A page with tags and one text block."""
    return F.concat(field(BPG), *[tag(F.lit(k), v) for k, v in tags], field(BPT), text_fields(ebcdic.encode(text, code_page)), field(EPT), field(EPG))


def file_content(pages: DataFrame, keys: list[str], order: list[str], page_column: str, name: Column) -> DataFrame:
    """keys and content: a document named name around the pages of a key, in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(page_column).alias("__p")))), lambda x: x["__p"])
    return pages.groupBy(*keys).agg(joined(ordered).alias("__pages")).select(*keys, F.concat(field(BDT, name8(name)), "__pages", field(EDT)).alias("content"))
