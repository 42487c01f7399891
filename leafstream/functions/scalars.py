"""Scalar functions of the engine as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Half up toward positive infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def be_uint(data: Column, offset: int, size: int) -> Column:
    """Unsigned big-endian number of size bytes at a 0-based offset; 0 where the data ends before."""
    value = F.conv(F.hex(F.substring(data, offset + 1, size)), 16, 10).cast("long")
    return F.when(F.length(data) >= offset + size, value).otherwise(F.lit(0).cast("long"))


def be_int16(data: Column, offset: int) -> Column:
    value = be_uint(data, offset, 2)
    return F.when(value >= 32768, value - 65536).otherwise(value)


def once(value: Column, use) -> Column:
    """use(value), with value computed once a row also where use has it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trigrams(text: Column) -> Column:
    """The distinct trigrams; a text of up to two characters stands for itself, an empty one has none.

    Works on an array of characters: substring() would count from the text's start each time.
    """
    grams = lambda c: F.array_distinct(F.transform(F.slice(c, 1, F.size(c) - 2), lambda x, i: F.concat(x, F.get(c, i + 1), F.get(c, i + 2))))
    n = F.length(text)
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= 2, F.array(text)).otherwise(once(F.split(text, ""), grams))


def positions(text: Column, query: str) -> Column:
    """0-based places of all, also overlapping, occurrences; by an array of characters, in time that grows with the text."""
    m = len(query)
    if not m:
        return F.array().cast("array<int>")
    width = lambda c: F.greatest(F.size(c) - m + 1, F.lit(0))
    first = query[0]
    starts = lambda c: F.filter(F.transform(F.slice(c, 1, width(c)), lambda x, i: F.when((x == first) & (F.array_join(F.slice(c, i + 1, m), "") == query), i)), lambda i: i.isNotNull())
    return F.when(F.length(text) >= m, once(F.split(text, ""), starts)).otherwise(F.array().cast("array<int>"))


def snippet(text: Column, at: Column, length: int, around: int = 30) -> Column:
    """The text around a match, with '...' where it is cut."""
    start = F.greatest(at - around, F.lit(0))
    end = F.least(at + length + around, F.length(text))
    return F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "...").otherwise(""))


def format_size(size: Column) -> Column:
    """Bytes as B, KB or MB; one decimal, halves up."""
    kb, mb = size / 1024.0, size / 1048576.0
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1048576, F.concat(_one_decimal(kb), F.lit(" KB"))).otherwise(F.concat(_one_decimal(mb), F.lit(" MB")))


def _one_decimal(x: Column) -> Column:
    tenths = F.floor(x * 10 + F.lit(0.5)).cast("long")
    return F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, "(?i)\\.afp\\d?$", "")


def part_name(stem: Column, number: Column, total: Column) -> Column:
    """Parts are numbered with leading zeros, as wide as the last number and three digits at least."""
    return F.concat(stem, F.lit("_part"), F.lpad(number.cast("string"), F.greatest(F.length(total.cast("string")), F.lit(3)), "0"))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[/\\\\:\\x00]", "_")


def page_ranges(text: Column, most: int = 10_000) -> Column:
    """'1-3, 7' to sorted distinct page numbers; null if a part is malformed or spans too much."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    low = lambda p: F.try_to_number(F.regexp_extract(p, "^(\\d{1,9})", 1), F.lit("999999999")).cast("int")
    high = lambda p: F.try_to_number(F.coalesce(F.nullif(F.regexp_extract(p, "-\\s*(\\d{1,9})$", 1), F.lit("")), F.regexp_extract(p, "^(\\d{1,9})", 1)), F.lit("999999999")).cast("int")
    good = lambda p: p.rlike("^\\d{1,9}(\\s*-\\s*\\d{1,9})?$") & (F.coalesce(low(p), F.lit(0)) >= 1) & (F.coalesce(high(p), F.lit(0)) >= F.coalesce(low(p), F.lit(1))) & (F.coalesce(high(p), F.lit(0)) - F.coalesce(low(p), F.lit(0)) <= most)
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p))))))
    return F.when(F.forall(parts, good), pages)


def to_pixels(units: Column, resolution: Column | float, dpi: float = 96, zoom: float = 1.0) -> Column:
    return js_round(units / resolution * F.lit(float(dpi)) * F.lit(float(zoom)))


def to_points(units: Column, resolution: Column | float) -> Column:
    return units / resolution * 72


def clamp_zoom(percent: Column) -> Column:
    return F.least(F.greatest(percent, F.lit(10)), F.lit(500))


def orientation_from_degrees(degrees: Column) -> Column:
    """To 0, 90, 180 or 270: the nearest, 45 degrees up going to the next."""
    turned = F.pmod(degrees, F.lit(360))
    return F.when((turned >= 315) | (turned < 45), 0).when(turned < 135, 90).when(turned < 225, 180).otherwise(270)


def css_color(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("rgb(%d,%d,%d)", r.cast("int"), g.cast("int"), b.cast("int"))


def image_kind(data: Column) -> Column:
    """The image format that the first bytes tell, or null."""
    starts = lambda h: F.hex(F.substring(data, 1, len(h) // 2)) == h
    return (
        F.when(starts("FFD8"), "jpeg").when(starts("89504E47"), "png").when(starts("474946"), "gif").when(starts("424D"), "bmp")
        .when(starts("49492A00") | starts("4D4D002A"), "tiff").when(starts("25504446"), "pdf")
    )


def estimated_pages(size: Column, per_page: int = 4096) -> Column:
    return F.greatest(F.lit(1), js_round(size / per_page))
