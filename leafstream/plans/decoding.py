"""Queries that encode rows of the driver's tables as print-stream bytes and decode them again; their SQL works on the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ebcdic, scalars
from ..operators import barcodes, codepages, compose, diagnostics, graphics, images, islands, nesting, pages, ptoca, resources, selection, surgery, tags
from ..sources import framing, wire
from ..sources.type_dim import is_begin, is_end
from ..sources.wire import field, hexed, name8, number
from . import fixtures as fx
from .registry import longs, query


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.dealt(spark, sf_dir, "part", "p_partkey")


def _long(df: DataFrame) -> DataFrame:
    """Whole numbers as longs, as the SQL has them."""
    return df.select(*[F.col(f"`{f.name}`").cast("long").alias(f.name) if f.dataType.simpleString() in ("int", "smallint", "tinyint") else F.col(f"`{f.name}`") for f in df.schema.fields])


def _names(made: DataFrame, columns: dict[str, Column], *keys: str) -> DataFrame:
    return _long(made.select(*keys, *[c.alias(n) for n, c in columns.items()]))


# ---- text controls


def _control(kind: str, data: Column | None = None) -> Column:
    """A chained control: length, type, parameters."""
    data = F.lit(b"") if data is None else data
    return F.concat(number(F.length(data) + 2, 1), hexed(kind), data)


def _escape(kind: str, data: Column | None = None) -> Column:
    """An escape control: 2B, type, length, parameters."""
    data = F.lit(b"") if data is None else data
    return F.concat(hexed("2B" + kind), number(F.length(data) + 1, 1), data)


def _u16(value: Column | int) -> Column:
    return number(F.lit(value) if isinstance(value, int) else value, 2)


def _size() -> Column:
    return F.col("p_size")


def _rgb() -> Column:
    return F.concat(*[number(_size() + i, 1) for i in range(3)])


def _keyed() -> Column:
    return F.concat(F.lit("P"), F.col("p_partkey").cast("string"))


_RUN = ["p_partkey", "run_no", "x", "y", "text", "font_id", "font_size", "bold", "orientation", "r", "g", "b"]


@query(longs("""WITH p AS (SELECT *, p_size % 7 IN (0, 3) AS h, 'P' || p_partkey AS t2 FROM part)
SELECT p_partkey, 0 AS run_no, p_size * 10 AS x, 200 + p_size AS y, p_brand AS text, p_size % 7 AS font_id, 10.0::DOUBLE AS font_size, h AS bold, 0 AS orientation, p_size AS r, p_size + 1 AS g, p_size + 2 AS b FROM p
UNION ALL SELECT p_partkey, 1, p_size * 20, 200 + 2 * p_size, t2, p_size % 7, 10.0, h, 0, p_size, p_size + 1, p_size + 2 FROM p
UNION ALL SELECT p_partkey, 2, p_size * 20 + CAST(floor(length(t2) * (10.0::DOUBLE / 72) * 300 * (CASE WHEN h THEN 0.48::DOUBLE ELSE 0.42::DOUBLE END) + 0.5) AS BIGINT), 200 + 2 * p_size, p_name || p_brand, p_size % 7, 6.0, FALSE, 90, p_size, p_size + 1, p_size + 2 FROM p""", "run_no x y font_id orientation r g b"))
def text_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained controls: places, steps, fonts (bold by the page's fonts), colors, a rotated run that goes on."""
    data = F.concat(
        hexed("2BD3"), _control("C7", _u16(_size() * 10)), _control("D2", _u16(_size() + 200)), _control("F1", number(_size() % 7, 1)), _control("80", _rgb()), _control("DB", ebcdic.encode(F.col("p_brand"))),
        _control("D3", _u16(_size())), _control("D8"), _control("C0", _u16(_size() * 20)), _control("DB", ebcdic.encode(_keyed())), _control("F6", hexed("2D00")),
        _control("DB", ebcdic.encode(F.col("p_name"))), _control("C5", hexed("00")), _control("DB", ebcdic.encode(F.col("p_brand"))),
    )
    blocks = _part(spark, sf_dir).select("p_partkey", data.alias("data"), F.array(F.lit(0), F.lit(3)).alias("bold_ids"))
    return _long(ptoca.text_runs(blocks, bold_fonts="bold_ids").select(*_RUN))


@query(longs("""SELECT p_partkey, 0 AS run_no, p_size * 10 AS x, p_size + 200 AS y, p_brand || ' unicode' AS text, 0 AS font_id, 24.0::DOUBLE AS font_size, FALSE AS bold, 0 AS orientation, 79 AS r, 182 AS g, 224 AS b FROM part
UNION ALL SELECT p_partkey, 1, p_size * 10, p_size + 200, 'é' || p_partkey, 0, 24.0, FALSE, 0, p_size, p_size + 1, p_size + 2 FROM part
UNION ALL SELECT p_partkey, 2, p_size, 9, 'end', 0, 10.0, TRUE, 0, 0, 0, 0 FROM part""", "run_no x y font_id orientation r g b"))
def text_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UTF-16 dialect, told by its first text; styles set size, weight and color."""
    wide = lambda t: F.encode(t, "UTF-16BE")
    data = F.concat(
        hexed("2BD3"), _control("C7", _u16(_size() * 10)), _control("D3", _u16(_size() + 200)), _control("F1", hexed("02")), _control("DB", wide(F.concat("p_brand", F.lit(" unicode")))),
        _control("E5", hexed("0101")), _control("80", _rgb()), _control("DB", wide(F.concat(F.lit("\u0007é"), F.col("p_partkey").cast("string")))),
        _control("C7", _u16(_size())), _control("D3", _u16(9)), _control("F1", hexed("01")), _control("DB", wide(F.lit("end"))),
    )
    return _long(ptoca.text_runs(_part(spark, sf_dir).select("p_partkey", data.alias("data"))).select(*_RUN))


@query(longs("""WITH p AS (SELECT *, p_size * 10 - 5 AS x0 FROM part)
SELECT p_partkey, 0 AS run_no, 0 AS x, 0 AS y, 'AB' AS text, 0 AS font_id, 12.0::DOUBLE AS font_size, FALSE AS bold, 0 AS orientation, 0 AS r, 0 AS g, 0 AS b, NULL::BIGINT AS rule_length, NULL::BIGINT AS rule_width, FALSE AS vertical FROM p
UNION ALL SELECT p_partkey, 1, x0, 307, p_brand, p_size % 7, 12.0, FALSE, 0, p_size, p_size + 1, p_size + 2, NULL, NULL, FALSE FROM p
UNION ALL SELECT p_partkey, 2, 0, 357, '', p_size % 7, 0.0, FALSE, 0, p_size, p_size + 1, p_size + 2, 200, 3, FALSE FROM p
UNION ALL SELECT p_partkey, 3, 200, 357, '', p_size % 7, 0.0, FALSE, 0, p_size, p_size + 1, p_size + 2, 90, 2, TRUE FROM p
UNION ALL SELECT p_partkey, 4, 200, 357, '***', p_size % 7, 12.0, FALSE, 0, p_size, p_size + 1, p_size + 2, NULL, NULL, FALSE FROM p
UNION ALL SELECT p_partkey, 5, 560, 357, 'Z', p_size % 7, 12.0, FALSE, 90, 255, 0, 0, NULL, NULL, FALSE FROM p
UNION ALL SELECT p_partkey, 6, 680, 357, 'END', p_size % 7, 12.0, FALSE, 90, 9, 9, 9, NULL, NULL, FALSE FROM p""", "run_no x y font_id orientation r g b"))
def text_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The escape dialect: absolute and relative moves, line steps, colors, rules, repeats, both forms of framing."""
    text = lambda t: ebcdic.encode(F.lit(t) if isinstance(t, str) else t)
    data = F.concat(
        text("AB"), _escape("C0", _u16(_size() * 10)), _escape("D2", _u16(300)), _escape("C8", hexed("FFFB")), _escape("D4", hexed("0007")), _escape("80", F.concat(hexed("0001"), _rgb())), _escape("10", number(_size() % 7, 1)),
        _escape("DA", text(F.col("p_brand"))), _escape("D0", _u16(50)), _escape("D8"), _escape("E4", hexed("00C80003")), _escape("E6", hexed("005A0002")), _escape("EE", F.concat(_u16(3), text("*"))), _escape("F8", hexed("0000")),
        _escape("80", hexed("02")), _escape("F6", hexed("00B40000")), hexed("2BD3"), _u16(4), hexed("DA"), text("Z"), _escape("80", hexed("0004090000")), text("END"),
    )
    return _long(ptoca.text_runs(_part(spark, sf_dir).select("p_partkey", data.alias("data"))).select(*_RUN, "rule_length", "rule_width", "vertical"))


# ---- images


def _hex_of(pixel: str, n: str) -> str:
    return f"array_to_string([{pixel} FOR i IN range(0, {n})], '')"


@query(f"""WITH p AS (SELECT *, 3 + p_size % 5 AS w, 4 AS h FROM part), x AS (SELECT p_partkey, w, h, CASE p_size % 4
WHEN 0 THEN {_hex_of("printf('%02X%02X%02XFF', (i * 7 + p_size) % 256, (i * 7 + p_size) % 256, (i * 7 + p_size) % 256)", "w * h")}
WHEN 1 THEN {_hex_of("printf('%02X%02X%02XFF', (i * 21 + p_size) % 256, (i * 21 + 7 + p_size) % 256, (i * 21 + 14 + p_size) % 256)", "w * h")}
WHEN 2 THEN {_hex_of("CASE WHEN (i // w * 3 + i % w + p_size) % 3 = 0 THEN '000000FF' ELSE 'FFFFFFFF' END", "w * h")}
ELSE {_hex_of("CASE WHEN (i // w * 3 + i % w + p_size) % 3 = 0 THEN '000000FF' ELSE 'FFFFFFFF' END", "w * h")} END AS s FROM p)
SELECT p_partkey, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height, md5(s) AS pixels FROM x""")
def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray, RGB, one-bit and fax images by their descriptors: decoded to RGBA."""
    kind = _size() % 4
    depth = F.when(kind < 2, hexed("039608")).otherwise(hexed("039601"))
    model = F.when(kind == 1, hexed("04970001")).when(kind == 0, hexed("04970003")).otherwise(hexed("04970000"))
    described = F.concat(hexed("000000F000F0"), hexed("0694"), _u16(_size() % 5 + 3), _u16(4), F.when(kind == 3, hexed("039502")).otherwise(hexed("039500")), depth, model)
    made = _part(spark, sf_dir).select("p_partkey", "p_size", described.alias("described"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for size in batch.column(1).to_pylist():
                w, h = 3 + size % 5, 4
                bits = (np.add.outer(np.arange(h) * 3, np.arange(w)) + size) % 3 == 0
                plain = [bytes((i * 7 + size) % 256 for i in range(w * h)), bytes((i * 7 + size) % 256 for i in range(3 * w * h)), np.packbits(bits, axis=1).tobytes(), None]
                out.append(plain[size % 4] if size % 4 < 3 else images.encode_g4(bits.astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["p_partkey", "described", "data"])

    drawn = images.decoded(made.mapInArrow(encoded, "p_partkey bigint, described binary, data binary"), described="described")
    return _long(drawn.select("p_partkey", "width", "height", F.md5(F.hex("pixels").cast("binary")).alias("pixels")))


@query(f"""WITH p AS (SELECT *, 4 + p_size % 6 AS w, 2 AS h FROM part)
SELECT p_partkey, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height, md5({_hex_of("printf('%02X', ((i + w) * 5 + p_size) % 100)", "w * h")}) AS pixels FROM p""")
def raster_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster images of 8 bits a pixel in bands: a cell header with size fields and a band that goes with it, then marked rows."""
    width = _size() % 6 + 4
    head = F.concat(hexed("70000000009408000BB80BB8"), _u16(width), hexed("00960108"))
    row = lambda y: F.concat(hexed("FE920000"), wire.joined(F.transform(F.sequence(F.lit(0), width - 1), lambda x: number(F.pmod((x + y * width) * 5 + _size(), F.lit(100)), 1))))
    made = _part(spark, sf_dir).select("p_partkey", F.concat(head, *[row(y) for y in range(3)]).alias("data"))
    return _long(images.decoded(made).select("p_partkey", "width", "height", F.md5(F.hex("pixels").cast("binary")).alias("pixels")))


# ---- drawing orders


@query("""WITH b AS (SELECT l_suppkey AS file, count(*) AS n, sum(l_linenumber * 100) AS xs FROM lineitem GROUP BY 1)
SELECT file, n AS lines, n AS boxes, n AS arcs, CAST(xs * 2 AS DOUBLE) AS x_sum, 'rgb(0,0,0)' AS stroke, 4.0::DOUBLE AS width, CAST(2 AS BIGINT) AS dash FROM b""")
def drawing_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display lists of lines, boxes and arcs with their style, scaled."""
    lines = fx.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), "l_orderkey", "l_linenumber")
    x = F.col("l_linenumber") * 100
    order = F.concat(hexed("C108"), _u16(x), _u16(1), _u16(x + 5), _u16(2), hexed("C00A0000"), _u16(x), _u16(3), _u16(x + 7), _u16(9), hexed("C608"), _u16(x), _u16(4), _u16(6), hexed("0005"))
    style = hexed("190002" + "1802")
    made = lines.groupBy("file").agg(wire.joined(F.array_sort(F.collect_list(order))).alias("d")).select("file", F.concat(style, F.col("d")).alias("data"))
    ops = graphics.drawings(made, scale=2.0).select("file", F.explode("ops").alias("o"))
    of = lambda k: F.col("o.op") == k
    return ops.groupBy("file").agg(
        F.count_if(of("line")).alias("lines"), F.count_if(of("rect")).alias("boxes"), F.count_if(of("arc")).alias("arcs"), F.sum(F.when(of("line"), F.get("o.coords", F.lit(0)))).alias("x_sum"),
        F.max("o.stroke").alias("stroke"), F.max("o.width").alias("width"), F.max("o.dash").cast("long").alias("dash"),
    )


# ---- barcodes

_L = "['" + "', '".join(barcodes.EAN_L) + "']"
_SETS = "['LLLLLL', 'LLGLGG', 'LLGGLG', 'LLGGGL', 'LGLLGG', 'LGGLLG', 'LGGGLL', 'LGLGLG', 'LGLGGL', 'LGGLGL']"
_I25 = "['nnwwn', 'wnnnw', 'nwnnw', 'wwnnn', 'nnwnw', 'wnwnn', 'nwwnn', 'nnnww', 'wnnwn', 'nwnwn']"


@query(f"""WITH v AS (SELECT p_partkey, lpad(CAST((p_size % 10) * 1000000000000 + p_partkey * 7919 AS VARCHAR), 13, '0') AS s FROM part),
d AS (SELECT *, [CAST(substr(s, i, 1) AS INTEGER) FOR i IN range(1, 14)] AS n, '0' || s AS e, {_L} AS l, {_SETS} AS sets, {_I25} AS w FROM v)
SELECT p_partkey, '101' || array_to_string([CASE WHEN substr(sets[n[1] + 1], i, 1) = 'L' THEN l[n[i + 1] + 1] ELSE reverse(translate(l[n[i + 1] + 1], '01', '10')) END FOR i IN range(1, 7)], '') || '01010'
|| array_to_string([translate(l[n[i] + 1], '01', '10') FOR i IN range(8, 14)], '') || '101' AS ean13,
'1010' || array_to_string([array_to_string([(CASE WHEN substr(w[CAST(substr(e, 2 * j + 1, 1) AS INTEGER) + 1], k, 1) = 'w' THEN '111' ELSE '1' END) || (CASE WHEN substr(w[CAST(substr(e, 2 * j + 2, 1) AS INTEGER) + 1], k, 1) = 'w' THEN '000' ELSE '0' END) FOR k IN range(1, 6)], '') FOR j IN range(0, 7)], '') || '11101' AS i25 FROM d""")
def barcode_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modules of EAN-13 and interleaved 2 of 5 (an odd number of digits)."""
    text = F.lpad((F.lit(10**12) * (_size() % 10) + F.col("p_partkey") * 7919).cast("string"), 13, "0")
    return _part(spark, sf_dir).select("p_partkey", barcodes.ean13(text).alias("ean13"), barcodes.interleaved(text).alias("i25"))


_C39 = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in barcodes.C39.items() if k.isalnum() or k in "*") + "}"
_C128 = "['" + "', '".join(barcodes.C128) + "']"


@query(f"""WITH v AS (SELECT p_partkey, 'P' || p_partkey || p_type AS s, {_C39} AS c39, {_C128} AS c128 FROM part), x AS (SELECT *, [ascii(substr(s, i, 1)) - 32 FOR i IN range(1, length(s) + 1)] AS n, '*' || upper(s) || '*' AS t FROM v)
SELECT p_partkey, md5(array_to_string([c39[substr(t, i, 1)] || '0' FOR i IN range(1, length(t) + 1)], '')) AS code39,
md5(c128[105] || array_to_string([c128[k + 1] FOR k IN n], '') || c128[CAST((104 + list_sum([n[i] * i FOR i IN range(1, len(n) + 1)])) % 103 + 1 AS BIGINT)] || '1100011101011') AS code128 FROM x""")
def barcode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modules of Code 39 and Code 128."""
    text = F.concat(_keyed(), F.col("p_type"))
    return _part(spark, sf_dir).select("p_partkey", F.md5(barcodes.code39(text).cast("binary")).alias("code39"), F.md5(barcodes.code128(text).cast("binary")).alias("code128"))


@query(longs("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'ean13' WHEN 1 THEN 'code39' WHEN 2 THEN 'qr' ELSE 'code128' END AS kind, CASE WHEN p_size % 5 = 0 THEN 10 ELSE p_size % 5 END AS module_width,
CAST(p_size * 10 AS BIGINT) AS bar_height, p_size % 2 = 1 AS human_readable, CASE p_size % 3 WHEN 0 THEN 90 WHEN 1 THEN 180 ELSE 0 END AS orientation, p_size % 16 AS color FROM part""", "module_width orientation color"))
def barcode_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[hexed(h) for h in ("08", "01", "20", "FF")]), (_size() % 4 + 1).cast("int"))
    turn = F.element_at(F.array(*[hexed(h) for h in ("5A", "B4", "00")]), (_size() % 3 + 1).cast("int"))
    data = F.concat(kind, number(_size() % 5, 1), _u16(_size() * 10), hexed("03"), number(_size(), 1), turn, number(_size() % 16, 1))
    return _names(_part(spark, sf_dir).select("p_partkey", data.alias("d")), barcodes.descriptor(F.col("d")), "p_partkey")


# ---- scalars


# A large x is read behind a flag byte if the numbers found there are in bounds, whether or not one was written.
_OBJECT_POSITIONS = """WITH p AS (SELECT p_partkey, p_partkey % 2 = 0 AS plain, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE p_partkey + 5 END AS x, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 1 END AS y FROM part),
f AS (SELECT *, CASE WHEN plain THEN x > 100000 AND x % 65536 * 256 + y // 65536 < 100000 AND y % 65536 * 256 < 100000 ELSE x < 100000 AND y < 100000 END AS flagged FROM p)
SELECT p_partkey, CASE WHEN plain AND flagged THEN x % 65536 * 256 + y // 65536 WHEN plain OR flagged THEN x ELSE 16711680 + x // 256 END AS x,
CASE WHEN plain AND flagged THEN y % 65536 * 256 WHEN plain OR flagged THEN y ELSE x % 256 * 65536 + y // 256 END AS y,
CASE WHEN plain AND flagged THEN 25600 WHEN plain THEN 100 WHEN flagged THEN 200 ELSE y % 256 * 65536 END AS w,
CASE WHEN plain AND flagged THEN 12800 WHEN plain THEN 50 WHEN flagged THEN 60 ELSE 13107200 END AS h FROM f"""


@query(longs(_OBJECT_POSITIONS, "x y w h"))
def object_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object positions in both layouts: from the first byte, or one further on."""
    key = F.col("p_partkey")
    plain = F.concat(number(key, 3), number(_size(), 3), number(F.lit(100), 3), number(F.lit(50), 3), hexed("00"))
    late = F.concat(hexed("FF"), number(key + 5, 3), number(_size() + 1, 3), number(F.lit(200), 3), number(F.lit(60), 3))
    return _names(_part(spark, sf_dir).select("p_partkey", F.when(key % 2 == 0, plain).otherwise(late).alias("d")), resources.object_position(F.col("d")), "p_partkey")


@query(longs("""WITH p AS (SELECT *, p_size * 37 % 400 AS deg FROM part)
SELECT p_partkey, greatest(1, CAST(floor(p_size * 1500 / 4096.0 + 0.5) AS BIGINT)) AS pages, least(greatest(p_size * 20, 10), 500) AS zoom, p_size * 240 / 300.0::DOUBLE * 72 AS points,
CASE WHEN deg % 360 >= 315 OR deg % 360 < 45 THEN 0 WHEN deg % 360 < 135 THEN 90 WHEN deg % 360 < 225 THEN 180 ELSE 270 END AS turned, 'rgb(' || p_size || ',' || (p_size + 1) || ',0)' AS css,
CASE p_size % 7 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'bmp' WHEN 4 THEN 'tiff' WHEN 5 THEN 'pdf' END AS sniffed, to_base64(encode(p_brand)) AS b64,
replace(replace(p_name || '/' || p_brand || ':1.afp', '/', '_'), ':', '_') AS safe, p_name AS stem, p_name || '_part' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS part_name,
greatest(4, CAST(floor(p_size * 96.0::DOUBLE / 72 * 0.92::DOUBLE + 0.5) AS BIGINT)) AS px, least(1.0::DOUBLE, 120.0::DOUBLE / (p_size * 10), 170.0::DOUBLE / 100) AS thumb, p_size * 2.0::DOUBLE * 1440 / 300 AS image_w,
greatest(1, least(16384, CAST(floor(p_size * 1000 / 1440.0::DOUBLE * 96 + 0.5) AS BIGINT))) AS canvas_w, length(p_name) > 9 AS cut FROM p""", "pages zoom turned px canvas_w"))
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, angles, colors, names, image kinds and scales."""
    kinds = ("FFD8FF", "89504E47", "474946", "424D", "49492A00", "25504446", "000000")
    head = F.element_at(F.array(*[hexed(k) for k in kinds]), (_size() % 7 + 1).cast("int"))
    box = compose.image_box(_size(), _size(), F.lit(300), F.lit(2.0))
    return _names(_part(spark, sf_dir), {
        "pages": scalars.estimated_pages(_size() * 1500), "zoom": scalars.clamp_zoom(_size() * 20), "points": scalars.to_points(_size() * 240, 300), "turned": scalars.orientation_from_degrees(_size() * 37 % 400),
        "css": scalars.css_color(_size(), _size() + 1, F.lit(0)), "sniffed": scalars.image_kind(head), "b64": F.base64(F.col("p_brand").cast("binary")), "safe": scalars.safe_name(F.concat("p_name", F.lit("/"), "p_brand", F.lit(":1.afp"))),
        "stem": scalars.file_stem(F.concat("p_name", F.lit(".AFP2"))), "part_name": scalars.part_name(F.col("p_name"), _size(), F.lit(7)), "px": ptoca.pixel_font(_size()), "thumb": compose.thumbnail_scale(_size() * 10, F.lit(100)),
        "image_w": box["w"], "canvas_w": compose.canvas(_size() * 1000, _size(), F.lit(1440))["canvas_width"], "cut": F.length(F.substring("p_name", 1, 10)) > 9,
    }, "p_partkey")


# ---- files by case


def _files(spark: SparkSession, sf_dir: str, content: Column) -> DataFrame:
    return _part(spark, sf_dir).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file_id"), "p_partkey", "p_size", content.alias("content"))


def _case(*variants: Column) -> Column:
    made = F.when(_size() % len(variants) == 0, variants[0])
    for i, v in enumerate(variants[1:], 1):
        made = made.when(_size() % len(variants) == i, v)
    return made


def _page() -> Column:
    return F.concat(field("D3A8AD"), field("D3A9AD"))


def _document(*parts: Column) -> Column:
    return F.concat(field("D3A8A8"), *parts, field("D3A9A8"))


@query("""WITH f AS (SELECT 'p' || p_partkey AS file_id, p_size % 6 AS k FROM part), m AS (
SELECT file_id, k, unnest([1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13]) AS seq FROM f)
SELECT file_id, seq, CASE seq WHEN 3 THEN CASE WHEN k = 0 THEN 'error' ELSE 'success' END WHEN 4 THEN 'warning' WHEN 5 THEN 'warning' WHEN 10 THEN 'error' WHEN 11 THEN 'warning' WHEN 12 THEN CASE WHEN k = 5 THEN 'error' ELSE 'success' END WHEN 13 THEN 'warning' ELSE 'info' END AS severity,
CASE seq WHEN 1 THEN 'File size: ' || [37, 18, 72, 45, 70, 40][k + 1] || ' bytes' WHEN 2 THEN [4, 2, 8, 5, 6, 4][k + 1] || ' structured fields, ' || [4, 2, 6, 5, 6, 4][k + 1] || ' types'
WHEN 3 THEN CASE WHEN k = 0 THEN 'File does not start with a structured field' ELSE 'File starts with a structured field' END WHEN 4 THEN 'No begin-document field' WHEN 5 THEN 'No end-document field' WHEN 6 THEN [1, 1, 2, 1, 1, 1][k + 1] || ' pages'
WHEN 7 THEN 'Composite pages: 2 resources a page' WHEN 9 THEN '1 defined, 1 referenced' WHEN 10 THEN 'Missing resource: MISSING1' WHEN 11 THEN 'Unused resource: UNUSED01' WHEN 12 THEN CASE WHEN k = 5 THEN '1 corrupt fields' ELSE 'No corrupt fields' END ELSE '1 fields of unknown type' END AS message,
CASE WHEN seq = 10 THEN CAST(35 AS BIGINT) END AS "offset" FROM m
WHERE seq IN (1, 2, 3, 6, 12) OR (seq IN (4, 5) AND k = 1) OR (seq = 7 AND k = 2) OR (seq = 13 AND k = 3) OR (seq IN (9, 10, 11) AND k = 4)""")
def diagnostics_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of files with bytes before the first field, without a document, with composite pages, unknown types, lacking and idle resources, corrupt fields."""
    brs = F.concat(field("D3A8AF"), field("D3A9AF"))
    files = _files(spark, sf_dir, _case(
        F.concat(hexed("00"), _document(_page())), _page(), _document(field("D3A8AD"), brs, brs, field("D3A9AD")), _document(field("D3FFFF"), _page()),
        _document(field("D3A8CE", name8(F.lit("UNUSED01"))), field("D3A8AD"), field("D3AF5F", name8(F.lit("MISSING1"))), field("D3A9AD")), _document(_page(), hexed("5A000100")),
    ))
    said = diagnostics.messages(framing.frames(files), framing.corrupt_fields(files))
    return said.select("file_id", "seq", "severity", "message", "offset")


@query("""WITH f AS (SELECT 'p' || p_partkey AS file_id, p_size % 4 AS k FROM part)
SELECT file_id, CAST(1 AS BIGINT) AS page_number, CAST(1 AS BIGINT) AS page_pos, CAST(26 AS BIGINT) - (CASE WHEN k = 2 THEN 17 WHEN k = 3 THEN 0 ELSE 0 END) AS byte_offset, CAST([27, 27, 18, 36][k + 1] AS BIGINT) AS byte_length, CAST(0 AS BIGINT) AS document_index,
CASE WHEN k <> 2 THEN 'GROUP' || 1 END AS document_name, CAST([1, 1, 0, 1][k + 1] AS BIGINT) AS object_count, k = 0 AS has_text, k IN (0, 1) AS has_text_any, k = 3 AS has_images FROM f""")
def scan_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full scans of pages that a page end, a group's end, a document's end or the file's end closes, with texts and images."""
    group, end = field("D3ABCA", name8(F.lit("GROUP1"))), field("D3A9CA")
    files = _files(spark, sf_dir, _case(
        F.concat(field("D3A8A8"), group, field("D3A8AD"), field("D3A87B"), field("D3A97B"), end, field("D3A9A8")),
        F.concat(field("D3A8A8"), group, field("D3A8AD"), field("D3A89B"), field("D3A9AD"), end, field("D3A9A8")),
        F.concat(field("D3A8A8"), field("D3A8AD"), field("D3A6AF"), field("D3A9A8")),
        F.concat(field("D3A8A8"), group, field("D3A8AD"), field("D3A8FB"), field("D3A6FB"), field("D3EEFB")),
    ))
    return pages.scan_index(framing.frames(files))


@query("""WITH f AS (SELECT 'p' || p_partkey AS file_id, p_size % 3 AS k, p_size FROM part)
SELECT file_id, CAST(unnest([1, 2]) AS BIGINT) AS page_pos, unnest(CASE k WHEN 0 THEN ['', '5'] WHEN 1 THEN ['5', '5'] ELSE ['5', '6'] END) AS bold FROM f""")
def page_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bold local fonts of each page: those of the last font map before it (coded-font groups of a character set each)."""
    def group(local: int, chars: str) -> Column:
        inner = F.concat(hexed("042405"), number(F.lit(local), 1), hexed("0C028600"), name8(F.lit(chars)))
        return F.concat(_u16(18), inner)

    light, bold, heavy = field("D3AB8A", F.concat(group(5, "C0FL0001"), group(6, "C0FX0001"))), field("D3AB8A", F.concat(group(5, "C0FB0001"), group(6, "C0FL0001"))), field("D3AB8A", group(6, "C0FH0001"))
    files = _files(spark, sf_dir, _case(_document(light, _page(), bold, _page()), _document(light, bold, _page(), _page()), _document(bold, _page(), heavy, _page())))
    sf = framing.frames(files)
    found = resources.page_fonts(pages.page_index(sf), tags.coded_fonts(sf))
    return found.select("file_id", "page_pos", F.array_join(F.array_sort("bold_ids"), ",").alias("bold"))


@query("""WITH f AS (SELECT 'p' || p_partkey AS file_id, p_brand AS b, p_size FROM part)
SELECT file_id, unnest(['inline', 'raster', 'segment', 'segment', 'overlay', 'overlay']) AS kind, unnest(['IMG00001', 'RAS00001', 'SEG00001', 'BOX00001', 'OVL00001', 'BOX00002']) AS name,
unnest([md5(b), md5('raster' || b), md5('one' || b), md5('one' || b), md5('two' || b), md5('two' || b)]) AS data FROM f""")
def held_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline and raster images, segments and overlays before the pages, under their own and their container's names."""
    n = lambda t: name8(F.lit(t))
    raw = lambda t: F.concat(F.lit(t).cast("binary"), F.col("p_brand").cast("binary"))
    front = F.concat(
        field("D3A892", n("IMG00001")), field("D3EE92", F.substring(F.col("p_brand").cast("binary"), 1, 3)), field("D3EE92", F.substring(F.col("p_brand").cast("binary"), 4, 99)), field("D3A992"),
        field("D3A8FB", n("RAS00001")), field("D3EEFB", raw("raster")), field("D3A9FB"),
        field("D3A8CE", n("BOX00001")), field("D3A85F", n("SEG00001")), field("D3EEBB", raw("one")), field("D3A95F"), field("D3A9CE"),
        field("D3A8CE", n("BOX00002")), field("D3A8DF", n("OVL00001")), field("D3EEBB", raw("two")), field("D3A9DF"), field("D3A9CE"),
    )
    late = F.concat(field("D3A8DF", n("LATE")), field("D3EEBB", raw("late")), field("D3A9DF"))
    sf = framing.frames(_files_with(spark, sf_dir, F.concat(front, _document(_page(), late)), "p_brand"))
    sf = sf.repartition(fx.shares(spark, sf_dir, "part", fx.TASK_FILES), "file_id")  # the windows and groups of a file go on with it
    kinds = {"inline": resources.inline_images(sf), "raster": resources.raster_images(sf), "segment": resources.segments(sf), "overlay": resources.overlays(sf)}
    parts = [t.select("file_id", F.lit(k).alias("kind"), "name", F.md5("data").alias("data")) for k, t in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _files_with(spark: SparkSession, sf_dir: str, content: Column, *more: str) -> DataFrame:
    return _part(spark, sf_dir).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file_id"), *more, content.alias("content"))


@query("""WITH f AS (SELECT 'p' || p_partkey AS file_id, p_size, p_brand FROM part)
SELECT file_id, CAST(unnest([8650 + p_size, 11520]) AS BIGINT) AS x, unnest([md5('img' || p_brand), md5('img' || p_brand)]) AS data FROM f""")
def included_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Included images at the place that their parameters tell (6 to 9 inches from the left), or at the usual one."""
    n = name8(F.lit("IMG00001"))
    inline = F.concat(field("D3A892", n), field("D3EE92", F.concat(F.lit("img").cast("binary"), F.col("p_brand").cast("binary"))), field("D3A992"))
    told, untold = field("D3AFC3", F.concat(n, number(_size() + 8650, 3))), field("D3AFC3", F.concat(n, hexed("000001")))
    other = field("D3AFC3", name8(F.lit("NOTHING")))
    sf = framing.frames(_files_with(spark, sf_dir, F.concat(inline, _document(field("D3A8AD"), told, untold, other, field("D3A9AD"))), "p_brand"))
    found = resources.included_objects(sf, resources.inline_images(sf))
    return found.select("file_id", F.col("x").cast("long").alias("x"), F.md5("data").alias("data"))


_NEST = "5A0008D3A8AD000000" "5A0008D3A89B000000" "5A0008D3A99B000000" "5A0008D3A9AD000000"


@query(longs(f"""WITH f AS (SELECT 'p' || p_partkey AS file_id FROM part)
SELECT file_id, unnest([0, 9, 18]) AS "offset", unnest([54, 36, 18]) AS n_bytes, unnest([md5('5A0008D3A8A8000000{_NEST}5A0008D3A9A8000000'), md5('{_NEST}'), md5('{_NEST[18:54]}')]) AS content, unnest([0, 1, 2]) AS depth FROM f""", '"offset" n_bytes depth'))
def subtree_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element with all inside it, cut from the file."""
    files = _files(spark, sf_dir, _document(field("D3A8AD"), field("D3A89B"), field("D3A99B"), field("D3A9AD")))
    sf = framing.frames(files)
    t = F.col("type_id")
    tree = nesting.subtrees(sf, ["file_id"], ["offset"], is_begin(t), is_end(t), "offset", F.col("offset") + 1 + F.col("length"))
    cut = surgery.subtree_bytes(files, tree.select("file_id", "offset", "end_offset", "depth"))
    return cut.select("file_id", "offset", F.length("content").cast("long").alias("n_bytes"), F.md5(F.hex("content").cast("binary")).alias("content"), F.col("depth").cast("long").alias("depth"))


@query("""WITH f AS (SELECT 'p' || p_partkey AS file_id, p_size FROM part)
SELECT file_id, 'CP000001' AS name, CAST(8364 AS BIGINT) AS at_f0, CAST(1000 + p_size AS BIGINT) AS at_b1, CAST(65 AS BIGINT) AS at_c1, CAST(65533 AS BIGINT) AS at_00 FROM f""")
def embedded_code_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code pages in a file's resources: index entries, then the usual letters where they say nothing."""
    entries = F.concat(hexed("06" + "00" + "20AC" + "F0" + "00"), hexed("0600"), _u16(_size() + 1000), hexed("B100"))
    files = _files(spark, sf_dir, F.concat(field("D3A889", name8(F.lit("CP000001"))), field("D3AC89", entries), field("D3A989"), _document(_page())))
    found = codepages.embedded(framing.frames(files))
    at = lambda i: F.get("mapping", F.lit(i)).cast("long")
    return found.select("file_id", "name", at(0xF0).alias("at_f0"), at(0xB1).alias("at_b1"), at(0xC1).alias("at_c1"), at(0).alias("at_00"))


@query("""WITH f AS (SELECT 'p' || p_partkey AS file_id, p_size % 3 AS k FROM part)
SELECT file_id, ['C0FL0070', 'C0FM00I0', 'T1000500'][k + 1] AS name, ['Latin', 'Math/Symbol', 'Code Page'][k + 1] AS type, ['Medium', 'Std Italic', '—'][k + 1] AS weight, CASE WHEN k < 2 THEN 'FAMILY' ELSE '' END AS family, ['', '', 'CP500 (Intl)'][k + 1] AS code_page FROM f""")
def font_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fonts' inventory by container; a container that comes again counts once."""
    name = F.element_at(F.array(*[F.lit(n) for n in ("C0FL0070", "C0FM00I0", "T1000500")]), (_size() % 3 + 1).cast("int"))
    one = F.concat(field("D3A8CE", name8(name)), field("D3A689", ebcdic.encode(F.rpad(F.lit("FAMILY"), 32, " "))), field("D3A9CE"))
    return codepages.font_containers(framing.frames(_files(spark, sf_dir, F.concat(one, one, _document(_page())))))


@query("""WITH f AS (SELECT 'p' || p_partkey AS file_id, p_size FROM part)
SELECT file_id, "offset", CASE WHEN "offset" < 9 THEN NULL WHEN "offset" < 44 THEN 'one' ELSE 'TWO' END AS box, CAST(CASE WHEN "offset" < 9 THEN 0 WHEN "offset" < 44 THEN 1 ELSE 2 END AS BIGINT) AS island
FROM (SELECT file_id, CAST(unnest([0, 9, 26, 35, 44, 61]) AS BIGINT) AS "offset" FROM f)""")
def context_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container that was begun last, carried to all fields behind; runs from container to container numbered."""
    box = lambda t: field("D3A8CE", name8(F.lit(t)))
    sf = framing.frames(_files(spark, sf_dir, F.concat(field("D3A8A8"), box("one"), field("D3EEEE"), field("D3EEEE"), box("TWO"), field("D3A9A8"))))
    begun = F.col("type_id") == "D3A8CE"
    name = F.when(begun, ebcdic.decode_name(F.substring("data", 1, 8), "tag"))
    held = islands.carried(sf, ["file_id"], ["offset"], name, "box")
    return islands.islands(held, ["file_id"], ["offset"], begun).select("file_id", "offset", "box", "island")


@query("""WITH f AS (SELECT 'p' || p_partkey AS file_id, p_size FROM part)
SELECT file_id, 'NAME' || p_size AS first_name, CAST(1000 + p_size AS BIGINT) AS page_no, 'NAME' || p_size AS preview, '...' || p_size AS raw FROM f""")
def triplet_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in fully-qualified-name triplets, sequence numbers, previews as text or as ASCII with dots."""
    name = F.concat(F.lit("NAME"), _size().cast("string"))
    named = F.concat(number(F.length(name) + 4, 1), hexed("02FF00"), ebcdic.encode(name))
    paged = F.concat(hexed("0662"), number(_size() + 1000, 4))
    raw = F.concat(hexed("000102"), _size().cast("string").cast("binary"))
    made = _part(spark, sf_dir).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file_id"), F.concat(named, paged).alias("d"), ebcdic.encode(name).alias("t"), raw.alias("r"))
    return made.select("file_id", F.get(tags.resource_names(F.col("d")), F.lit(0)).alias("first_name"), tags.page_sequence(F.col("d")).alias("page_no"), tags.data_preview(F.col("t")).alias("preview"), tags.data_preview(F.col("r")).alias("raw"))


@query("""WITH f AS (SELECT 'p' || p_partkey AS file_id FROM part)
SELECT file_id, unnest(['range', 'range', 'toggled', 'toggled', 'inverted', 'all', 'all', 'all', 'second']) AS kind, CAST(unnest([2, 3, 1, 2, 1, 1, 2, 3, 1]) AS BIGINT) AS page_pos FROM f""")
def page_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges, toggles, inversion and all of a file's pages; pages with a second text block."""
    block = F.concat(field("D3A89B"), field("D3A99B"))
    sf = framing.frames(_files(spark, sf_dir, _document(F.concat(field("D3A8AD"), block, block, field("D3A9AD")), _page(), F.concat(field("D3A8AD"), block, field("D3A9AD")))))
    index = pages.page_index(sf)
    some = selection.between(index, 3, 2)
    toggled = selection.toggled(some, selection.everything(index).where("page_pos IN (1, 3)"))
    kinds = {"range": some, "toggled": toggled, "inverted": selection.inverted(index, some), "all": selection.everything(index), "second": selection.nth_field(sf, index, ["D3A89B"], 1)}
    parts = [t.select("file_id", F.lit(k).alias("kind"), "page_pos") for k, t in kinds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("""WITH f AS (SELECT 'p' || p_partkey AS file_id, p_size, p_brand FROM part)
SELECT file_id, CAST(unnest([0, 300]) AS BIGINT) AS box_x, CAST(unnest([0, 240]) AS BIGINT) AS box_y, CAST(unnest([120 * length('x' || p_brand), 120 * length(p_brand)]) AS BIGINT) AS box_width FROM f""")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the text runs that hold a word."""
    from ..operators import search

    data = F.concat(ebcdic.encode(F.concat(F.lit("x"), F.col("p_brand"))), _escape("D8"), ebcdic.encode(F.lit("other")), _escape("C0", _u16(300)), ebcdic.encode(F.col("p_brand")))
    runs = ptoca.text_runs(_files_with(spark, sf_dir, data).withColumnRenamed("content", "data"))
    return _long(search.highlights(runs, "BRAND").select("file_id", "box_x", "box_y", "box_width"))


@query("SELECT p_partkey, 'cp500 ' || p_name AS name500, p_name || 'é' AS name297, 'a?b' AS unknown FROM part")
def code_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips through the other code pages; what a page lacks becomes a substitute."""
    back = lambda t, page: ebcdic.decode(ebcdic.encode(t, page), page)
    lost = F.translate(ebcdic.decode(ebcdic.encode(F.lit("a\u4e2db"))), "\x1a", "?")
    return _part(spark, sf_dir).select("p_partkey", back(F.concat(F.lit("cp500 "), "p_name"), "cp500").alias("name500"), back(F.concat("p_name", F.lit("é")), "cp297").alias("name297"), lost.alias("unknown"))
