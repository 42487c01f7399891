import hashlib
import io
import json
import os
import random
import re
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafstream.functions import scalars
from leafstream.operators import barcodes, compose, graphics, images, sinks, surgery
from leafstream.sources import files as file_source
from leafstream.sources import framing, parts
from leafstream.streaming import index as streaming

from .test_framing import F1, PARTS, opened, stream


def one(spark, column, **given):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()])
    return df.select(column).first()[0]


# ---- barcodes


def test_code128_by_hand(spark):
    got = one(spark, barcodes.code128(F.col("s")), s="Hi 1")
    table = dict(enumerate(barcodes.C128))
    values = [ord(c) - 32 for c in "Hi 1"]
    check = (104 + sum(v * i for i, v in enumerate(values, 1))) % 103
    assert got == "".join(table[v] for v in (104, *values, check)) + "1100011101011"
    assert len(set(barcodes.C128)) == 106 and all(len(b) == 11 for b in barcodes.C128)


def test_ean13_and_code39(spark):
    got = one(spark, barcodes.ean13(F.col("s")), s="5901234123457")
    assert got == "10100010110100111011001100100110111101001110101010110011011011001000010101110010011101000100101"
    assert len(barcodes.C39) == 44 and all(len(m) == 15 for m in barcodes.C39.values()) and len(set(barcodes.C39.values())) == 44
    assert one(spark, barcodes.code39(F.col("s")), s="a?") == barcodes.C39["*"] + "0" + barcodes.C39["A"] + "0" + barcodes.C39["*"] + "0"
    assert one(spark, barcodes.interleaved(F.col("s")), s="12") == "1010" + "111010001010111000"[:18] + "11101"


def test_barcode_descriptor(spark):
    df = spark.createDataFrame([(bytearray.fromhex("080501F403015A02"),), (bytearray.fromhex("FF"),)], "d binary")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in barcodes.descriptor(F.col("d")).items()]).collect()]
    assert got == [("ean13", 5, 500, True, 90, 2), ("code128", 10, 720, True, 0, 0)]
    cells = one(spark, barcodes.placeholder(F.col("s")), s="AB")
    assert [[c == "1" for c in row] for row in cells.split("/")] == [[(ord("AB"[r % 2]) * 31 + c * 17 + r * 7) & 255 > 128 for c in range(10)] for r in range(10)]


# ---- graphics


def test_orders_bounds_and_display():
    data = bytes.fromhex("00" + "08FF" + "C108000A0014001E0028" + "C00A0000FFF6FFEC00640032" + "6880" + "210400010002" + "810400050006" + "6000" + "FE" + "C2040007")
    orders = graphics.parse(data)
    assert [o[0] for o in orders] == [0x08, 0xC1, 0xC0, 0x68, 0x21, 0x81, 0x60, 0xC2]
    assert orders[-1][1] == b"\x00\x07"
    assert graphics.bounds(orders) == (-10, -20, 110, 70)
    ops = graphics.display(orders, scale=2.0, dx=1.0)
    assert [o["op"] for o in ops] == ["line", "rect", "polygon"]
    assert ops[0]["coords"] == [21.0, 40.0, 61.0, 80.0] and ops[1]["coords"] == [-19.0, -40.0, 220.0, 140.0]
    assert ops[2]["fill"] == "rgb(0,0,0)" and ops[2]["coords"] == [3.0, 4.0, 11.0, 12.0]
    assert graphics.bounds([]) is None and graphics.parse(b"\xc1") == []
    assert graphics.strip_header(bytes.fromhex("7002AABB00A001CC" + "C100")) == bytes.fromhex("C100")
    assert graphics.segment_resolution(bytes.fromhex("00" + "0BB80BB8")) == 300 and graphics.segment_resolution(b"") == 300


# ---- images


def test_fax_tables_and_round_trip():
    for table in images.RUNS:
        assert len(table) == 104 and not any(a != b and b.startswith(a) for a in table for b in table)
    rng = np.random.default_rng(1)
    for w, h, p in ((1, 1, 0.5), (17, 9, 0.5), (200, 30, 0.05), (64, 20, 0.95), (3000, 4, 0.001), (40, 6, 0)):
        picture = (rng.random((h, w)) < p).astype(np.uint8)
        assert (images.decode_g4(images.encode_g4(picture), w, h) == picture).all()
    assert images.decode_g4(b"", 5, 2).sum() == 0


def read_png(data):
    w, h = struct.unpack(">II", data[16:24])
    at, raw = 8, b""
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            raw += data[at + 8 : at + 8 + n]
        at += 12 + n
    rows = zlib.decompress(raw)
    step = len(rows) // h
    return np.array([list(rows[y * step + 1 : (y + 1) * step]) for y in range(h)], np.uint8).reshape(h, w, -1)


def test_image_decoding():
    d = images.descriptor(bytes.fromhex("000000F000F0" + "0A94000200030960096000"[:20] + "039502"[:6] + "039608" + "04970001"))
    assert (d["width"], d["height"], d["bit_depth"], d["color_model"], d["compression"]) == (2, 3, 8, "rgb", "g4")
    packed = images.rgba({"width": 9, "height": 2, "bit_depth": 1}, bytes.fromhex("8080" + "0000"))
    assert packed[0, 0, 0] == 0 and packed[0, 8, 0] == 0 and packed[1, 0, 0] == 255 and packed[0, 1, 3] == 255
    cmyk = images.rgba({"width": 1, "height": 1, "bit_depth": 8, "color_model": "cmyk"}, bytes((255, 0, 0, 0)))
    assert tuple(cmyk[0, 0, :3]) == (0, 255, 255)
    assert images.rgba({"width": 2, "height": 1, "bit_depth": 8, "color_model": "gray"}, b"\x07")[0].tolist() == [[7, 7, 7, 255], [0, 0, 0, 255]]
    assert (read_png(images.png(packed)) == packed).all()
    assert images.fit(np.zeros((100, 1000), np.uint8)).shape == (50, 500) and images.fit(np.zeros((10, 10), np.uint8)).shape == (40, 40)


def test_raster_images():
    head = bytes.fromhex("70000000009408" + "00" + "0BB8" + "0BB8" + "0010" + "00")
    banded = images.raster([head + b"\xfe\x92\x00\x04" + b"\xaa\x55\x01\x02"])
    assert banded is not None and banded["width"] == 16 and banded["resolution"] == 300 and banded["height"] == 2 and banded["data"] == b"\xaa\x55\x01\x02"
    assert images.raster([b"\x00" * 10]) is None and images.raster([]) is None


# ---- surgery


def test_surgery(spark, tmp_path):
    page = lambda n: [n[0]] if isinstance(n, tuple) else ["BPG", "PGD", "EPG"]
    names = ["BDT", *page(1), "NOPE", *page(2), *page(3), "EDT"]
    nop = "5A000CD3EEEE000000D5D6E3C5"
    body = b"".join(bytes.fromhex(PARTS.get(n, nop)) for n in names)
    files, sf = opened(spark, body)
    from leafstream.operators import pages

    index = pages.page_index(sf).cache()
    first, second = surgery.split_after(files, index, 1).orderBy("part").collect()
    gap = bytes.fromhex(nop)
    one_page, pre, post = stream(["BPG", "PGD", "EPG"]), stream(["BDT"]), stream(["EDT"])
    assert bytes(first.content) == pre + one_page + post and bytes(second.content) == pre + one_page * 2 + post
    parts = surgery.batch_split(files, index, 2).orderBy("part").collect()
    assert bytes(parts[0].content) == pre + one_page + gap + one_page + post and parts[1].page_count == 1
    chosen = index.where("page_pos <> 2").select("file_id", "page_pos")
    assert bytes(surgery.reassemble(files, index, surgery.extracted(index, chosen)).first().content) == pre + one_page * 2 + post
    assert [r.page_pos for r in surgery.moved(index, index.where("page_pos = 3").select("file_id", "page_pos"), 1).orderBy("position").collect()] == [3, 1, 2]
    assert surgery.inverted(index, chosen).first().page_pos == 2
    edits = spark.createDataFrame([("f0", body.index(bytes.fromhex("D5D6E3C5")), 4, "NEW LONG")], "file_id string, at int, size int, text string")
    assert bytes.fromhex("D5C5E640") in bytes(surgery.edit(files, edits).first().content)
    with pytest.raises(ValueError):
        surgery.batch_split(files, index, 0)
    both = files.unionByName(spark.createDataFrame([("f1", bytearray(stream("BDT NOPX BPG EPG EDT".replace("NOPX", "TLE").split())))], "file_id string, content binary")).withColumns({"g": F.lit(1), "pos": F.col("file_id")})
    sf2 = framing.frames(both)
    surgery.merge_documents(both, sf2, pages.page_index(sf2), ["g"], "pos", str(tmp_path / "merged"))
    merged = b"".join(bytes(r.content) for r in _grouped_rows(spark, str(tmp_path / "merged"))["1"])
    assert merged == pre + stream(["TLE"]) + one_page * 3 + stream(["BPG", "EPG"]) + post
    assert surgery.concat_files(both, ["g"], "pos", str(tmp_path / "concat")).first()["size"] == len(body) + len(stream("BDT TLE BPG EPG EDT".split()))


def test_object_positions_of_both_layouts(spark):
    from leafstream.operators import resources

    def read(data: bytes):
        return tuple(spark.createDataFrame([(bytearray(data),)], "d binary").select(*[c.alias(n) for n, c in resources.object_position(F.col("d")).items()]).first())

    wide = lambda *numbers: b"".join(n.to_bytes(3, "big") for n in numbers)
    for x in (7, 1024, 65_536, 99_999):
        assert read(wide(x, 12, 100, 50) + b"\0") == (x, 12, 100, 50)
        assert read(b"\xff" + wide(x, 13, 200, 60)) == (x, 13, 200, 60)
    assert read(b"\xff" + wide(1024, 512, 0, 256)) == (1024, 512, 0, 256)  # multiples of 256 behind a flag byte
    assert read(b"\x02" + wide(1000, 2000, 300, 40)) == (1000, 2000, 300, 40)
    assert read(b"\x02" + wide(1024, 2000)) == (1024, 2000, 0, 0)  # without a size
    assert read(b"\x02" + wide(1024, 2000, 300) + b"\0\0")[:2] == (1024, 2000)
    assert read(b"\x02" + wide(1024, 2000, 300) + b"\0\0")[2:] == (0xD0 << 16 | 300 >> 8, (300 & 255) << 16)  # one byte short of a size behind the flag
    assert read(wide(200_000, 2))[:2] == (200_000, 2)  # too short for a flag byte
    assert read(wide(200_000, 0x02FFFF, 0x020000)) == (200_000, 0x02FFFF, 0, 0)  # with a flag byte y would be out of bounds
    assert read(b"\x02" + wide(150_000, 10) + bytes(6)) == (131_072 + (150_000 >> 8), (150_000 & 255) << 16, 10 << 16, 0)  # x within 100000 on neither reading: the first holds
    assert read(wide(131_072, 12, 100, 50) + b"\0") == (0, 3072, 25_600, 12_800)  # reads as a flag byte and small numbers


def test_object_positions_equal_sql_at_large_keys(spark, tmp_path):
    import duckdb

    from leafstream.plans.queries import ORACLES, QUERIES

    keys = [*range(1, 40), *range(65_530, 65_545), *range(99_990, 100_010), *range(131_060, 131_090), *range(196_600, 196_620), 262_144, 1_048_576, 1_048_577, 4_000_000, 4_000_001]
    part = spark.createDataFrame([(k, 1 + k % 50) for k in keys], "p_partkey bigint, p_size int")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["object_positions"]).fetchall())
    assert sorted(map(tuple, QUERIES["object_positions"](spark, str(tmp_path)).collect())) == want


def test_drawings_are_handed_on_in_bounded_batches(spark):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    line = lambda n: b"".join(bytes.fromhex("C108") + struct.pack(">4h", i, 1, 2, 3) for i in range(n))
    sizes = [3, 0, 40, 7, 200, 1, 1, 30]
    rows = [{"id": i, "more": {"k": i}, "data": line(n)} for i, n in enumerate(sizes)] + [{"id": 99, "more": None, "data": None}]
    got = graphics.drawings(spark.createDataFrame([tuple(r.values()) for r in rows], "id int, more map<string,int>, data binary").coalesce(1))
    seen = {r.id: r for r in got.collect()}
    assert {i: (r.n_orders, len(r.ops)) for i, r in seen.items()} == {**{i: (n, n) for i, n in enumerate(sizes)}, 99: (0, 0)}
    assert seen[4].more == {"k": 4} and seen[4].ops[3].asDict() == {"op": "line", "coords": [3.0, 1.0, 2.0, 3.0], "stroke": "rgb(0,0,0)", "fill": None, "width": 1.0, "dash": 0}
    assert (seen[0].x, seen[0].y, seen[0].width, seen[0].height) == (0, 1, 2, 2) and seen[99].x is None
    batch = pa.RecordBatch.from_pylist([{"id": r["id"], "more": [], "data": r["data"]} for r in rows], schema=pa.schema([("id", pa.int32()), ("more", pa.map_(pa.string(), pa.int32())), ("data", pa.binary())]))
    made = list(graphics.drawn(iter([batch, batch.slice(0, 0)]), to_arrow_schema(got.schema), 1.0, held_ops=20))
    assert [[len(o) for o in b.column("ops").to_pylist()] for b in made] == [[3, 0, 40], [7, 200], [1, 1, 30], [0]]
    assert [i for b in made for i in b.column("id").to_pylist()] == [r["id"] for r in rows]


def test_made_files_in_pieces_are_the_whole_ones(spark, tmp_path):
    """No row is larger than a file, and in order the pieces are the made file."""
    from leafstream.operators import pages

    bodies = {"b": "BDT TLE BPG EPG EDT", "a": "BDT TLE TLE BPG PGD EPG BPG EPG EDT", "c": "BDT BPG EPG EDT"}
    bodies = {k: stream(v.split()) for k, v in bodies.items()}
    rows = [(k, bytearray(v), g, 1 if k in "ab" else 2) for g in ("g", "h") for k, v in bodies.items()]
    files = spark.createDataFrame([(f"{g}{k}", v, g, p) for k, v, g, p in rows if g == "g" or k != "a"], "file_id string, content binary, g string, pos int")
    sf = framing.frames(files)
    index = pages.page_index(sf)
    read = lambda folder: {n: b"".join(bytes(r.content) for r in rows) for n, rows in _grouped_rows(spark, folder).items()}
    folders = str(tmp_path / "concat"), str(tmp_path / "merged")
    made = surgery.concat_files(files, ["g"], "pos", folders[0]), surgery.merge_documents(files, sf, index, ["g"], "pos", folders[1])
    for pieces, folder, told in zip((surgery.concat_pieces(files, ["g"], "pos"), surgery.merge_pieces(files, sf, index, ["g"], "pos")), folders, made, strict=True):
        found = pieces.collect()
        assert max(len(r.content) for r in found) <= max(map(len, bodies.values()))
        whole = {g: b"".join(bytes(x.content) for x in sorted((x for x in found if x.g == g), key=lambda x: (x.section, x.f, x.file_id))) for g in "gh"}
        assert read(folder) == whole and {r.name: r["size"] for r in told.collect()} == {g: len(v) for g, v in whole.items()}
        assert {r.name: r.sha256 for r in parts.digests(spark, folder).collect()} == {g: hashlib.sha256(v).hexdigest() for g, v in whole.items()}
    assert read(folders[0]) == {"g": bodies["a"] + bodies["b"] + bodies["c"], "h": bodies["b"] + bodies["c"]}
    assert read(folders[1])["g"].startswith(bodies["a"][: bodies["a"].index(stream(["BPG"]))])
    assert [(r.g, r.total_pages, r.total_files) for r in surgery.piece_totals(surgery.merge_pieces(files, sf, index, ["g"], "pos"), ["g"]).orderBy("g").collect()] == [("g", 4, 3), ("h", 2, 2)]
    one = surgery.merge_pieces(files.where("file_id = 'ga'"), sf, index.where("file_id = 'ga'"), ["g"], "pos").collect()
    assert [(r.section, r.pages, bytes(r.content)) for r in one] == [(0, 2, bodies["a"])]  # alone in its group: as it is


def _grouped_rows(spark, folder):
    out = {}
    for r in sorted(spark.read.format("binaryparts").option("splitBytes", 5).load(folder).collect(), key=lambda r: (r.name, r.task, r.seq, r.at)):
        out.setdefault(r.name, []).append(r)
    return out


def test_parts_are_published_whole_or_not_at_all(spark, tmp_path):
    from pyspark.sql.types import StructType

    folder = str(tmp_path / "made")
    pieces = spark.range(200).selectExpr("'n' || id % 3 AS g", "id", "cast(repeat(cast(id as string), 50) as binary) AS content")
    parts.write(pieces, folder, F.col("g"), ["id"])
    want = {f"n{k}": b"".join(str(i).encode() * 50 for i in range(k, 200, 3)) for k in range(3)}
    read = lambda: {n: b"".join(bytes(r.content) for r in rows) for n, rows in _grouped_rows(spark, folder).items()}
    assert read() == want
    stretches = parts.made_files(spark, folder).where("name = 'n1'").first().stretches
    assert [s["at"] for s in stretches] == [sum(s["n"] for s in stretches[:i]) for i in range(len(stretches))] and len(stretches) > 1

    broken = pieces.withColumn("content", F.when(F.col("id") == 150, F.expr("cast(raise_error('lost') as binary)")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        broken.select(F.col("g").alias("name"), "content").write.format("binaryparts").mode("overwrite").save(folder)
    assert read() == want and len([f for f in os.listdir(folder) if f.startswith("run-")]) == 1  # the files before stand, nothing of the lost run does

    # a task that died behind its last byte has sent no message: its part is cleared at the commit
    writer = parts.PartsWriter({"path": folder}, StructType.fromDDL("name string, content binary"), True)
    os.makedirs(f"{folder}/{writer.run}")
    for kind in ("bin", "parquet"):
        open(f"{folder}/{writer.run}/000000-dead.{kind}", "wb").close()
    writer.commit([None])
    assert os.listdir(f"{folder}/{writer.run}") == [] and read() == {} and parts.made_files(spark, folder).count() == 0
    assert [f for f in os.listdir(folder) if f.startswith("run-")] == [writer.run]
    with pytest.raises(Exception, match="overwrite"):
        pieces.select(F.col("g").alias("name"), "content").write.format("binaryparts").mode("append").save(folder)


def test_cut_and_edit_without_copies(spark):
    """All ranges of a file in one pass, in bounded batches."""
    import time

    body = bytes(range(256)) * 40_000  # 10 MB
    files = spark.createDataFrame([("f", bytearray(body)), ("e", bytearray(b"")), ("n", None)], "file_id string, content binary")
    pages = spark.createDataFrame([("f", i + 1, i + 1, i * 5000, 5000) for i in range(2000)], "file_id string, page_number bigint, page_pos bigint, byte_offset bigint, byte_length bigint")
    edits = pages.select("file_id", F.col("byte_offset").alias("at"), F.lit(3).alias("size"), F.lit("ab").alias("text"))
    began = time.time()
    done = {r.file_id: r.content for r in surgery.edit(files, edits).collect()}
    want = bytearray(body)
    for i in range(2000):
        want[i * 5000 : i * 5000 + 3] = "ab ".encode("cp037")
    assert bytes(done["f"]) == bytes(want) and done["n"] is None and bytes(done["e"]) == b""
    order = pages.select("file_id", (2001 - F.col("page_pos")).alias("position"), "page_pos")
    back = surgery.reassemble(files, pages, order).first()
    assert bytes(back.content) == b"".join(body[i * 5000 : (i + 1) * 5000] for i in reversed(range(2000))) + body[10_000_000:]
    nodes = pages.select("file_id", F.col("byte_offset").alias("offset"), (F.col("byte_offset") + 10).alias("end_offset"))
    assert all(bytes(r.content) == body[r.offset : r.end_offset] for r in surgery.subtree_bytes(files, nodes).collect())
    assert time.time() - began < 60


def test_merges_hold_no_group_in_a_row(spark, sf_dir):
    from leafstream.plans.queries import QUERIES

    for name in ("concat_files", "merge_single"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"collect_list\([^)]*(content|body)", plan), plan


# ---- exports


def test_exports(spark):
    pages = spark.createDataFrame([("f", 1, "a <b> & c"), ("f", 2, "d")], "file_id string, page_pos bigint, text string")
    html = sinks.html_documents(pages).first().html
    assert "a &lt;b&gt; &amp; c" in html and html.index("page-1") < html.index("page-2")
    meta = spark.createDataFrame([("f", "DOC", 2, 2048)], "file_id string, document_name string, total_pages bigint, file_size bigint")
    tag = spark.createDataFrame([("f", 1, "K", "V")], "file_id string, seq bigint, key string, value string")
    made = json.loads(sinks.json_documents(meta, pages, tag).first().json)
    assert made["document"]["size"] == "2.0 KB" and [p["text"] for p in made["pages"]] == ["a <b> & c", "d"] and made["metadata"]["tags"] == [{"key": "K", "value": "V"}]
    parts = spark.createDataFrame([("f", 2, "b", bytearray(b"yy")), ("f", 1, "a", bytearray(b"x"))], "file_id string, part bigint, name string, content binary")
    archive = zipfile.ZipFile(io.BytesIO(bytes(sinks.zip_parts(parts).first().zip)))
    assert archive.namelist() == ["a", "b", "_manifest.txt"] and archive.read("_manifest.txt") == b"a\t1\nb\t2\n" and archive.testzip() is None


def test_exports_take_a_files_tags_once_and_no_row_a_run(spark, sf_dir):
    from leafstream.plans.queries import QUERIES

    plan = QUERIES["json_export"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(".metadata.tags") == 1, plan  # twice within the pairs: all of a file's tags for each of its pages
    for name in ("json_export", "html_export", "page_text"):
        assert "Generate" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_pdf(spark, tmp_path):
    rows = spark.createDataFrame([("f", 1, 612.0, 792.0, bytearray(b"\xff\0\0" * 4), 2, 2), ("f", 2, 10.0, 20.0, None, None, None)], "file_id string, page_pos bigint, width_pt double, height_pt double, rgb binary, px int, py int")
    for r in sinks.pdf_pages(rows).collect():
        data = bytes(r.pdf)
        assert data.startswith(b"%PDF-1.4") and data.endswith(b"%%EOF\n")
        at = int(re.search(rb"startxref\n(\d+)", data)[1])
        for i, place in enumerate(re.findall(rb"(\d{10}) 00000 n", data[at:]), 1):
            assert data[int(place) :].startswith(b"%d 0 obj" % i)
    written = sinks.write_files(spark.createDataFrame([("a/b.bin", bytearray(b"xyz"))], "name string, content binary"), str(tmp_path / "out")).collect()
    assert [tuple(r) for r in written] == [("a%2Fb.bin", 3)] and (tmp_path / "out" / "a%2Fb.bin").read_bytes() == b"xyz"


# ---- composition, files, scalars


def test_compose(spark):
    size = spark.range(1).select(*[c.alias(n) for n, c in compose.canvas(F.lit(12240), F.lit(15840), F.lit(1440), 96).items()]).first()
    assert tuple(size) == (816, 1056)
    assert one(spark, compose.thumbnail_scale(F.col("w"), F.col("h")), w=240.0, h=170.0) == 0.5
    items = spark.createDataFrame([("f", 1, 1, "text", 0.0, 0.0, 10.0, 10.0, "a"), ("f", 1, 2, "text", 3.0, 3.0, 10.0, 10.0, "b")], "file_id string, page_pos int, z int, kind string, x double, y double, w double, h double, payload string")
    assert compose.hit_test(compose.display_list(items), ["file_id"], 4, 4).first().hit.payload == "b"
    assert compose.hit_test(items, ["file_id"], 400, 4).count() == 0


def test_file_source(spark, tmp_path):
    (tmp_path / "a.afp").write_bytes(stream(F1))
    (tmp_path / "b.afp").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_bytes(b"x")
    got = file_source.print_files(spark, str(tmp_path))
    assert sorted(r.name for r in file_source.listing(spark, str(tmp_path)).collect()) == ["a.afp", "b.afp"]
    assert [r.name for r in file_source.accepted(got).collect()] == ["a.afp"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.afp").write_bytes(stream(F1))
    assert file_source.print_files(spark, str(tmp_path)).select("file_id").distinct().count() == 3
    (tmp_path / "sub" / "a.afp").unlink()
    assert [tuple(r) for r in file_source.rejected(got).collect()] == [("b.afp", "not a print file")]
    assert file_source.named(spark, str(tmp_path), "a.afp").count() == 1
    with pytest.raises(ValueError):
        file_source.named(spark, str(tmp_path), "../a.afp")


def test_oversized_files_are_told_not_dropped(spark, tmp_path, monkeypatch):
    (tmp_path / "small.afp").write_bytes(stream(["BDT"]))
    (tmp_path / "large.afp").write_bytes(stream(["BDT"]) * 100)
    monkeypatch.setattr(file_source, "LARGEST", 1000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 999)  # stands for the 2 GB that no row can pass
    try:
        assert {r.name for r in file_source.listing(spark, str(tmp_path)).collect()} == {"small.afp", "large.afp"}
        assert [tuple(r) for r in file_source.oversized(spark, str(tmp_path)).collect()] == [("large.afp", "too large")]
        with pytest.raises(Exception, match="large.afp"):
            file_source.print_files(spark, str(tmp_path)).agg(F.sum(F.length("content"))).collect()
        assert [r.name for r in file_source.print_files(spark, str(tmp_path), skip_oversized=True).select("name", "content").collect()] == ["small.afp"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


@pytest.mark.parametrize("text,query", [("aaaa", "aa"), ("abcabcab", "abc"), ("a.b*a.b*", "a.b*"), ("", "x"), ("x", "xy"), ("\\E\\E", "\\E"), ("ababab", "abab")])
def test_positions(spark, text, query):
    want = [i for i in range(len(text) - len(query) + 1) if text[i : i + len(query)] == query]
    assert one(spark, scalars.positions(F.col("t"), query), t=text) == want


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "aaaa", "héllo wörld"])
def test_trigrams(spark, text):
    want = {text[i : i + 3] for i in range(len(text) - 2)} if len(text) > 2 else {text} - {""}
    got = one(spark, scalars.trigrams(F.col("t")), t=text)
    assert set(got) == want and len(got) == len(want)


def test_scalars(spark):
    assert one(spark, scalars.js_round(F.col("x")), x=-0.5) == 0 and one(spark, scalars.js_round(F.col("x")), x=2.5) == 3
    assert one(spark, scalars.snippet(F.col("t"), F.lit(40), 3), t="x" * 100) == "..." + "x" * 63 + "..."
    assert one(spark, scalars.image_kind(F.col("b")), b=bytearray(b"\x89PNG")) == "png"
    assert one(spark, scalars.orientation_from_degrees(F.col("d")), d=-50) == 270
    assert one(spark, scalars.part_name(F.lit("s"), F.lit(7), F.lit(1200)), x=1) == "s_part0007"


# ---- streaming


def test_page_stream_equals_batch(spark, tmp_path):
    """Chunks out of order and again, over several batches; a file that ends within its last page, one within its last field."""
    from leafstream.operators import pages

    whole = stream("BDT BPG PGD EPG BPG EPG BPG EPG EDT".split())
    bodies = {"whole": whole, "open": stream("BDT BPG EPG BPG PGD TLE".split()), "cut": stream("BDT BPG EPG BPG PGD".split())[:-5], "garbage": stream("BDT BPG EPG BPG".split(), b"\r\n") + b"\0\0"}
    rng, chunks = random.Random(3), []
    for f, content in bodies.items():
        at, n = 0, 0
        while at < len(content):
            size = rng.randint(1, 30)
            chunks.append((f, n, bytearray(content[at : at + size]), at + size >= len(content)))
            at, n = at + size, n + 1
    again = rng.sample(chunks, 5)
    rng.shuffle(chunks)
    source, schema, third = tmp_path / "chunks", "file_id string, chunk_no bigint, content binary, last boolean", len(chunks) // 3 + 1
    for i, part in enumerate((chunks[:third], chunks[third : 2 * third] + again, chunks[2 * third :])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{source}/{i}")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        given = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))
        query = streaming.page_stream(given).writeStream.format("memory").queryName("stream_pages").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.unset(provider)
    files = spark.createDataFrame([(f, bytearray(c)) for f, c in bodies.items()], "file_id string, content binary")
    want = pages.page_index(framing.frames(files)).select("file_id", "page_number", "byte_offset", "byte_length")
    assert sorted(map(tuple, spark.table("stream_pages").collect())) == sorted(map(tuple, want.collect()))


def test_events_of_a_running_scan(spark, tmp_path):
    """Pages as they are found, progress between them, the end of each file; the listener's totals, and an error."""
    import time

    body, told = stream(["BDT", *["BPG", "EPG"] * 7, "EDT"]), []
    chunks = [("f", i, bytearray(body[i * 40 : i * 40 + 40]), i == (len(body) - 1) // 40) for i in range((len(body) + 39) // 40)]
    source, schema = tmp_path / "chunks", "file_id string, chunk_no bigint, content binary, last boolean"
    for i, part in enumerate((chunks[:2], chunks[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{source}/{i}")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    watch = streaming.Watch(told.append)
    spark.streams.addListener(watch)
    try:
        read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))
        query = streaming.event_stream(read(), 3).writeStream.format("memory").queryName("stream_events").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()
        events = [json.loads(r.event) for r in spark.table("stream_events").collect()]
        assert [e["type"] for e in events] == ["page"] * 3 + ["progress"] + ["page"] * 3 + ["progress", "page", "complete"]
        assert [e["page_number"] for e in events if e["type"] == "page"] == list(range(1, 8)) and events[-1] == {"type": "complete", "pages": 7, "file_size": len(body)}
        assert [(e["pages"], e["bytes_scanned"]) for e in events if e["type"] == "progress"] == [(3, 17 + 3 * 18), (6, 17 + 6 * 18)]
        until = time.time() + 30
        while time.time() < until and not any(t["type"] == "complete" for t in told):
            time.sleep(0.2)
        assert told[-1] == {"type": "complete", "pages": 7, "files": 1} and [t["type"] for t in told[:-1]] == ["progress"] * (len(told) - 1) and told[-2]["pages"] == 7
        broken = read().withColumn("chunk_no", F.expr("if(chunk_no = 3, cast(raise_error('bad chunk') as bigint), chunk_no)"))
        query = streaming.event_stream(broken, 3).writeStream.format("memory").queryName("broken_events").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
        with pytest.raises(Exception, match="bad chunk"):
            query.processAllAvailable()
        while time.time() < until + 30 and told[-1]["type"] != "error":
            time.sleep(0.2)
        assert told[-1]["type"] == "error" and "bad chunk" in told[-1]["message"]
    finally:
        spark.streams.removeListener(watch)
        spark.conf.unset(provider)
    with pytest.raises(ValueError):
        streaming.event_stream(spark.createDataFrame([], schema), 0)


def test_incremental_index_and_events(spark, tmp_path):
    from leafstream.operators import pages

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.afp").write_bytes(stream("BDT BPG EPG BPG EPG EDT".split()))
    make = lambda b: pages.page_index(framing.frames(b))
    streaming.write_index(streaming.file_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp"), make).awaitTermination()
    index = spark.read.parquet(str(tmp_path / "out"))
    assert index.count() == 6
    events = [json.loads(r.event) for r in streaming.index_events(index.where("file_id LIKE '%/0.afp'"), 2).collect()]
    assert [e["type"] for e in events] == ["page", "page", "progress", "complete"] and events[-1]["pages"] == 2


# ---- code pages, fonts, selections, borders


def field(kind, data=b""):
    return b"\x5a" + (len(data) + 8).to_bytes(2, "big") + bytes.fromhex(kind) + b"\0\0\0" + data


def name(text):
    return text.ljust(8).encode("cp037")


def test_embedded_code_pages(spark):
    from leafstream.operators import codepages

    entries = bytes.fromhex("0500004151" + "0500004252")
    body = field("D3A889", name("T1000001")) + field("D3AC89", entries) + field("D3A989") + field("D3A8A8", name("D")) + field("D3A889", name("LATE")) + field("D3A989")
    got = codepages.embedded(opened(spark, body)[1]).collect()
    assert [r["name"] for r in got] == ["T1000001"]
    assert (got[0].mapping[0x51], got[0].mapping[0x52], got[0].mapping[0xC1], got[0].mapping[0x02]) == (0x41, 0x42, 0x41, 0xFFFD)
    assert list(codepages.index_entries(bytes.fromhex("0041" + "00" * 8 + "0042" + "00" * 8))) == [(0x40, 0x41), (0x41, 0x42)]


def test_font_containers(spark):
    from leafstream.operators import codepages

    box = lambda n, f=None: field("D3A8CE", name(n)) + (field("D3A689", f.ljust(32).encode("cp037")) if f else b"") + field("D3A9CE", name(n))
    sf = opened(spark, box("C0FL2080", "HELVETICA") + box("T1001144") + box("C0FL2080", "OTHER") + box("IMAGE"))[1]
    fonts = codepages.font_containers(sf)
    assert sorted(tuple(r)[1:] for r in fonts.collect()) == [("C0FL2080", "Latin", "Bold", "HELVETICA", ""), ("T1001144", "Code Page", "—", "", "CP297 (French)")]
    assert [r.family for r in codepages.font_families(fonts).collect()] == ["HELVETICA"]


def test_selection(spark):
    from leafstream.operators import selection

    pages = spark.createDataFrame([("f", i) for i in range(1, 6)], "file_id string, page_pos bigint")
    some = selection.between(pages, 4, 2)
    at = lambda d: sorted(r.page_pos for r in d.collect())
    assert at(some) == [2, 3, 4] and at(selection.inverted(pages, some)) == [1, 5]
    assert at(selection.toggled(some, selection.between(pages, 4, 5))) == [2, 3, 5] and at(selection.everything(pages)) == [1, 2, 3, 4, 5]
    from leafstream.operators import pages as paging

    sf = opened(spark, stream("BDT BPG BPT EPT BPT EPT EPG EDT".split()))[1]
    assert [r.offset for r in selection.nth_field(sf, paging.page_index(sf), ["D3A89B"], 1).collect()] == [44]


def test_borders_and_boxes():
    black = np.zeros((50, 60), np.uint8)
    black[:, :2] = black[:3] = black[:, -1:] = 1
    assert images.cropped(black).shape == (47, 57) and images.cropped(np.zeros((5, 5), np.uint8)).shape == (5, 5)
    inverse = {"width": 16, "height": 2, "bits": 1, "data": b"\xff\xfe\xff\xff"}
    assert images.black_pixels(inverse).tolist()[0] == [0] * 15 + [1]
    box = bytes.fromhex("6880C00A0000" + "0001000200030004" + "60")
    assert images.vector_boxes(box * 11) == [(1, 2, 3, 4)] * 11 and images.vector_boxes(box) == []


def test_included_objects(spark):
    from leafstream.operators import resources

    body = field("D3A892", name("LOGO")) + field("D3EE92", b"pix") + field("D3EE92", b"els") + field("D3A992") + field("D3A8A8", name("D")) + field("D3AFC3", name("LOGO") + bytes.fromhex("00000028A0")) + field("D3AFC3", name("NONE"))
    sf = opened(spark, body)[1]
    got = resources.included_objects(sf, resources.inline_images(sf)).collect()
    assert [(r["name"], r.x, bytes(r.data)) for r in got] == [("LOGO", 0x28A0, b"pixels")]


@pytest.mark.parametrize("query", ["abc", "bca", "k = v", "zzz", "ab", "K = vab"])
def test_search_with_and_without_postings(spark, query):
    from leafstream.operators import search

    rng = random.Random(5)
    rows = [("f", i, "".join(rng.choice("abcABC ") for _ in range(rng.randint(0, 80)))) for i in range(40)]
    pages = search.search_pages(spark.createDataFrame(rows, "file_id string, p bigint, t string"), ["file_id"], "p", "t")
    tags = search.search_tags(spark.createDataFrame([("f", i, i, "K", "v" + t[:9]) for _, i, t in rows], "file_id string, p bigint, seq bigint, key string, value string"), ["file_id"], "p")
    posted = search.postings(pages, ["file_id"], "text_lower", "text").unionByName(search.postings(tags, ["file_id"], "combined_lower", "tag"))
    plain = search.search(pages, tags, ["file_id"], query, "all", 1000).collect()
    assert plain == search.search(pages, tags, ["file_id"], query, "all", 1000, posted).collect()
    want = sum(t.lower()[i : i + len(query)] == query.lower() for _, _, t in rows for i in range(len(t))) + sum(query.lower() in ("k = v" + t[:9]).lower() for _, _, t in rows)
    assert len(plain) == want


@pytest.mark.parametrize("blank", ["", "  "])
def test_blank_search_finds_nothing(spark, blank):
    from leafstream.operators import search

    pages = search.search_pages(spark.createDataFrame([("f", 1, "a b")], "f string, p bigint, t string"), ["f"], "p", "t")
    tags = search.search_tags(spark.createDataFrame([("f", 1, 0, "k", "v")], "f string, p bigint, seq int, key string, value string"), ["f"], "p")
    assert search.search(pages, tags, ["f"], blank).count() == 0


def test_parameter_checks():
    from leafstream.functions import checks

    key = "123E4567-e89b-12d3-a456-426614174000"
    assert checks.search_request(key, " x ", "tag", "1000") == {"file_id": key.lower(), "query": "x", "kind": "tag", "most": 1000}
    assert checks.render_request(key, "7", 36, "pdf")["dpi"] == 36
    for bad in (lambda: checks.search_request("x", "q"), lambda: checks.search_request(key, " "), lambda: checks.search_request(key, "q", "any"), lambda: checks.search_request(key, "q", most=0), lambda: checks.search_request(key, "q", most=1001), lambda: checks.render_request(key, 0), lambda: checks.render_request(key, 1, 601), lambda: checks.render_request(key, 1, 96, "gif"), lambda: checks.page_number("1.5")):
        with pytest.raises(ValueError):
            bad()


def test_barcode_text_and_editable(spark):
    from leafstream.operators import assembly

    assert one(spark, assembly.barcode_text(F.col("b")), b=bytearray(bytes.fromhex("F1F2F3"))) == "123"
    assert one(spark, assembly.barcode_text(F.col("b")), b=bytearray(b"\x01AB")[:1]) == ""
    assert [one(spark, assembly.editable(F.col("t")), t=t) for t in ("D3A090", "D3A8AD")] == [True, False]


def test_archive(spark, tmp_path):
    from leafstream.streaming.store import Archive

    archive = Archive(spark, str(tmp_path / "archive"))
    files, _ = opened(spark, stream(F1), stream(F1))
    assert archive.state() == {"batches": 0, "files": 0, "pages": 0}
    assert archive.build(files.where("file_id = 'f0'")) == 1 and archive.build(files) == 1 and archive.build(files) == 0
    assert archive.state() == {"batches": 2, "files": 2, "pages": 2}
    assert [(h.file_id, h.kind) for h in archive.search("hello").collect()] == [("f0", "text"), ("f1", "text")]
    assert archive.search("ACCT", "tag", file_id="f1").count() == 1 and archive.page_index("f0").count() == 1
    changed = spark.createDataFrame([("f0", bytearray(stream("BDT BPG EPG BPG EPG EDT".split())))], "file_id string, content binary")
    assert archive.build(changed) == 1 and archive.state()["pages"] == 3 and archive.search("hello").count() == 1
    archive.reset()
    assert archive.state()["batches"] == 0


def _said(n, word):
    """A print file of n pages with a word of its own each."""
    from leafstream.functions import ebcdic

    text = lambda i: f"{word} page{i:05d} {random.Random(f'{word}{i}').getrandbits(200):x}"
    field = lambda t, d: b"\x5a" + (len(d) + 8).to_bytes(2, "big") + bytes.fromhex(t) + bytes(3) + d
    coded = lambda t: bytes(ebcdic.CP037.index(c) for c in t)
    page = lambda i: field("D3A8AD", b"") + field("D3A89B", b"") + field("D3EE9B", bytes.fromhex("2BD3") + bytes([len(text(i)) + 2, 0xDB]) + coded(text(i))) + field("D3A99B", b"") + field("D3A9AD", b"")
    return field("D3A8A8", b"") + b"".join(page(i) for i in range(n)) + field("D3A9A8", b"")


def _rows_scanned(df):
    """What the scan of a plan without exchanges gave, row groups left out by their statistics not counted."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_archive_reads_its_trigrams_row_groups_only(spark, tmp_path):
    from leafstream.operators import search
    from leafstream.streaming.store import Archive

    archive = Archive(spark, str(tmp_path / "archive"), row_group=1 << 14)
    words = ["amber", "birch", "cedar", "delta"]
    files = spark.createDataFrame([(w, bytearray(_said(1500, w))) for w in words], "file_id string, content binary")
    assert archive.build(files) == 4
    posted = archive.table("postings")
    lists = archive._read("postings", archive._batches())
    assert _rows_scanned(lists.where(F.col("trigram").isin(search.query_trigrams("cedar")))) < lists.count() / 3
    found = search.block_candidates(posted, ["file_id"], "cedar", "text").collect()
    assert len(found) == 1500 and {r.file_id for r in found} == {"cedar"} and {r.page_pos for r in found} == set(range(1, 1501))
    plain = search.candidates(search.postings(archive.table("texts"), ["file_id"], "text_lower", "text"), ["file_id"], "page00123")
    assert sorted(map(tuple, search.block_candidates(posted, ["file_id"], "page00123").collect())) == sorted(map(tuple, plain.collect()))
    hits = archive.search("birch page00007").collect()
    assert [(h.file_id, h.page_pos) for h in hits] == [("birch", 8)]
    assert archive.search("no such words at all").count() == 0 and archive.search("  ").count() == 0 and archive.search("ce", "text").count() == 500


def test_archive_of_many_batches_is_one_scan_and_compacts(spark, tmp_path):
    from leafstream.streaming.store import Archive

    archive = Archive(spark, str(tmp_path / "archive"))
    for i in range(4):
        archive.build(spark.createDataFrame([(f"f{i}", bytearray(_said(2, f"word{i}"))), ("same", bytearray(_said(i + 1, "again")))], "file_id string, content binary"))
    plan = lambda: archive.table("texts")._jdf.queryExecution().optimizedPlan().toString()
    wide = len(plan().splitlines())
    assert plan().count("Relation [") == 2  # the table and the list of files
    state = archive.state()
    assert state == {"batches": 4, "files": 5, "pages": 4 * 2 + 4}
    said = sorted(map(str, archive.table("texts").collect()))
    assert archive.compact() == 4
    assert archive.state() == state | {"batches": 1} and sorted(map(str, archive.table("texts").collect())) == said
    assert len(plan().splitlines()) == wide and archive.search("again page00003").count() == 1
    assert archive.build(spark.createDataFrame([("f0", bytearray(_said(2, "word0")))], "file_id string, content binary")) == 0  # still known
    assert archive.build(spark.createDataFrame([("f0", bytearray(_said(1, "other")))], "file_id string, content binary")) == 1
    assert archive.search("word0").count() == 0 and archive.search("other").count() == 1


def test_builders_at_once_both_count_and_an_aborted_one_leaves_nothing(spark, tmp_path):
    import threading
    import time

    from leafstream.streaming.store import Archive

    folder, failed = str(tmp_path / "archive"), []
    frames = [spark.createDataFrame([(f"f{i}", bytearray(_said(3, f"word{i}")))], "file_id string, content binary") for i in range(2)]
    threads = [threading.Thread(target=lambda df=df: Archive(spark, folder).build(df)) for df in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    archive = Archive(spark, folder)
    assert archive.state() == {"batches": 2, "files": 2, "pages": 6}

    @F.udf("binary")
    def slow(i):
        time.sleep(1)
        return _said(1, f"slow{i}")

    late = spark.range(0, 80, 1, 4).select(F.concat(F.lit("s"), "id").alias("file_id"), slow("id").alias("content"))

    def build():
        try:
            archive.build(late)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    running = threading.Thread(target=build)
    running.start()
    time.sleep(5)
    archive.abort()
    running.join(60)
    assert failed and archive.state() == {"batches": 2, "files": 2, "pages": 6}
    assert not [n for n in os.listdir(f"{folder}/files") if n.startswith(".passing")] and len(os.listdir(f"{folder}/texts")) == 2
    assert archive.build(frames[0]) == 0 and archive.search("word1").count() == 3


def test_stream_into_an_archive(spark, tmp_path):
    from leafstream.streaming.store import Archive

    folder = tmp_path / "in"
    folder.mkdir()
    archive = Archive(spark, str(tmp_path / "archive"))
    for i in range(2):
        (folder / f"{i}.afp").write_bytes(stream(F1))
        archive.build_stream(streaming.file_stream(spark, str(folder)), str(tmp_path / "checkpoint")).awaitTermination()
        assert archive.search("world").count() == i + 1  # found as soon as its batch is in


def test_plans_frame_once(spark, sf_dir):
    """What a query over print files leaves to Python in its final plan."""
    import re

    from leafstream.plans.queries import QUERIES

    for name in ("page_index", "page_text", "search_all", "batch_split", "diagnostics_summary", "merge_single", "scan_index", "tle_extract"):
        df = QUERIES[name](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
        assert len(re.findall(r"MapInArrow|ArrowEvalPython", final)) <= 2, (name, final)


def test_posting_lists_equal_rows_without_a_row_a_page_and_trigram(spark, monkeypatch):
    """Lists of batches, cut anywhere and merged, hold what postings() has: short, empty and null texts, characters of any plane, several rows a page."""
    from leafstream.operators import search

    rng = random.Random(5)
    rows = [(f"f{i % 3}", rng.choice([1, 7, 4095, 4096, 4097, 9000]) + i % 4, rng.choice([None, "", "a", "ab", "\U0001f600b", "a\0b\0c", "abcabc", "\ud7ff\uffff\U0010ffffx", "".join(rng.choice("abc \u00e4") for _ in range(60))])) for i in range(300)]
    pages = spark.createDataFrame(rows, "file_id string, page_pos bigint, t string").repartition(5)
    want = {tuple(r) for r in search.postings(pages, ["file_id"], "t", "text").select("file_id", "scope", "trigram", "page_pos").collect()}
    for most in (1, 200, search.LISTED):
        monkeypatch.setattr(search, "LISTED", most)
        lists = search.merged_blocks(search.posting_blocks(pages, ["file_id"], "t", "text"), ["file_id"]).collect()
        assert {(r.file_id, r.scope, r.trigram, r.block * search.BLOCK_PAGES + p) for r in lists for p in r.pages} == want
        assert len(lists) == len({(r.scope, r.trigram, r.file_id, r.block) for r in lists}) and all(r.pages == sorted(set(r.pages)) for r in lists)
    assert "explode" not in search.posting_blocks(pages, ["file_id"], "t", "text")._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_tasks_share_does_not_grow_with_the_table(spark, sf_dir, monkeypatch):
    """Parts of held_resources and lines of interval_join: the tables are dealt into more partitions as they grow, and nothing puts them together again."""
    from leafstream.plans import decoding, fixtures, queries

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fixtures.shares(spark, sf_dir, "part", fixtures.TASK_FILES) == n
    monkeypatch.setattr(fixtures, "TASK_FILES", 20)
    monkeypatch.setattr(fixtures, "TASK_RECORDS", 500)
    for made, table, rows, by in ((decoding.held_resources, "part", 20, "file_id"), (queries.interval_join, "lineitem", 500, "file")):
        parts = -(-fixtures.table(spark, sf_dir, table).count() // rows)
        plan = made(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert parts > n and f", {parts}), REPARTITION_BY_NUM" in plan
        assert "SortMergeJoin" not in plan and "ENSURE_REQUIREMENTS" not in plan, by


def test_islands_close_at_their_first_end(spark):
    """Payloads behind an end, before a begin, and of a begin within an open run."""
    kinds = ["P", "B", "P", "B", "P", "P", "E", "P", "E", "B", "E", "E", "P"]
    sf = spark.createDataFrame([("f", i * 10, k, bytes([i])) for i, k in enumerate(kinds)], "file_id string, offset bigint, type_id string, data binary")
    from leafstream.operators.islands import begin_end_islands

    got = {r.begin_offset: bytes(r.data) for r in begin_end_islands(sf, "B", "E", ["P"], F.lit("n")).collect()}
    assert got == {10: b"\x02", 30: b"\x04\x05", 90: b""}


def test_reordered_files_come_one_a_batch(spark, sf_dir, monkeypatch):
    """What Python holds of extract_pages, delete_pages and move_pages is a file a task, not all files of a task."""
    from leafstream.plans import queries
    from leafstream.sources import tables

    seen, put = [], tables.Shelf.put
    monkeypatch.setattr(tables.Shelf, "put", lambda self, df: (seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), put(self, df))[1])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for made in (queries.extract_pages, queries.delete_pages, queries.move_pages):
        assert made(spark, sf_dir).count() > 0
    assert seen == ["1"] * 3 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_first_hits_are_cut_before_their_excerpts(spark):
    """Only the first pages are searched on and only the first hits cut: the same hits, also of repeated pages."""
    from leafstream.operators import search

    rng = random.Random(11)
    rows = [(rng.choice("ab"), rng.randint(1, 9), "".join(rng.choice("ex ") for _ in range(rng.randint(0, 60)))) for _ in range(80)]
    pages = search.search_pages(spark.createDataFrame(rows, "file_id string, page_pos bigint, text string"), ["file_id"], "page_pos", "text")
    found = search.text_hits(pages, ["file_id"], "ee").collect()
    for most in (1, 7, 40, 1000):
        some = search.text_hits(pages, ["file_id"], "ee", most=most).collect()
        place = lambda r: (r.file_id, r.page_pos, r.seq)
        assert sorted(map(place, some)) == sorted(map(place, found))[:most] and not set(some) - set(found)


def test_places_of_an_order_are_read_once(monkeypatch):
    """Bounds and display lists are made of the same places."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    seen, points = [], graphics.points
    monkeypatch.setattr(graphics, "points", lambda code, p: (seen.append(code), points(code, p))[1])
    data = bytes.fromhex("C108000100020003FFFC" "C00A0000FFFF000200050006" "C6080001000200030005")
    arrow = to_arrow_schema(_parse_datatype_string(f"k bigint, {graphics._OUT}"))
    (made,) = graphics.drawn(iter([pa.RecordBatch.from_arrays([pa.array([7]), pa.array([data])], names=["k", "data"])]), arrow, 2.0)
    (row,) = made.to_pylist()
    assert len(seen) == 3 and (row["x"], row["y"], row["width"], row["height"], row["n_orders"]) == (-2, -4, 7, 10, 3)
    assert row["ops"] == graphics.display(graphics.parse(data), 2.0) and [o["coords"] for o in row["ops"]] == [[2.0, 4.0, 6.0, -8.0], [-2.0, 4.0, 12.0, 8.0], [2.0, 4.0, 6.0, 0.0, 0.0, 5.0]]
