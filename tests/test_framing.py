import random

import pytest
from pyspark.sql import functions as F

from leafstream.functions import ebcdic
from leafstream.operators import diagnostics, islands, nesting, pages, ptoca, resources, tags
from leafstream.operators.asof import tag_pages
from leafstream.sources import datasource, framing, wire
from leafstream.streaming import index as streaming

# A document with a group, a tag, a page with a page descriptor, fonts, text and an included segment.
PARTS = {
    "BDT": "5A0010D3A8A8000000C4D6C3F0F0F0F0F1", "BNG": "5A0010D3ABCA000000C7D9D7F0F0F0F0F1", "TLE": "5A0019D3A09000000008020B00C1C3C3E309360000F1F2F3F4F5",
    "BPG": "5A0008D3A8AD000000", "PGD": "5A0014D3A6AF000000000038403840002FD0003DE0", "MCF": "5A002CD3AB8A0000000012042405050C028600C3F0C6D3F2F0C1F00012042405070C028600C3F0C6D4F2F0C5F0",
    "BPT": "5A0008D3A89B000000", "PTX": "5A0023D3EE9B0000002BD304C7012C04D201F403F10707DBC8C5D3D3D607DBE6D6D9D3C4", "EPT": "5A0008D3A99B000000", "IPS": "5A0016D3AF5F000000D3D6C7D6F0F0F0F10005A00002D0",
    "EPG": "5A0008D3A9AD000000", "ENG": "5A0008D3A9CA000000", "EDT": "5A0008D3A9A8000000", "UTF": "5A002BD3EE9B0000002BD304C7012C04D301F403F10216DB004A006F0068006E00200053006D006900740068",
}
F1 = "BDT BNG TLE BPG PGD MCF BPT PTX EPT IPS EPG ENG EDT".split()


def stream(names, between=b""):
    return between.join(bytes.fromhex(PARTS[n]) for n in names)


def opened(spark, *contents):
    files = spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "file_id string, content binary")
    return files, framing.frames(files)


def test_fixture(spark):
    _, sf = opened(spark, stream(F1))
    rows = sf.orderBy("offset").collect()
    assert [(r.offset, r.length + 1, r.type_id) for r in rows][:4] == [(0, 17, "D3A8A8"), (17, 17, "D3ABCA"), (34, 26, "D3A090"), (60, 9, "D3A8AD")]
    assert len(rows) == 13 and not any(r.truncated for r in rows)
    page = pages.scan_index(sf).first()
    assert (page.page_number, page.byte_offset, page.byte_length, page.document_index, page.document_name, page.has_text, page.has_text_any, page.object_count) == (1, 60, 161, 0, "GRP00001", False, True, 1)
    best = pages.page_index(sf).collect()
    assert [(p.strategy, p.byte_offset, p.byte_length) for p in best] == [("BPG", 60, 161)]
    runs = ptoca.text_runs(ptoca.text_blocks(sf, pages.page_index(sf))).orderBy("run_no").collect()
    assert [(r.x, r.y, r.text, r.font_id, r.bold) for r in runs] == [(300, 500, "HELLO", 7, False), (387, 500, "WORLD", 7, False)]
    box = ptoca.bounds(ptoca.text_runs(ptoca.text_blocks(sf, pages.page_index(sf))), ["file_id", "page_pos"]).first()
    assert (box.x, box.y, box.width, box.height) == (300, 500, 687, 240)
    tag = tags.tags(sf)
    assert tuple(tag.first()) == ("f0", 34, "ACCT", "12345")
    assert tags.with_context(sf, tag).first().context == "document-level"
    assert tag_pages(tag, pages.page_index(sf), ["file_id"]).first().page_pos == 1
    fonts = tags.coded_fonts(sf).orderBy("local_id").collect()
    assert [(f.local_id, f.char_set, f.bold) for f in fonts] == [(5, "C0FL20A0", False), (7, "C0FM20E0", True)]
    geometry = sf.where("type_id = 'D3A6AF'").select(*[c.alias(n) for n, c in resources.page_geometry(F.col("data")).items()]).first()
    assert tuple(geometry) == (1440, 12240, 15840)
    said = {(m.seq, m.severity): m for m in diagnostics.messages(sf).collect()}
    assert said[10, "error"].offset == 189 and "LOGO0001" in said[10, "error"].message


def test_tree(spark):
    _, sf = opened(spark, stream(F1))
    from leafstream.sources.type_dim import is_begin, is_end

    tree = nesting.nested(sf, ["file_id"], ["offset"], is_begin(F.col("type_id")), is_end(F.col("type_id")), "sf_no").orderBy("offset").collect()
    assert [(r.depth, r.parent) for r in tree] == [(0, None), (1, 0), (2, 1), (2, 1), (3, 3), (3, 3), (3, 3), (4, 6), (4, 6), (3, 3), (3, 3), (2, 1), (1, 0)]
    paths = nesting.with_paths(nesting.nested(sf, ["file_id"], ["offset"], is_begin(F.col("type_id")), is_end(F.col("type_id")), "sf_no"), ["file_id"], "sf_no", 5)
    assert paths.where("sf_no = 7").first().path == [0, 1, 3, 6]
    assert nesting.visible(paths, [0, 1]).count() == 6


def test_bold_fonts_before_the_page(spark):
    names = "BDT BNG TLE MCF BPG PGD BPT PTX EPT EPG ENG EDT".split()
    _, sf = opened(spark, stream(names))
    index = resources.page_fonts(pages.page_index(sf), tags.coded_fonts(sf))
    blocks = ptoca.text_blocks(sf, index).join(index.select("file_id", "page_pos", "bold_ids"), ["file_id", "page_pos"])
    runs = ptoca.text_runs(blocks, bold_fonts="bold_ids").orderBy("run_no").collect()
    assert [(r.x, r.bold) for r in runs] == [(300, True), (400, True)]


def test_utf16_text(spark):
    _, sf = opened(spark, stream([*F1[:7], "UTF", *F1[8:]]))
    run = ptoca.text_runs(ptoca.text_blocks(sf, pages.page_index(sf))).collect()
    assert [(r.text, r.font_size, (r.r, r.g, r.b)) for r in run] == [("John Smith", 24.0, (79, 182, 224))]


@pytest.mark.parametrize("names,want", [
    ("BDT BPG BPG EPG EDT", [("BPG", 2, 26, 18)]), ("BDT BPG PGD EDT", [("BPG", 1, 17, 39)]), ("BNG ENG", [("FILE", 1, 0, 26)]), ("BDT EDT", [("BDT", 1, 0, 26)]),
])
def test_page_strategies(spark, names, want):
    _, sf = opened(spark, stream(names.split()))
    assert [(p.strategy, p.page_number, p.byte_offset, p.byte_length) for p in pages.page_index(sf).collect()] == want


def test_unclosed_page_ends_at_the_documents_end(spark):
    _, sf = opened(spark, stream("BDT BPG PGD EDT".split()))
    assert [(p.byte_offset, p.byte_length) for p in pages.scan_index(sf).collect()] == [(17, 30)]


def slow_walk(content):
    """Byte by byte."""
    at, out = 0, []
    while at + 9 <= len(content):
        n = content[at + 1] << 8 | content[at + 2]
        if content[at] == 0x5A and 6 <= n <= 32766:
            out.append((at, n, at + 1 + n > len(content)))
            at += 1 + n
        else:
            at += 1
    return out


def noisy(rng):
    parts = []
    for _ in range(rng.randint(0, 40)):
        data = bytes(rng.choice(b"\x5a\x00\xd3\x41") for _ in range(rng.randint(0, 30)))
        parts.append(b"\x5a" + (len(data) + 8).to_bytes(2, "big") + bytes.fromhex(rng.choice(["D3A8AD", "D3A9AD", "D3EE9B"])) + b"\0\0\0" + data)
        parts.append(bytes(rng.choice(b"\x5a\x0d\x25\xff") for _ in range(rng.choice((0, 0, 0, 3)))))
    whole = b"".join(parts)
    return whole[: len(whole) - rng.choice((0, 0, 4))]


def test_walk_equals_slow_walk_and_splits():
    rng = random.Random(1)
    for _ in range(300):
        content = noisy(rng)
        want = slow_walk(content)
        assert list(framing.walk(content)) == want


def test_splits_find_their_own_start(monkeypatch):
    """With short fields, so that a split begins its search behind the file's beginning."""
    monkeypatch.setattr(framing, "LONGEST", 60)
    monkeypatch.setattr(datasource, "LONGEST", 60)
    rng = random.Random(5)
    for _ in range(200):
        content = b"".join(noisy(rng) for _ in range(rng.randint(1, 4)))
        want = list(framing.walk(content))
        for split in (7, 50, 400):
            got = []
            for a in range(0, len(content), split):
                b = min(a + split, len(content))
                window = datasource.Window(lambda at, n, c=content: c[at : at + n], len(content), a, b + 60 + 10)
                due = datasource.first_due(window, a) if a else 0
                if 0 <= due < b:
                    got += [(at + window.low, n, cut) for at, n, cut in framing.walk(window.data, due - window.low, b - window.low)]
            assert got == want, (split, content)


def test_chunked_scan_equals_whole():
    rng = random.Random(2)
    for _ in range(200):
        content = noisy(rng)
        want, opened_at, n = [], -1, 0
        for at, length, cut in slow_walk(content):
            kind = content[at + 3 : at + 6]
            if cut:
                continue
            if kind == streaming.BEGIN:
                opened_at, n = at, n + 1
            elif kind == streaming.END and opened_at >= 0:
                want.append((n, opened_at, at + 1 + length - opened_at))
                opened_at = -1
        got, carry, base, open_, count = [], b"", 0, -1, 0
        at = 0
        while at < len(content):
            step = rng.randint(1, 60)
            found, carry, base, open_, count, _ = streaming.scan_chunk(carry + content[at : at + step], base, open_, count, False)
            got += found
            at += step
        assert got == want


def test_corrupt_and_garbage(spark):
    files, sf = opened(spark, stream(F1, b"\x00\x0d\x25"), b"\x5a\xff\xff" + stream(F1)[:-4])
    assert sf.where("file_id = 'f0'").count() == 13 and sf.where("file_id = 'f1'").count() == 12
    assert framing.corrupt_fields(files).collect() == [("f1", 0)]
    assert opened(spark, b"", b"no fields here")[1].count() == 0


def test_data_source(spark, tmp_path):
    content = stream(F1 * 50)
    (tmp_path / "a.bin").write_bytes(content)
    spark.dataSource.register(datasource.PrintStream)
    read = lambda **o: spark.read.format("printstream").options(**o).load(str(tmp_path / "*.bin"))
    assert read(splitBytes=500).count() == 650 == read().count()
    assert read(splitBytes=500).where("type_id = 'D3EE9B'").count() == read(splitBytes=500, pushdown="true").where("type_id = 'D3EE9B'").count() == 50
    assert read(payload="false").where("data IS NOT NULL").count() == 0
    assert read(pushdown="true").where("type_id = 'xyz'").count() == 0 and "sf_no" not in read().columns
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.bin").write_bytes(content)
    assert spark.read.format("printstream").load(str(tmp_path)).select("file_id").distinct().count() == 2


def test_wire_round_trip(spark):
    text = "Hällo\nwörld " * 3000
    df = spark.createDataFrame([(1, text), (2, ""), (3, "x")], "doc_id bigint, text string")
    made = df.select(F.lit("f").alias("file_id"), "doc_id", wire.page([("K", F.col("doc_id").cast("string"))], F.col("text")).alias("page"))
    sf = framing.frames(wire.file_content(made, ["file_id"], ["doc_id"], "page", F.lit("N")))
    index = pages.page_index(sf)
    runs = ptoca.text_runs(ptoca.text_blocks(sf, index))
    got = runs.where("page_pos = 1").orderBy("run_no").collect()
    assert "".join(r.text for r in got) == text.replace("\n", "")
    assert index.count() == 3


def test_page_texts_equal_runs_gathered(spark, tmp_path):
    pages_of = lambda *blocks: "5A0008D3A8AD000000" + "".join("5A0008D3A89B000000" + "".join(blocks_field(p) for p in b) + "5A0008D3A99B000000" for b in blocks) + "5A0008D3A9AD000000"

    def blocks_field(payload: str) -> str:
        return f"5A{len(payload) // 2 + 8:04X}D3EE9B000000{payload}"

    said = lambda raw: f"{len(raw) // 2 + 2:02X}DB{raw}"
    utf16 = "2BD3" + said("".join(f"{ord(c):04X}" for c in "wide text")) + said("3000" * 5) + said("0085" + "0041" * 4)
    one = [
        pages_of(["2BD3" + said("C1C2"), said("40404140") + said("0005C3")], ["2BD3" + said("C4")]),  # a block of two fields, a blank run, a second block
        pages_of(), pages_of([]), pages_of(["2BD3" + said("41") + said("0025")]),  # no block, an empty one, blanks only
        pages_of([utf16]), pages_of(["2BDA03C1C2C3", "C440"]),  # wide characters, the escape dialect
    ]
    other = "".join(pages_of(["2BD3" + said(f"{0xF0 + i % 10:02X}")]) for i in range(300))
    files = spark.createDataFrame([("a", bytes.fromhex("".join(one))), ("b", bytes.fromhex(other)), ("c", b""), ("d", bytes.fromhex("5A0008D3EE9B000000"))], "file_id string, content binary")
    sf = framing.frames(files)
    index = pages.page_index(sf)
    want = {(r.file_id, r.page_pos): "" for r in index.collect()} | {(r.file_id, r.page_pos): r.text for r in ptoca.page_text(ptoca.text_runs(ptoca.text_blocks(sf, index)), ["file_id", "page_pos"]).collect()}
    got = {(r.file_id, r.page_pos): r.text for r in ptoca.page_texts(sf, index).collect()}
    assert got == want and len(got) == index.count() == 307
    assert [got["a", i] for i in range(1, 7)] == ["AB C D", "", "", "", "wide text \x85AAAA", "AB CD "]


def test_text_of_a_run_is_the_code_pages_less_controls(spark):
    every = bytes(range(256))
    for table in [ebcdic.code_page(n) for n in ("cp037", "cp500", "cp297")] + ["\ufffe\x85\U0001f600" + "x" * 253]:
        want = "".join(c for c in table if not ("\x00" <= c <= "\x1f" or "\x7f" <= c <= "\x9f"))
        assert ptoca._State(table, frozenset()).text_of(every) == want
    points = [i for i in range(0x10000) if not 0xD800 <= i <= 0xDFFF]
    blank = spark.createDataFrame([(i, chr(i)) for i in points], "i int, c string").where(ebcdic.js_trim(F.col("c")) == "").collect()
    assert {r.c for r in blank} == set(ebcdic.SPACES)


def test_labels_and_groups(spark):
    other = PARTS["TLE"].replace("F1F2F3F4F5", "F9F9F9F9F9")
    body = "".join(PARTS[n] for n in ("BDT", "BPG", "EPG", "TLE", "BPG", "EPG", "BPG", "EPG")) + other + "".join(PARTS[n] for n in ("BPG", "EPG", "EDT"))
    _, sf = opened(spark, bytes.fromhex(body))
    labelled = islands.page_labels(tags.tags(sf), pages.page_index(sf), "ACCT")
    groups = islands.document_groups(labelled, ["file_id"], "page_pos", "label").orderBy("start_page").collect()
    assert [(g.label, g.start_page, g.end_page) for g in groups] == [("12345", 2, 3), ("99999", 4, 4)]


ESCAPED = [
    ("2BC0030064 C1", [(100, 0, "A")]), ("2BC0030064 2BC803FFF6 C1", [(90, 0, "A")]), ("2BD2030032 2BD4030005 C1", [(0, 55, "A")]), ("2BDA03C1C2 C3", [(0, 0, "AB"), (240, 0, "C")]),
    ("2BD001 2BD003000A 2BD801 C1", [(0, 10, "A")]), ("2BD801 C1", [(0, 240, "A")]), ("2BEE040003C1", [(0, 0, "AAA")]), ("2BE40500320002 C1", [(0, 0, ""), (50, 0, "A")]), ("2BE60500320002 C1", [(0, 0, ""), (0, 0, "A")]),
    ("2B9900 C1", [(0, 0, "A")]), ("C12BF802 99", [(0, 0, "A")]),
]


@pytest.mark.parametrize("data,want", ESCAPED)
def test_escape_dialect(data, want):
    assert [(r["x"], r["y"], r["text"]) for r in ptoca.interpret(bytes.fromhex(data.replace(" ", "")))] == want


def test_colors_orientation_and_rotation():
    run = ptoca.interpret(bytes.fromhex("2B800600010A1420" + "C1"))[0]
    assert (run["r"], run["g"], run["b"]) == (10, 20, 32)
    assert ptoca.interpret(bytes.fromhex("2B800202" + "C1"))[0]["r"] == 255
    assert ptoca.interpret(bytes.fromhex("2BF60500B40000" + "C1"))[0]["orientation"] == 90
    rotated = ptoca.interpret(bytes.fromhex("2BD3" + "04F78700" + "03DBC1" + "03DBC2"))
    assert [(r["x"], r["text"], r["orientation"], r["font_size"]) for r in rotated] == [(60, "AB", 270, 6.0)]
    steps = ptoca.interpret(bytes.fromhex("2BD3" + "04D3000A" + "02D9" + "03DBC1" + "04D30200" + "03DBC2"))
    assert [r["y"] for r in steps] == [10, 512]


def test_code_pages(spark):
    assert len(set(ebcdic.CP500)) == 250 and ebcdic.CP500[0xB5] == "@" and ebcdic.CP297[0x5A] == "é"
    every = spark.createDataFrame([(bytearray(range(1, 256)),)], "b binary")
    for name, table in (("cp037", ebcdic.CP037), ("cp500", ebcdic.CP500), ("cp297", ebcdic.CP297)):
        assert every.select(ebcdic.decode(F.col("b"), name)).first()[0] == table[1:]
    back = every.select(F.hex(ebcdic.encode(ebcdic.decode(F.col("b"))))).first()[0]
    assert bytes.fromhex(back) == bytes(range(1, 256))
    assert spark.createDataFrame([("a€b",)], "t string").select(F.hex(ebcdic.encode(F.col("t")))).first()[0] == "813F82"
    with pytest.raises(ValueError):
        ebcdic.code_page("cp1047")
    with pytest.raises(ValueError):
        ebcdic.register_code_page("short", "abc")
    ebcdic.register_code_page("mine", list(range(256)))
    assert ebcdic.code_page("MINE")[65] == "A"
    names = spark.createDataFrame([(bytearray.fromhex("C1C2406D40"),)], "b binary")
    assert tuple(names.select(*[ebcdic.decode_name(F.col("b"), p) for p in ("group", "tag", "label")]).first()) == ("AB", "AB _", "AB")


class Given:
    """Stands for a frame: keeps what is to run over its batches."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def test_small_files_share_batches():
    """As many fields as each file alone has, in a few batches; large files between them, cut ones, empty ones and nulls."""
    import pyarrow as pa

    small, large = [stream(F1)[: 40 + i % 50] for i in range(3000)], stream(F1 * 2000)
    files = [*small[:1500], large, b"", None, b"Z" * 30, stream(F1) + b"Z\0\1\0" * 3 + bytes(9), *small[1500:]]
    given = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(len(files))]), pa.array(files, pa.binary())], names=["file_id", "content"])
    made = list(framing.frames(Given()).run(iter([given])))
    assert len(made) < 3 + sum(b.num_rows for b in made) / 2000
    want = []
    for i, content in enumerate(files):
        for places in framing.chain(content or b""):
            want += framing.batch(f"f{i}", 0, content, places).to_pylist()
    assert [r for b in made for r in b.to_pylist()] == want
    assert sum(b.num_rows for b in framing.corrupt_fields(Given()).run(iter([given]))) == sum(len(list(framing.corrupt_offsets(c or b""))) for c in files)
    assert len(list(framing.corrupt_fields(Given()).run(iter([given])))) == 1


def test_cuts_of_small_files_share_batches():
    import pyarrow as pa

    from leafstream.operators import surgery

    rows = [[{"cuts": [{"start": k, "n": 2}, {"start": 0, "n": 1}], "no": f"{i}-{k}"} for k in range(1 + i % 3)] for i in range(500)]
    kind = pa.list_(pa.struct([("cuts", pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))), ("no", pa.string())]))
    given = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(500)]), pa.array([b"%03d-abc" % i for i in range(500)]), pa.array(rows, kind)], names=["file_id", "content", "__wanted"])
    made = list(surgery.cut_rows(iter([given, given.slice(100, 200)]), ["no"]))
    assert len(made) == 2
    want = [(f"f{i}", f"{i}-{k}", (b"%03d-abc" % i)[k : k + 2] + b"%d" % (i // 100)) for i in [*range(500), *range(100, 300)] for k in range(1 + i % 3)]
    assert [(r["file_id"], r["no"], r["content"]) for b in made for r in b.to_pylist()] == want


def test_small_tables_are_dealt_out(spark, sf_dir):
    """A row becomes a file: a table of few bytes isn't framed in one task."""
    from leafstream.plans import decoding

    assert decoding._part(spark, sf_dir).rdd.getNumPartitions() == 4


def test_tag_pages_deal_tags_once(spark):
    """Inside, before, between and behind pages, in files without pages; tags and pages are dealt out in one exchange each."""
    found = spark.createDataFrame([("a", at, f"v{at}") for at in (0, 10, 19, 20, 25, 30, 39, 40, 99)] + [("b", 5, "v")], "file_id string, offset bigint, value string")
    index = spark.createDataFrame([("a", 1, 10, 10), ("a", 2, 30, 10), ("c", 1, 0, 5)], "file_id string, page_pos bigint, byte_offset bigint, byte_length bigint")
    placed = tag_pages(found, index, ["file_id"])
    assert placed.columns == ["file_id", "offset", "value", "page_pos"]
    got = sorted((r.file_id, r["offset"], r.page_pos) for r in placed.collect())
    assert got == [("a", 0, 1), ("a", 10, 1), ("a", 19, 1), ("a", 20, 2), ("a", 25, 2), ("a", 30, 2), ("a", 39, 2), ("a", 40, 2), ("a", 99, 2), ("b", 5, None)]
    plan = placed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
