"""Presentation text: control sequences to positioned text runs.

Three dialects: chained controls with UTF-16 text, chained controls with single-byte text (both
``[length][type][parameters]``), and an escape dialect (2B, type, length, parameters, between raw text
bytes).  One text block (the concatenated payloads between begin and end text) is one input.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ebcdic
from ..sources.wire import joined

RUN = "struct<x:int,y:int,text:string,font_id:int,font_size:double,bold:boolean,underline:boolean,orientation:int,r:int,g:int,b:int,rule_length:int,rule_width:int,vertical:boolean>"
_CONTROLS = re.compile("[\x00-\x1f\x7f-\x9f]")
# Style number to size, bold, underline, color; the standard indexed colors.
_PLAIN, _ACCENT = (0, 0, 0), (79, 182, 224)
STYLES = {1: (10, True, False, _PLAIN), 2: (24, False, False, _ACCENT), 3: (10, False, False, _PLAIN), 4: (9, False, False, _PLAIN), 5: (9, True, False, _PLAIN), 6: (10, False, True, _ACCENT)}
COLORS = {0: (0, 0, 0), 1: (0, 0, 255), 2: (255, 0, 0), 3: (255, 0, 255), 4: (0, 255, 0), 5: (0, 255, 255), 6: (255, 255, 0), 7: (255, 255, 255), 8: (0, 0, 0), 16: (139, 69, 19)}
#: A rotated run sits here, in this size; above this value a baseline control is a place, else a step.
ROTATED_X, ROTATED_SIZE, STEP_LIMIT, MAX_REPEAT = 60, 6, 100, 10_000


@functools.cache
def _controls(table: str) -> bytes:
    """The bytes of a code page that stand for control characters."""
    return bytes(i for i, c in enumerate(table) if _CONTROLS.match(c))


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def _quarter(degrees: float) -> int:
    d = degrees % 360
    return 0 if d >= 315 or d < 45 else 90 if d < 135 else 180 if d < 225 else 270


class _State:
    """Where and how the next text is set, and the runs so far."""

    def __init__(self, table: str, bold_fonts: frozenset[int]):
        self.table, self.controls, self.bold_fonts = table, _controls(table), bold_fonts
        self.x = self.y = self.step = self.font = self.turn = 0
        self.size, self.bold, self.underline, self.color = 10.0, False, False, _PLAIN
        self.runs: list[dict] = []

    def text_of(self, raw: bytes) -> str:
        raw = raw.translate(None, self.controls)
        # a charmap takes U+FFFE as undefined
        return raw.decode("latin-1").translate(self.table) if "\ufffe" in self.table else codecs.charmap_decode(raw, "strict", self.table)[0]

    def put(self, text: str, **other) -> dict:
        r, g, b = self.color
        run = {"x": self.x, "y": self.y, "text": text, "font_id": self.font, "font_size": float(self.size), "bold": self.bold, "underline": self.underline, "orientation": self.turn, "r": r, "g": g, "b": b, "rule_length": None, "rule_width": None, "vertical": False}
        self.runs.append(run | other)
        return self.runs[-1]


def _chain(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, parameters) of chained controls; a bad length moves on by one byte."""
    at = 2 if data[:2] == b"\x2b\xd3" else 0
    while at < len(data):
        size = data[at]
        if size < 2 or at + size > len(data):
            at += 1
            continue
        yield data[at + 1], data[at + 2 : at + size]
        at += size


def is_utf16(data: bytes) -> bool:
    """Whether the first longer text control is mostly pairs of 00 and printable ASCII."""
    if len(data) < 20:
        return False
    for kind, params in _chain(data):
        if kind == 0xDB and len(params) > 4:
            pairs = [params[i : i + 2] for i in range(0, min(len(params) - 1, 40), 2)]
            good = sum(p[0] == 0 and 0x20 <= p[1] < 0x7F for p in pairs)
            return len(pairs) >= 3 and good / len(pairs) > 0.5
    return False


def _u16(data: bytes, at: int = 0) -> int:
    return data[at] << 8 | data[at + 1]


def _s16(data: bytes) -> int:
    return int.from_bytes(data[:2], "big", signed=True)


def _utf16(data: bytes, s: _State) -> None:
    for kind, p in _chain(data):
        if kind == 0xC7 and len(p) >= 2:
            s.x = _u16(p)
        elif kind == 0xD3 and len(p) >= 2:
            s.y = _u16(p)
        elif kind == 0xDB:
            units = [_u16(p, i) for i in range(0, len(p) - 1, 2)]
            raw = b"".join(u.to_bytes(2, "big") for u in units if u >= 0x20)
            if text := raw.decode("utf-16-be", "replace"):
                s.put(text, font_id=0, orientation=0)
        elif kind == 0xF1 and p:
            s.size, s.bold, s.underline, s.color = STYLES.get(p[0], STYLES[3])
        elif kind == 0x80 and len(p) >= 3:
            s.color = tuple(p[:3])


def _chained(data: bytes, s: _State) -> None:
    for kind, p in _chain(data):
        if kind in (0xC7, 0xC0, 0xC1) and len(p) >= 2:
            s.x = _u16(p)
        elif kind == 0xD2 and len(p) >= 2:
            s.y = _u16(p)
        elif kind in (0xD3, 0xD1) and len(p) >= 2:
            value = _u16(p)
            if value > STEP_LIMIT:
                s.y = value
            else:
                s.step = value
        elif kind in (0xD8, 0xD9):
            s.y += s.step
        elif kind == 0xDB:
            text = s.text_of(p)
            if not text:
                continue
            if s.turn in (90, 270):
                if s.runs and s.runs[-1]["orientation"] == s.turn:
                    s.runs[-1]["text"] += text
                else:
                    s.put(text, x=ROTATED_X if s.turn == 270 else s.x, font_size=float(ROTATED_SIZE), bold=False)
            else:
                s.put(text)
            s.x += _half_up(len(text) * (s.size / 72) * 300 * (0.48 if s.bold else 0.42))
        elif kind == 0xF1 and p:
            s.font, s.size, s.bold = p[0], 10.0, p[0] in s.bold_fonts
        elif kind == 0x80 and len(p) >= 3:
            s.color = tuple(p[:3])
        elif kind in (0xF6, 0xF7) and len(p) >= 2:
            s.turn = _quarter(_half_up(_u16(p) / 0xB400 * 360) % 360)
            if s.turn:
                s.bold, s.size = False, float(ROTATED_SIZE)


def _escaped(data: bytes, s: _State) -> None:
    s.size = 12.0
    held = bytearray()

    def say(raw: bytes, times: int = 1) -> None:
        if text := s.text_of(raw) * times:
            s.put(text)
            s.x += 120 * len(text)

    at = 0
    while at < len(data):
        if data[at] != 0x2B or at + 1 >= len(data):
            held.append(data[at])
            at += 1
            continue
        say(bytes(held))
        held.clear()
        if data[at + 1] == 0xD3 and at + 4 < len(data):
            size = _u16(data, at + 2)
            kind, first, n = data[at + 4], at + 5, size - 3
        elif at + 2 < len(data) and data[at + 2]:
            size = data[at + 2]
            kind, first, n = data[at + 1], at + 3, size - 1
        else:
            at += 2
            continue
        _control(kind, data[first : first + n] if n > 0 else b"", s, say)
        at += 2 + size
    say(bytes(held))


def _control(kind: int, p: bytes, s: _State, say) -> None:
    if kind in (0xC0, 0xC8, 0xD2, 0xD4, 0xD0) and len(p) >= 2:
        value = _s16(p) if kind in (0xC8, 0xD4) else _u16(p)
        if kind == 0xC0:
            s.x = value
        elif kind == 0xC8:
            s.x += value
        elif kind == 0xD2:
            s.y = value
        elif kind == 0xD4:
            s.y += value
        else:
            s.step = value
    elif kind == 0xF6 and len(p) >= 4:
        s.turn = _quarter(_half_up(_u16(p) / 2))
    elif kind == 0x80 and len(p) >= 5:
        if p[1] == 1:
            s.color = tuple(p[2:5])
        elif p[1] in (4, 6):
            s.color = (p[2],) * 3
    elif kind == 0x80 and p:
        s.color = COLORS.get(p[0], _PLAIN)
    elif kind == 0x10 and p:
        s.font = p[0]
    elif kind == 0xDA and p:
        say(p)
    elif kind == 0xD8:
        s.y, s.x = s.y + s.step, 0
    elif kind in (0xE4, 0xE6) and len(p) >= 4:
        s.put("", font_size=0.0, rule_length=_u16(p), rule_width=_u16(p, 2), vertical=kind == 0xE6)
        if kind == 0xE4:
            s.x += _u16(p)
    elif kind == 0xEE and len(p) >= 3:
        say(p[2:], min(_u16(p), MAX_REPEAT))


def interpret(data: bytes, page: str = "cp037", bold_fonts: frozenset[int] = frozenset()) -> list[dict]:
    """The text runs of a block."""
    state = _State(ebcdic.code_page(page), bold_fonts)
    if is_utf16(data):
        _utf16(data, state)
    elif len(data) > 4 and data[:2] == b"\x2b\xd3":
        _chained(data, state)
    else:
        state.step = 240
        _escaped(data, state)
    return state.runs


def _payloads(sf: DataFrame, pages: DataFrame, stray: bool = False) -> DataFrame:
    """file_id, page_pos, obj_no, offset and data of the text fields in blocks of a page, a row a field."""
    from .asof import interval_join

    kinds = {"D3A87B": "B", "D3A89B": "B", "D3A97B": "E", "D3A99B": "E", "D3EE9B": "T", "D3EE6B": "T"}
    kind = F.coalesce(*[F.when(F.col("type_id") == t, k) for t, k in kinds.items()])
    rows = sf.where(F.col("type_id").isin(*kinds)).select("file_id", "offset", "data", kind.alias("k"))
    rows = interval_join(rows, pages, ["file_id"], "offset", "byte_offset", "byte_length", ["page_pos"]).where("page_pos IS NOT NULL")
    by = Window.partitionBy("file_id", "page_pos").orderBy("offset")
    rows = rows.withColumns({"obj_no": F.sum((F.col("k") == "B").cast("long")).over(by), "__open": F.last(F.when(F.col("k") != "T", F.col("k")), ignorenulls=True).over(by)})
    inside = rows.where("k = 'T'" if stray else "k = 'T' AND __open = 'B'")
    return inside.select("file_id", "page_pos", "obj_no", "offset", "data")


def text_blocks(sf: DataFrame, pages: DataFrame, stray: bool = False) -> DataFrame:
    """file_id, page_pos, obj_no and data: the text payloads of each block of a page, in order.

    A block begins at a begin-text field and ends at an end-text field or with the page.  stray:
    text outside a block opens one.
    """
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("offset", "data"))), lambda x: x["data"])
    return _payloads(sf, pages, stray).groupBy("file_id", "page_pos", "obj_no").agg(F.min("offset").alias("offset"), joined(chunks).alias("data"))


def text_runs(blocks: DataFrame, page: str = "cp037", bold_fonts: str | None = None) -> DataFrame:
    """blocks' other columns, run_no and the run's fields; bold_fonts: a column of bold local font ids."""
    others = [c for c in blocks.columns if c not in ("data", bold_fonts)]
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in others) + f", runs array<{RUN}>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pylist()
                rows = [{c: r[c] for c in others} | {"runs": interpret(r["data"] or b"", page, frozenset(r[bold_fonts] or ()) if bold_fonts else frozenset())} for r in part]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    picked = blocks.select(*others, "data", *([bold_fonts] if bold_fonts else []))
    out = picked.mapInArrow(run, schema)
    return out.select(*others, F.posexplode("runs").alias("run_no", "r")).select(*others, "run_no", "r.*")


def page_texts(sf: DataFrame, pages: DataFrame, page: str = "cp037") -> DataFrame:
    """file_id, page_pos and text of all pages, as page_text() gives it; empty where a page has no runs.

    A page's payloads are gathered, joined to the pages and then interpreted: only texts leave the tasks, not a row a run,
    and no text is dealt out by page again.
    """
    held = _payloads(sf, pages).groupBy("file_id", "page_pos").agg(F.array_sort(F.collect_list(F.struct("obj_no", "offset", "data"))).alias("payloads"))
    gathered = pages.select("file_id", "page_pos").join(held, ["file_id", "page_pos"], "left").select("file_id", F.col("page_pos").cast("long").alias("page_pos"), "payloads")

    def said(payloads: list[dict]) -> str:
        blocks = (b"".join([p["data"] or b"" for p in block]) for _, block in itertools.groupby(payloads, key=lambda p: p["obj_no"]))
        return " ".join([r["text"] for data in blocks for r in interpret(data, page) if r["text"].strip(ebcdic.SPACES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([said(payloads or []) for payloads in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1), texts], names=["file_id", "page_pos", "text"])

    return gathered.mapInArrow(run, "file_id string, page_pos bigint, text string")


def page_text(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The page's runs that aren't blank, in order, joined by a blank."""
    said = F.array_sort(F.collect_list(F.when(ebcdic.js_trim(F.col("text")) != "", F.struct("obj_no", "run_no", "text"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(said, lambda r: r["text"]), " ").alias("text"))


def bounds(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes around runs: 120 units a character wide, 240 high."""
    right, low = F.max(F.col("x") + F.length("text") * 120), F.max(F.col("y") + 240)
    return runs.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("width"), (low - F.min("y")).alias("height"))


def pixel_font(size: Column, dpi: float = 96) -> Column:
    return F.greatest(F.lit(4), F.floor(size * dpi / 72 * 0.92 + 0.5).cast("int"))
