"""Drawing orders: parsing, bounds and display lists."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame

ORDER = "array<struct<type:int,params:array<int>>>"
# Parameter bytes of short orders; None: a length byte follows.
SIZES = {0x04: 1, 0x08: 1, 0x0A: 1, 0x0B: 1, 0x0C: 2, 0x11: 4, 0x18: 1, 0x19: 2, 0x21: None, 0x26: 1, 0x29: 1, 0x33: 4, 0x34: 2, 0x35: 0, 0x37: 4, 0x39: 2, 0x3C: 1, 0x60: 1, 0x68: 1, 0x70: 0, 0x71: 0, 0x72: None}
SEGMENT_SKIP = (0x00, 0xFE, 0xFF)
LINE, LINE_TO, BOX, BOX_TO, ARC, FILLET, CURVE, MARK = 0xC1, 0x81, 0xC0, 0x80, 0xC6, 0xC5, 0x85, 0xC2
OP = "array<struct<op:string,coords:array<double>,stroke:string,fill:string,width:double,dash:int>>"


def parse(data: bytes) -> list[tuple[int, bytes]]:
    """(order code, parameters); a short unknown order has none, parameters end with the data."""
    out, at = [], 0
    while at < len(data):
        code = data[at]
        at += 1
        if code in SEGMENT_SKIP:
            continue
        size = None if code >= 0x80 else SIZES.get(code, 0)
        if size is None:
            if at >= len(data):
                break
            size, at = data[at], at + 1
        out.append((code, data[at : at + size]))
        at += size
    return out


def s16(p: bytes, at: int = 0) -> int:
    return int.from_bytes(p[at : at + 2], "big", signed=True)


_PAIR, _PAIRS, _DISC = struct.Struct(">2h").unpack_from, struct.Struct(">4h").unpack_from, struct.Struct(">3h").unpack_from


def points(code: int, p: bytes) -> list[tuple[int, int]]:
    """The places that count for an order's bounds (a curve's control points do)."""
    if code == LINE and len(p) >= 8:
        a, b, c, d = _PAIRS(p)
        return [(a, b), (c, d)]
    if code in (BOX, BOX_TO) and len(p) >= 10:
        a, b, c, d = _PAIRS(p, 2)
        return [(a, b), (c, d)]
    if code == ARC and len(p) >= 6:
        x, y, r = _DISC(p)
        r = abs(r)
        return [(x - r, y - r), (x + r, y + r)]
    if code in (LINE_TO, MARK) and len(p) >= 4:
        return [_PAIR(p)]
    if code in (FILLET, CURVE):
        return [_PAIR(p, i) for i in range(0, len(p) - 3, 4)]
    return []


def placed(orders: list[tuple[int, bytes]]) -> list[list[tuple[int, int]]]:
    """points() of each order: bounds and display lists are both made of them."""
    return [points(code, p) for code, p in orders]


def bounds(orders: list[tuple[int, bytes]], places: list[list[tuple[int, int]]] | None = None) -> tuple[int, int, int, int] | None:
    """x, y, width, height of all orders, or None; places: placed(orders), if it is known."""
    xy = list(chain.from_iterable(placed(orders) if places is None else places))
    if not xy:
        return None
    x, y = zip(*xy, strict=True)
    left, top = min(x), min(y)
    return left, top, max(x) - left, max(y) - top


@lru_cache(4096)
def _css(color: tuple[int, ...] | None) -> str | None:
    return None if color is None else "rgb(%d,%d,%d)" % color  # noqa: UP031


_OP_NAMES = ("op", "coords", "stroke", "fill", "width", "dash")


def display(orders: list[tuple[int, bytes]], scale: float = 1.0, dx: float = 0.0, dy: float = 0.0) -> list[dict]:
    """Drawing operations with style, placed by scale and offset."""
    return [dict(zip(_OP_NAMES, o, strict=True)) for o in operations(orders, placed(orders), scale, dx, dy)]


def operations(orders: list[tuple[int, bytes]], places: list[list[tuple[int, int]]], scale: float = 1.0, dx: float = 0.0, dy: float = 0.0) -> list[tuple]:
    """display() as tuples of op, coords, stroke, fill, width and dash; places: placed(orders)."""
    out: list[tuple] = []
    scale, dx, dy = float(scale), float(dx), float(dy)  # so all coordinates are
    color, fill, width, dash, x, y = (0, 0, 0), None, 1.0, 0, 0, 0
    area: list[tuple[float, float]] | None = None
    outlines: list[list[tuple[float, float]]] = []
    filled = False
    place = lambda a, b: (dx + a * scale, dy + b * scale)

    def put(op: str, coords: list[tuple[float, float]], stroke=True, inside=None) -> None:
        out.append((op, list(chain.from_iterable(coords)), _css(color) if stroke else None, _css(inside), width, dash))

    for (code, p), xy in zip(orders, places, strict=True):
        if code == LINE:
            if xy:
                (a, b), (c, d) = xy
                out.append(("line", [dx + a * scale, dy + b * scale, dx + c * scale, dy + d * scale], _css(color), None, width, dash))
                x, y = c, d
        elif code == 0x08 and len(p) >= 3:
            color = tuple(p[:3])
        elif code == 0x19 and len(p) >= 2:
            width = max(1.0, s16(p) * scale)
        elif code == 0x18 and p:
            dash = p[0]
        elif code == 0x11:
            fill = tuple(p[1:4]) if len(p) >= 4 and p[0] else None
        elif code == 0x21 and len(p) >= 4:
            x, y = s16(p), s16(p, 2)
            if area is not None:  # a new outline of the area
                outlines.append(area)
                area = [place(x, y)]
        elif code == 0x68:
            area, outlines, filled = [place(x, y)], [], bool(p and p[0] & 0x80)
        elif code == 0x60:
            for outline in [*outlines, area] if filled and area else []:
                if len(outline) > 1:
                    put("polygon", outline, False, fill or color)
            area, filled = None, False
        elif code == LINE_TO and xy:
            if area is None:
                put("line", [place(x, y), place(*xy[0])])
            else:
                area.append(place(*xy[0]))
            x, y = xy[0]
        elif code in (BOX, BOX_TO) and xy:
            (a, b), (c, d) = xy
            w, h = abs(c - a) or abs(c), abs(d - b) or abs(d)
            corner = place(min(a, c), min(b, d))
            put("rect", [corner, (w * scale, h * scale)], area is None, fill or (color if area is not None and filled else None))
        elif code == ARC and len(p) >= 8:
            put("arc", [place(s16(p), s16(p, 2)), (abs(s16(p, 4)) * scale, 0.0), (float(p[6]), float(p[7]))])
        elif code in (FILLET, CURVE) and xy:
            if area is None:
                put("lines" if code == FILLET else "curve", [place(x, y), *(place(*q) for q in xy)])
            else:
                area += [place(*q) for q in xy]
            x, y = xy[-1]
        elif code in (MARK, 0x29) and len(p) >= 4:
            cx, cy = place(s16(p), s16(p, 2))
            put("line", [(cx - 3, cy), (cx + 3, cy)])
            put("line", [(cx, cy - 3), (cx, cy + 3)])
    return out


def strip_header(data: bytes) -> bytes:
    """A segment's data without its cell header (70), pad bytes and size fields (A0 to BF)."""
    at = 0
    while at < len(data):
        if data[at] == 0x70 and at + 1 < len(data):
            at += 2 + data[at + 1]
        elif data[at] == 0:
            at += 1
        elif 0xA0 <= data[at] <= 0xBF and at + 1 < len(data):
            at += 2 + data[at + 1]
        else:
            break
    return data[at:]


def segment_resolution(data: bytes, default: int = 300) -> int:
    """A tenth of the first equal pair of 16-bit numbers in 720 to 14400."""
    for i in range(len(data) - 3):
        a = data[i] << 8 | data[i + 1]
        if 720 <= a <= 14400 and data[i : i + 2] == data[i + 2 : i + 4]:
            return a // 10
    return default


#: Operations after which the objects done are handed on.
HELD_OPS = 10_000
_OUT = "x int, y int, width int, height int, n_orders int, ops " + OP


def _listed_ops(ops: list[list[tuple]]) -> pa.ListArray:
    """Lists of operations, column by column."""
    ends = lambda lists: pa.array(list(accumulate(map(len, lists), initial=0)), pa.int32())
    kinds = [pa.string(), None, pa.string(), pa.string(), pa.float64(), pa.int32()]
    columns = list(zip(*chain.from_iterable(ops), strict=True)) or [()] * len(kinds)
    arrays = [pa.array(c, k) if k else pa.ListArray.from_arrays(ends(c), pa.array(list(chain.from_iterable(c)), pa.float64())) for c, k in zip(columns, kinds, strict=True)]
    return pa.ListArray.from_arrays(ends(ops), pa.StructArray.from_arrays(arrays, list(_OP_NAMES)))


def drawn(batches: Iterator[pa.RecordBatch], arrow: pa.Schema, scale: float, held_ops: int = HELD_OPS) -> Iterator[pa.RecordBatch]:
    """Batches of objects, their data last, with bounds, n_orders and ops instead.

    It holds the operations of one object, or of several up to held_ops, whatever the objects in a batch.
    """
    for batch in batches:
        others, first, held, boxes, ops = batch.num_columns - 1, 0, 0, [], []
        for i, raw in enumerate(batch.column(others), 1):
            orders = parse(raw.as_py() or b"")
            places = placed(orders)
            boxes.append((*(bounds(orders, places) or (None,) * 4), len(orders)))
            ops.append(operations(orders, places, scale))
            held += len(ops[-1])
            if held >= held_ops or i == batch.num_rows:
                kept = batch.slice(first, i - first).columns[:others]
                arrays = [*kept, *(pa.array(c, pa.int32()) for c in zip(*boxes, strict=True)), _listed_ops(ops)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, arrow, strict=True)], schema=arrow)
                first, held, boxes, ops = i, 0, [], []


def drawings(objects: DataFrame, data: str = "data", scale: float = 1.0) -> DataFrame:
    """objects with bounds (null without places), n_orders and ops."""
    others = [c for c in objects.columns if c != data]
    kinds = {f.name: f.dataType.simpleString() for f in objects.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), _OUT])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return objects.select(*others, data).mapInArrow(lambda batches: drawn(batches, arrow, scale), schema)
