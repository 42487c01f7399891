"""Images: descriptors, fax (T.6) and raster decoding to pixels, PNG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Run-length codes of T.4 (runs 0 to 63, then 64 to 1728 in steps of 64; both colors share the long ones).
_WHITE = """
00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111
0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111
00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101
01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101
011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011
"""
_BLACK = """
0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000
00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000
000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101
000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100
000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011
0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011
0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101
"""
_LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
_MODES = {"0001": "pass", "001": "horizontal", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}
# Compression, color model and their codes.
COMPRESSIONS = {0x00: "none", 0x01: "g3", 0x02: "g4", 0x03: "mmr", 0x0D: "jpeg", 0x82: "g4", 0x83: "jpeg"}
COLOR_MODELS = {0x00: "bilevel", 0x01: "rgb", 0x02: "ycbcr", 0x04: "cmyk", 0x12: "ycbcr"}


def _runs(codes: str) -> dict[str, int]:
    return {c: i if i < 64 else 64 * (i - 63) for i, c in enumerate(codes.split())} | {c: 1792 + 64 * i for i, c in enumerate(_LONG.split())}


RUNS = (_runs(_WHITE), _runs(_BLACK))


class _Bits:
    def __init__(self, data: bytes):
        self.text = "".join(f"{b:08b}" for b in data)
        self.at = 0

    def take(self, table: dict, longest: int = 13):
        for n in range(1, longest + 1):
            if (found := table.get(self.text[self.at : self.at + n])) is not None and self.at + n <= len(self.text):
                self.at += n
                return found
        return None

    def run(self, color: int) -> int | None:
        total = 0
        while (n := self.take(RUNS[color])) is not None:
            total += n
            if n < 64:
                return total
        return None


def decode_g4(data: bytes, width: int, height: int) -> np.ndarray:
    """T.6 to (height, width) of 1 (black) and 0; what can't be read stays white."""
    out = np.zeros((height, width), np.uint8)
    bits, above = _Bits(data), [width]
    for y in range(height):
        line: list[int] = []  # where the color changes
        a, color = -1, 0
        while a < width:
            later = [c for i, c in enumerate(above) if c > a and i % 2 == color] or [width]
            b1 = later[0]
            mode = bits.take(_MODES, 7)
            if mode is None:
                return out
            if mode == "pass":
                a = next((c for c in above if c > b1), width)
            elif mode == "horizontal":
                first, second = bits.run(color), bits.run(1 - color)
                if first is None or second is None:
                    return out
                start = max(a, 0) + first
                line += [start, start + second]
                a = start + second
            else:
                a = b1 + mode
                line.append(a)
                color = 1 - color
            if a >= width:
                break
        line = [min(max(c, 0), width) for c in line]
        for start, end in zip(line[::2], [*line[1::2], width], strict=False):
            out[y, start:end] = 1
        above = [c for c in line if c < width] + [width, width]
    return out


def encode_g4(pixels: np.ndarray) -> bytes:
    """(height, width) of 0 and 1 to T.6 (for round trips and fixtures)."""
    height, width = pixels.shape
    codes = [{v: k for k, v in t.items()} for t in RUNS]
    modes = {v: k for k, v in _MODES.items()}
    text, above = [], [width, width]

    def run(n: int, color: int) -> None:
        while n >= 2560:
            text.append(codes[color][2560])
            n -= 2560
        if n >= 64:
            text.append(codes[color][n // 64 * 64])
        text.append(codes[color][n % 64])

    for y in range(height):
        row = pixels[y]
        line = [int(i) for i in np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8)])))] + [width, width]
        a, color = -1, 0
        while a < width:
            a1 = next((c for i, c in enumerate(line) if c > a and i % 2 == color), width)
            b1 = next((c for i, c in enumerate(above) if c > a and i % 2 == color), width)
            b2 = next((c for c in above if c > b1), width)
            if b2 < a1:
                text.append(modes["pass"])
                a = b2
            elif abs(a1 - b1) <= 3:
                text.append(modes[a1 - b1])
                a, color = a1, 1 - color
            else:
                a2 = next((c for c in line if c > a1), width)
                text.append(modes["horizontal"])
                run(a1 - max(a, 0), color)
                run(a2 - a1, 1 - color)
                a = a2
            if a >= width:
                break
        above = line
    whole = "".join(text) + "000000000001" * 2
    whole += "0" * (-len(whole) % 8)
    return int(whole, 2).to_bytes(len(whole) // 8, "big")


def descriptor(data: bytes) -> dict:
    """width, height, x_res, y_res, bit_depth, compression and color_model that an image descriptor gives."""
    u16 = lambda i: data[i] << 8 | data[i + 1]
    out: dict = {}
    at = 0
    if len(data) >= 6:
        out |= {k: v for k, v in (("x_res", u16(2)), ("y_res", u16(4))) if v}
        at = 6
    while at + 2 <= len(data):
        size, kind = data[at], data[at + 1]
        if size < 2 or at + size > len(data):
            break
        if kind in (0x94, 0x9B) and size >= 6:
            names = ("width", "height", "x_res", "y_res")[: 4 if size >= 10 else 2]
            out |= {n: v for i, n in enumerate(names) if (v := u16(at + 2 + 2 * i))}
        elif kind == 0x95 and size >= 3:
            out["compression"] = COMPRESSIONS.get(data[at + 2], "none")
        elif kind == 0x96 and size >= 3:
            out["bit_depth"] = data[at + 2]
        elif kind == 0x97 and size >= 3:
            out["color_model"] = COLOR_MODELS.get(data[at + 3 if size >= 4 else at + 2], "gray")
        at += size
    return out


def rgba(image: dict, data: bytes) -> np.ndarray:
    """(height, width, 4) pixels; missing data is white (black for color planes), JPEG a gray placeholder."""
    w, h = image.get("width", 1), image.get("height", 1)
    depth, model = image.get("bit_depth", 1), image.get("color_model", "bilevel")
    out = np.full((h, w, 4), 255, np.uint8)
    if image.get("compression") == "jpeg":
        out[..., :3] = 200
    elif image.get("compression") in ("g3", "g4", "mmr"):
        out[..., :3] = np.where(decode_g4(data, w, h)[..., None] == 1, 0, 255)
    elif depth == 1:
        row = -(-w // 8)
        raw = np.frombuffer(data[: row * h].ljust(row * h, b"\0"), np.uint8).reshape(h, row)
        out[..., :3] = np.where(np.unpackbits(raw, axis=1)[:, :w, None] == 1, 0, 255)
    else:
        planes = {"rgb": 3, "ycbcr": 3, "cmyk": 4}.get(model, 1)
        raw = np.frombuffer(data[: w * h * planes].ljust(w * h * planes, b"\0"), np.uint8).reshape(h, w, planes).astype(np.float64)
        if model == "cmyk":
            raw = 255 * (1 - raw[..., :3] / 255) * (1 - raw[..., 3:] / 255)
        elif model == "ycbcr":
            y, cb, cr = raw[..., 0], raw[..., 1] - 128, raw[..., 2] - 128
            raw = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
        out[..., :3] = np.clip(np.floor(raw + 0.5), 0, 255)
    return out


def raster(chunks: list[bytes]) -> dict | None:
    """width, height, resolution, bits, compression and data of a raster image's chunks, or None."""
    head = next(((i, c) for i, c in enumerate(chunks) if len(c) > 5 and c[0] == 0x70), None)
    if head is None:
        return None
    at, c = head
    out = {"width": 0, "height": 0, "resolution": 300, "bits": 1, "compression": 0}
    u16 = lambda i: c[i] << 8 | c[i + 1]
    for j in range(5, min(len(c), 60) - 2):
        if c[j] == 0x94 and c[j + 1] >= 7 and j + 2 + c[j + 1] <= len(c):
            out["width"] = u16(j + 7)
            if c[j + 1] > 8:
                out["height"] = u16(j + 9)
            if u16(j + 3) > 100:
                out["resolution"] = (u16(j + 3) + 5) // 10
        elif c[j] == 0x95:
            out["compression"] = c[j + 2]
        elif c[j] == 0x96:
            out["bits"] = c[j + 2]
    if out["width"] <= 0:
        return None
    mark = c.find(b"\xfe\x92", 5, 101)
    starts = [0 if i != at else mark if mark >= 0 else len(x) for i, x in enumerate(chunks)]
    raw = b"".join(x[s + 4 :] if x[s : s + 2] == b"\xfe\x92" and len(x) > s + 3 else x[s:] for x, s in zip(chunks, starts, strict=True))
    row = out["width"] if out["bits"] == 8 else -(-out["width"] // 8)
    if out["bits"] == 8 and b"\xfe\x92" in raw[:2001]:
        rows, i = [], 0
        while (i := raw.find(b"\xfe\x92", i)) >= 0 and i + 4 + row <= len(raw):
            rows.append(raw[i + 4 : i + 4 + row])
            i += 4 + row
        out["height"], data = len(rows), b"".join(rows)
    else:
        out["height"] = out["height"] or len(raw) // row
        data = raw[: row * out["height"]].ljust(row * out["height"], b"\0")
    return out | {"data": data} if raw and out["height"] > 0 else None


def black_pixels(image: dict) -> np.ndarray:
    """(height, width) of 1 for black, for one bit a pixel: ones are black unless they fill most of the middle row."""
    w, h = image["width"], image["height"]
    row = -(-w // 8)
    ones = np.unpackbits(np.frombuffer(image["data"][: row * h].ljust(row * h, b"\0"), np.uint8).reshape(h, row), axis=1)[:, :w]
    return 1 - ones if ones[min(h // 2, h - 1)].sum() > w / 2 else ones


def cropped(black: np.ndarray, most: int = 8, share: float = 0.9, samples: int = 100) -> np.ndarray:
    """Without borders: up to 8 columns or rows on a side of which more than 90 % (of about 100 samples) are black."""
    h, w = black.shape

    def solid(line: np.ndarray, of: int) -> bool:
        seen = line[:: max(1, of // samples)]
        return len(seen) > 0 and seen.mean() > share

    left = top = right = low = 0
    while left < min(most, w) and solid(black[:, left], h):
        left += 1
    while top < min(most, h) and solid(black[top, left:], w):
        top += 1
    while right < most and w - 1 - right > left and solid(black[top:, w - 1 - right], h):
        right += 1
    while low < most and h - 1 - low > top and solid(black[h - 1 - low, left : w - right], w):
        low += 1
    return black[top : h - low, left : w - right]


def shown(image: dict) -> np.ndarray:
    """A raster image's pixels: one bit cropped, 8 bits gray, other depths a gray field of its size."""
    if image["bits"] == 1:
        return np.where(cropped(black_pixels(image)) == 1, 0, 255).astype(np.uint8)
    if image["bits"] == 8:
        size = image["width"] * image["height"]
        return np.frombuffer(image["data"][:size].ljust(size, b"\xff"), np.uint8).reshape(image["height"], image["width"])
    return np.full((image["height"], image["width"]), 200, np.uint8)


def vector_boxes(data: bytes, least: int = 10, least_bytes: int = 100) -> list[tuple[int, int, int, int]]:
    """Corners of filled boxes in drawing data that looks like a matrix code (more than 10 boxes), else none."""
    found, at = [], data.find(b"\x68\x80\xc0\x0a")
    while 0 <= at < len(data) - 13:
        found.append(struct.unpack_from(">4H", data, at + 6))
        at = data.find(b"\x68\x80\xc0\x0a", at + 1)
    return found if len(found) > least and len(data) > least_bytes else []


def png(pixels: np.ndarray) -> bytes:
    """(height, width, 4) or (height, width) pixels as a PNG file."""
    h, w = pixels.shape[:2]
    color = 6 if pixels.ndim == 3 else 0
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def fit(pixels: np.ndarray, most_width: int = 500, least_height: int = 40) -> np.ndarray:
    """Scaled by repetition or omission: at most so wide, at least so high."""
    h, w = pixels.shape[:2]
    scale = min(1.0, most_width / w)
    scale = max(scale, least_height / h) if h * scale < least_height else scale
    rows, cols = max(1, int(h * scale)), max(1, int(w * scale))
    return pixels[np.arange(rows) * h // rows][:, np.arange(cols) * w // cols]


def _picture(r: dict, data: str, described: str | None) -> np.ndarray:
    """An object's pixels: by its descriptor, or those of a raster image."""
    if described:
        return rgba(descriptor(r[described] or b""), r[data] or b"")
    image = raster([r[data] or b""])
    if image is None:
        raise ValueError("no raster image")
    return shown(image)


def _each(objects: DataFrame, data: str, described: str | None, name: str, make) -> DataFrame:
    """objects with width, height and make(pixels) as name; an image that can't be decoded has an error instead."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    others = [c for c in objects.columns if c not in (data, described)]
    kinds = {f.name: f.dataType.simpleString() for f in objects.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), f"width int, height int, {name} binary, error string"])
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def one(r: dict) -> dict:
        try:
            picture = _picture(r, data, described)
            return {"width": picture.shape[1], "height": picture.shape[0], name: make(picture), "error": None}
        except (ValueError, IndexError) as e:
            return {"width": None, "height": None, name: None, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                rows = [{c: r[c] for c in others} | one(r) for r in batch.slice(i, 32).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return objects.select(*dict.fromkeys((*others, data, *([described] if described else [])))).mapInArrow(run, schema)


def decoded(objects: DataFrame, data: str = "data", described: str | None = None) -> DataFrame:
    """objects with width, height and pixels: RGBA by a descriptor, gray bytes of a raster image.

    described: a column with the image descriptor; without it data is a raster image.
    """
    return _each(objects, data, described, "pixels", lambda p: p.tobytes())


def rendered(objects: DataFrame, data: str = "data", described: str | None = None) -> DataFrame:
    """objects with width, height and png, as decoded()."""
    return _each(objects, data, described, "png", lambda p: png(fit(p)))
