"""Progressive JPEG in numpy, many images at once.

Entropy-coded data is sequential within a restart segment only.  encode() puts a restart marker
after every unit, and decode() reads all segments of all images of a batch side by side, a symbol
each at a time, so the work is done by array operations.  decode() takes any progressive file of
8-bit samples (any sampling factors up to 4, scan script, tables, restart interval or none).

Coefficients are held as rows of 64 in zigzag order; an image's rows are its components' blocks in
raster order, component after component, padded to whole MCUs.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache

import numpy as np

#: Scan script: components, first and last coefficient, successive-approximation high and low bit.
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 6, 63, 0, 1),
    ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0),
    ((0, 1, 2), 0, 0, 1, 0),
)
SAMPLING = ((2, 2), (1, 1), (1, 1))
MAX_LINES = 4095  # MCU rows of an image


def zigzag() -> np.ndarray:
    """Natural index (8 * row + column) by zigzag place."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


# ---- geometry


@lru_cache(4096)
def geometry(width: int, height: int, sampling: tuple) -> tuple:
    """(MCUs across, MCUs down, per component (first row, blocks across padded, down padded, across, down), rows)."""
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    parts, first = [], 0
    for h, v in sampling:
        w = -(-(-(-width * h // hmax)) // 8)
        t = -(-(-(-height * v // vmax)) // 8)
        parts.append((first, across * h, down * v, w, t))
        first += across * h * down * v
    return across, down, tuple(parts), first


@lru_cache(4096)
def scan_rows(width: int, height: int, sampling: tuple, comps: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a scan in coding order and the component place (within comps) of each row of a unit."""
    across, down, parts, _ = geometry(width, height, sampling)
    if len(comps) == 1:
        first, padded, _, w, t = parts[comps[0]]
        return (first + np.arange(t)[:, None] * padded + np.arange(w)).ravel(), np.zeros(1, np.int64)
    units, place = [], []
    y, x = np.arange(down)[:, None], np.arange(across)[None, :]
    for i, c in enumerate(comps):
        first, padded = parts[c][:2]
        h, v = sampling[c]
        for dy in range(v):
            for dx in range(h):
                units.append((first + (y * v + dy) * padded + x * h + dx).ravel())
                place.append(i)
    return np.stack(units, 1).ravel(), np.array(place)


# ---- Huffman tables


def code_lengths(weights: dict[int, float]) -> dict[int, int]:
    """Huffman code lengths of at most 16 bits; the code of all ones stays unused."""
    floor = 0.0
    while True:
        heap = [(max(w, floor), i, (s,)) for i, (s, w) in enumerate(sorted(weights.items()))] + [(0.0, -1, (-1,))]
        heapq.heapify(heap)
        depth = defaultdict(int)
        n = len(heap)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                depth[s] += 1
            n += 1
            heapq.heappush(heap, (a + b, n, x + y))
        if max(depth.values()) <= 16:
            return {s: d for s, d in depth.items() if s >= 0}
        floor = max(2 * floor, sum(weights.values()) / 65536)


def _define(lengths: dict[int, int]) -> bytes:
    """Body of a DHT table: 16 counts and the symbols by length."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(lengths[s] == n for s in order) for n in range(1, 17)) + bytes(order)


def _codes(body: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a table's body."""
    out, code, at = [], 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            out.append((body[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(256)
def _lookup(body: bytes) -> np.ndarray:
    """By the next 16 bits: length << 8 | symbol (length 0: no code)."""
    table = np.zeros(65536, np.uint16)
    for symbol, code, length in _codes(body):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


def _tables() -> dict[str, bytes]:
    """Tables fitted to bytes of text around a bias: mostly short runs of zeros, mostly middle sizes."""
    size = {1: 3, 2: 6, 3: 10, 4: 6, 5: 1.5, 6: 5, 7: 0.3, 8: 0.05, 9: 0.01, 10: 0.01}
    first = {r << 4 | s: w * 0.08**r for r in range(16) for s, w in size.items()} | {0x00: 1, 0xF0: 1e-4}
    fine = {r << 4 | 1: 0.9**r for r in range(16)} | {0x00: 3, 0xF0: 0.1}
    dc = {s: 1 + min(s, abs(9 - s)) for s in range(12)}
    return {"dc": _define(code_lengths(dc)), "first": _define(code_lengths(first)), "fine": _define(code_lengths(fine))}


TABLES = _tables()


@lru_cache(8)
def _encoder(name: str) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for symbol, c, n in _codes(TABLES[name]):
        code[symbol], length[symbol] = c, n
    return code, length


_BITS = np.array([int(i).bit_length() for i in range(2048)])


# ---- encoding


def _pack(rows: np.ndarray, value: np.ndarray, bits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit strings (by rising row) to bytes: each of the n rows starts at a byte and is padded with ones."""
    ends = np.cumsum(bits)
    per_row = np.bincount(rows, weights=bits, minlength=n).astype(np.int64)
    before = np.cumsum(per_row) - per_row
    lengths = (per_row + 7) >> 3
    starts = np.cumsum(lengths) - lengths
    at = ends - bits - before[rows] + 8 * starts[rows]
    total = int(lengths.sum())
    out = np.zeros(total + 8, np.int64)
    word = value.astype(np.uint64) << (40 - (at & 7) - bits).astype(np.uint64)
    byte = at >> 3
    for i in range((14 + int(bits.max(initial=0))) >> 3):
        part = ((word >> np.uint64(32 - 8 * i)) & np.uint64(255)).astype(np.uint8)
        out[i:] += np.bincount(byte, weights=part, minlength=total + 8)[: total + 8 - i].astype(np.int64)
    pad = -per_row & 7
    filled = lengths > 0
    out[(starts + lengths - 1)[filled]] += (1 << pad[filled]) - 1
    return out[:total].astype(np.uint8), lengths


def _segments(data: np.ndarray, lengths: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffs FF bytes and puts a restart marker behind each segment that isn't the last of its scan."""
    stuffed = data == 255
    marks = np.where(last, 0, 2)
    seg_end = np.cumsum(lengths)
    seg = np.repeat(np.arange(len(lengths)), lengths)
    shift = np.cumsum(stuffed) - stuffed + (np.cumsum(marks) - marks)[seg]
    stuffs = np.concatenate([[0], np.cumsum(stuffed)])
    sizes = lengths + marks + (stuffs[seg_end] - stuffs[seg_end - lengths])
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[np.arange(len(data)) + shift] = data
    behind = np.cumsum(sizes)[~last]
    out[behind - 2] = 255
    out[behind - 1] = 0xD0 + number[~last] % 8
    return out, sizes


def _dc_first(values: np.ndarray, place: np.ndarray) -> tuple:
    """values: (units, rows of a unit), already shifted; each unit is a segment, so predictions start at 0."""
    diff = values.copy()
    for j in range(1, values.shape[1]):
        if place[j] == place[j - 1]:
            diff[:, j] -= values[:, j - 1]
    size = _BITS[np.abs(diff)]
    code, length = _encoder("dc")
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint64)
    value = code[size] << size.astype(np.uint64) | extra
    rows = np.repeat(np.arange(len(values)), values.shape[1])
    return rows, value.ravel(), (length[size] + size).ravel()


def _ac_first(coefs: np.ndarray, low: int) -> tuple:
    magnitude = np.abs(coefs) >> low
    code, length = _encoder("first")
    row, col = np.nonzero(magnitude)
    value = np.where(coefs[row, col] < 0, -magnitude[row, col], magnitude[row, col])
    new = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    before = np.where(new, -1, np.concatenate([[-1], col[:-1]])) if len(row) else col
    run = col - before - 1
    size = _BITS[np.abs(value)]
    symbol = (run & 15) << 4 | size
    extra = np.where(value < 0, value + (1 << size) - 1, value).astype(np.uint64)
    word, bits = code[symbol] << size.astype(np.uint64) | extra, length[symbol] + size
    long_runs = run >> 4
    if long_runs.any():  # a symbol for every 16 zeros goes before
        times = long_runs + 1
        at = np.repeat(np.arange(len(row)), times)
        main = np.zeros(len(at), bool)
        main[np.cumsum(times) - 1] = True
        row, word, bits = row[at], np.where(main, word[at], code[0xF0]), np.where(main, bits[at], length[0xF0])
    n, width = coefs.shape
    ended = np.zeros(n, bool)
    ended[row[col_last(row)]] = magnitude[row[col_last(row)], width - 1] > 0
    return _with_ends(row, word, bits, ~ended, code[0], length[0])


def col_last(row: np.ndarray) -> np.ndarray:
    """Places of the last entry of each row (row rises)."""
    return np.flatnonzero(np.concatenate([row[1:] != row[:-1], [True]])) if len(row) else np.zeros(0, np.int64)


def _with_ends(row, word, bits, open_, code, length) -> tuple:
    """Puts the end-of-block symbol behind the entries of every row that is open."""
    shift = np.cumsum(open_) - open_
    behind = np.cumsum(np.bincount(row, minlength=len(open_)))
    total = len(row) + int(open_.sum())
    rows, words, sizes = np.empty(total, np.int64), np.empty(total, np.uint64), np.empty(total, np.int64)
    at = np.arange(len(row)) + shift[row]
    ends = (behind + shift)[open_]
    rows[at], words[at], sizes[at] = row, word, bits
    rows[ends], words[ends], sizes[ends] = np.flatnonzero(open_), code, length
    return rows, words, sizes


def _ac_fine(coefs: np.ndarray, high: int, low: int) -> tuple:
    """A refinement scan, laid out in slots: 2k + 2 for the correction bit of coefficient k, 2z + 3 for the
    symbol that follows when coefficient z ended the symbol before (z = -1 at the start)."""
    n, width = coefs.shape
    code, length = _encoder("fine")
    magnitude = np.abs(coefs) >> low
    known = magnitude >> (high - low) > 0
    words, sizes = np.zeros((n, 2 * width + 4), np.uint32), np.zeros((n, 2 * width + 4), np.int8)
    words[:, 2 : 2 * width + 2 : 2] = magnitude & 1
    sizes[:, 2 : 2 * width + 2 : 2] = known
    zero_row, zero_col = np.nonzero(~known)
    fresh = np.flatnonzero(magnitude[zero_row, zero_col] == 1)
    row, col = zero_row[fresh], zero_col[fresh]
    start = np.concatenate([[0], np.cumsum(np.bincount(zero_row, minlength=n))])[:-1]
    same = np.concatenate([[False], row[1:] == row[:-1]]) if len(row) else np.zeros(0, bool)
    prior = np.where(same, np.concatenate([[0], fresh[:-1]]), start[row] - 1) if len(row) else fresh
    run = fresh - prior - 1
    long_runs = run >> 4
    after = np.where(same, np.concatenate([[0], col[:-1]]), -1) if len(row) else col
    for m in range(int(long_runs.max(initial=0))):  # a symbol for every 16 zeros goes before
        some = long_runs > m
        words[row[some], 2 * after[some] + 3], sizes[row[some], 2 * after[some] + 3] = code[0xF0], length[0xF0]
        after[some] = zero_col[prior[some] + 16 * (m + 1)]
    negative = coefs[row, col] < 0
    symbol = (run & 15) << 4 | 1
    words[row, 2 * after + 3] = code[symbol] << np.uint64(1) | (~negative).astype(np.uint64)
    sizes[row, 2 * after + 3] = length[symbol] + 1
    last = np.full(n, -1)
    last[row[col_last(row)]] = col[col_last(row)]
    open_ = last < width - 1
    words[open_, 2 * last[open_] + 3], sizes[open_, 2 * last[open_] + 3] = code[0], length[0]
    rows, slots = np.nonzero(sizes)
    return rows, words[rows, slots], sizes[rows, slots].astype(np.int64)


def _marker(kind: int, body: bytes) -> bytes:
    return bytes((0xFF, kind)) + (len(body) + 2).to_bytes(2, "big") + body


def frame_size(units: int) -> tuple[int, int]:
    """Width and height in MCUs that hold so many of them."""
    across = -(-units // MAX_LINES)
    return across, -(-units // across)


def encode(coefs: list[np.ndarray], comments: list[bytes], quant: int = 1) -> list[bytes]:
    """Files of 4:2:0 images; coefs: an image's rows (6 for each MCU of frame_size())."""
    shapes = [frame_size(len(c) // 6) for c in coefs]
    firsts = np.cumsum([0, *map(len, coefs)])
    every = np.concatenate(coefs).astype(np.int64)
    pieces: list[list[bytes]] = []
    tables = b"".join(bytes((k,)) + TABLES[t] for k, t in ((0x00, "dc"), (0x10, "first"), (0x11, "fine")))
    for (w, h), note in zip(shapes, comments, strict=True):
        frame = b"\x08" + (16 * h).to_bytes(2, "big") + (16 * w).to_bytes(2, "big") + b"\x03" + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
        pieces.append([b"\xff\xd8", _marker(0xFE, note), _marker(0xDB, bytes(1) + bytes([quant]) * 64), _marker(0xC2, frame), _marker(0xC4, tables), _marker(0xDD, b"\x00\x01")])
    orders = {}
    for comps in {s[0] for s in SCRIPT}:
        own = [scan_rows(16 * w, 16 * h, SAMPLING, comps) for w, h in shapes]
        place = own[0][1]
        orders[comps] = place, np.concatenate([r + at for (r, _), at in zip(own, firsts, strict=False)]), np.array([len(r) // len(place) for r, _ in own])
    for comps, first, last, high, low in SCRIPT:
        place, rows, units = orders[comps]
        if first == 0:
            values = (every[rows, 0] >> low).reshape(-1, len(place))
            n = len(values)
            events = _dc_first(values, place) if not high else (np.repeat(np.arange(n), len(place)), (values & 1).ravel(), np.ones(values.size, np.int64))
        else:
            band = every[rows, first : last + 1]
            n = len(band)
            events = _ac_fine(band, high, low) if high else _ac_first(band, low)
        data, lengths = _pack(*events, n)
        ends = np.cumsum(units)
        final = np.zeros(n, bool)
        final[ends - 1] = True
        number = np.arange(n) - np.repeat(ends - units, units)
        out, sizes = _segments(data, lengths, number, final)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])]
        head = _marker(0xDA, bytes((len(comps),)) + b"".join(bytes((c + 1, 0x01 if high and first else 0x00)) for c in comps) + bytes((first, last, high << 4 | low)))
        raw = out.tobytes()
        for i, p in enumerate(pieces):
            p += [head, raw[cuts[i] : cuts[i + 1]]]
    return [b"".join([*p, b"\xff\xd9"]) for p in pieces]


# ---- decoding


class Frame:
    """What a file's markers say; scans: (comps, first, last, high, low, table bodies by component, restart interval, start, end)."""

    def __init__(self, data: bytes, ends: list[int]):
        """ends: where FF is followed by neither 0, FF nor a restart marker."""
        self.comment, self.quant, self.scans = b"", {}, []
        self.sampling: tuple = ()
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG file")
        tables: dict[int, bytes] = {}
        ids: list[int] = []
        interval, at = 0, 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise ValueError("no marker where one is due")
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            if kind == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xFE:
                self.comment = body
            elif kind == 0xDB:
                self._quant(body)
            elif kind == 0xC4:
                i = 0
                while i < len(body):
                    n = 17 + sum(body[i + 1 : i + 17])
                    tables[body[i]] = body[i + 1 : i + n]
                    i += n
            elif kind == 0xDD:
                interval = int.from_bytes(body[:2], "big")
            elif kind == 0xC2:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                ids = [body[6 + 3 * i] for i in range(body[5])]
                self.sampling = tuple((body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(body[5]))
                self.tables_of = [body[8 + 3 * i] for i in range(body[5])]
            elif 0xC0 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise ValueError("only progressive Huffman-coded files are read")
            elif kind == 0xDA:
                n = body[0]
                comps = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
                first, last, approx = body[1 + 2 * n : 4 + 2 * n]
                refs = [body[2 + 2 * i] for i in range(n)]
                bodies = tuple(tables.get(r >> 4 if first == 0 else 0x10 | r & 15, b"") for r in refs)
                j = bisect_left(ends, at)
                end = ends[j] if j < len(ends) else len(data)
                self.scans.append((comps, first, last, approx >> 4, approx & 15, bodies, interval, at, end))
                at = end

    def _quant(self, body: bytes) -> None:
        i = 0
        while i < len(body):
            wide = body[i] >> 4
            n = 128 if wide else 64
            self.quant[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
            i += 1 + n

    def script(self) -> tuple:
        return tuple(s[:5] for s in self.scans)


class _Bits:
    """The segments' bytes without stuffing, read at any bit."""

    def __init__(self, raw: np.ndarray):
        drop = np.concatenate([[False], (raw[1:] == 0) & (raw[:-1] == 255)])
        self.shift = np.cumsum(drop)
        clean = np.concatenate([raw[~drop], np.zeros(9, np.uint8)])
        self.bytes = clean
        word = np.zeros(len(clean) - 8, np.uint64)
        for i in range(8):
            word |= clean[i : len(clean) - 8 + i].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.words = np.concatenate([word, np.zeros(1, np.uint64)])

    def place(self, byte: np.ndarray) -> np.ndarray:
        """The bit at which a byte of the raw data lies."""
        return 8 * (byte - self.shift[np.minimum(byte, len(self.shift) - 1)])

    def at(self, pos: np.ndarray) -> np.ndarray:
        """The next bits, at the top of a 64-bit word (57 of them are right)."""
        return self.words[np.minimum(pos >> 3, len(self.words) - 1)] << (pos & 7).astype(np.uint64)


def _take(word: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits of a word behind the first skip."""
    return (((word << skip.astype(np.uint64)) >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)


_U48 = np.uint64(48)


def _signed(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((extra >> np.maximum(size - 1, 0)) & 1, extra, extra - (1 << size) + 1)


def _read_dc(coefs, bits, start, table, lut, rows, lane_first, lane_rows, place, low) -> None:
    """table: (lanes, components of the scan); lanes run through their rows in coding order."""
    pos = start.copy()
    pred = np.zeros((len(pos), int(place.max()) + 1), np.int64)
    lanes = np.arange(len(pos))
    for j in range(int(lane_rows.max(initial=0))):
        lanes = lanes[lane_rows[lanes] > j]
        c = place[j % len(place)]
        word = bits.at(pos[lanes])
        entry = lut[table[lanes, c] + (word >> _U48).astype(np.int64)].astype(np.int64)
        n, size = entry >> 8, entry & 255
        pos[lanes] += n + size
        pred[lanes, c] += np.where(size > 0, _signed(_take(word, n, size), size), 0)
        coefs[rows[lane_first[lanes] + j], 0] = pred[lanes, c] << low


def _read_dc_bits(coefs, bits, start, rows, lane_first, lane_rows, low) -> None:
    lane = np.repeat(np.arange(len(lane_rows)), lane_rows)
    at = start[lane] + np.arange(len(lane)) - np.repeat(np.cumsum(lane_rows) - lane_rows, lane_rows)
    bit = (bits.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    coefs[rows[lane_first[lane] + np.arange(len(lane)) - np.repeat(np.cumsum(lane_rows) - lane_rows, lane_rows)], 0] |= bit.astype(np.int64) << low


def _read_ac(coefs, bits, start, table, lut, rows, lane_first, lane_rows, first, last, low) -> None:
    pos, row, left, table = start.copy(), lane_first.copy(), lane_rows.copy(), table[:, 0]
    k = np.full(len(pos), first)
    live = left > 0
    while True:
        if not live.all():
            pos, row, left, k, table = pos[live], row[live], left[live], k[live], table[live]
        if not len(pos):
            return
        word = bits.at(pos)
        entry = lut[table + (word >> _U48).astype(np.int64)].astype(np.int64)
        n, run, size = entry >> 8, (entry >> 4) & 15, entry & 15
        stop = (size == 0) & (run < 15)
        more = np.where(stop, run, size)
        extra = _take(word, n, more)
        pos += n + more
        k += run
        put = np.flatnonzero(size > 0)
        coefs[rows[row[put]], np.minimum(k[put], 63)] = _signed(extra[put], size[put]) << low
        k += 1
        done = stop | (k > last)
        if done.any():
            # an end-of-band run also covers the blocks behind this one
            skip = np.where(done, 1 + np.where(stop, (1 << run) - 1 + extra, 0), 0)
            row += np.minimum(skip, left)
            left -= np.minimum(skip, left)
            k[done] = first
        if (entry == 0).any():
            raise ValueError("bad code in a scan")
        live = left > 0


def _read_ac_bits(coefs, bits, start, table, lut, rows, lane_first, lane_rows, first, last, low) -> None:
    """Refinement: symbols are followed here, correction bits are noted and applied at the end."""
    width = last + 1 - first
    band = coefs[rows, first : last + 1]
    known = band != 0
    zero_row, zero_col = np.nonzero(~known)
    zeros = np.bincount(zero_row, minlength=len(rows))
    zero_at = np.concatenate([[0], np.cumsum(zeros)])
    zero_col = np.concatenate([zero_col, np.zeros(16, zero_col.dtype)])
    known_row, known_col = np.nonzero(known)
    known_at = np.concatenate([[0], np.cumsum(width - zeros)])
    pos, row, left, table = start.copy(), lane_first.copy(), lane_rows.copy(), table[:, 0]
    k, z, eob = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    notes: list[tuple] = []
    live = left > 0
    while True:
        if not live.all():
            pos, row, left, k, z, eob, table = (x[live] for x in (pos, row, left, k, z, eob, table))
        if not len(pos):
            break
        word = bits.at(pos)
        entry = lut[table + (word >> _U48).astype(np.int64)].astype(np.int64)
        in_run = eob > 0
        n, run, size = entry >> 8, (entry >> 4) & 15, entry & 15
        stop = in_run | ((size == 0) & (run < 15))
        more = np.where(in_run, 0, np.where(stop, run, size & 1))
        extra = _take(word, n, more)
        if ((entry == 0) & ~in_run).any():
            raise ValueError("bad code in a scan")
        pos += np.where(in_run, 0, n + more)
        eob = np.where(in_run, eob - 1, np.where(stop, (1 << run) - 1 + extra, 0))
        beyond = stop | (z + run >= zeros[row])
        target = np.where(beyond, width, zero_col[np.minimum(zero_at[row] + z + run, len(zero_col) - 1)])
        passed = np.where(beyond, zeros[row] - z, run)
        fixes = target - k - passed
        some = np.flatnonzero(fixes > 0)
        notes.append((known_at[row[some]] + k[some] - z[some], pos[some], fixes[some]))
        pos += fixes
        put = np.flatnonzero((size == 1) & ~beyond)
        coefs[rows[row[put]], first + target[put]] = np.where(extra[put] > 0, 1, -1) << low
        z = np.where(beyond, z, z + run + 1)
        k = target + 1
        done = stop | (k >= width)
        row, left = row + done, left - done
        k[done], z[done] = 0, 0
        live = left > 0
    start, at, count = (np.concatenate(x) for x in zip(*notes, strict=True)) if notes else (np.zeros(0, np.int64),) * 3
    ramp = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    which, bit_at = np.repeat(start, count) + ramp, np.repeat(at, count) + ramp
    bit = ((bits.bytes[bit_at >> 3] >> (7 - (bit_at & 7)).astype(np.uint8)) & 1).astype(np.int64)
    r, c = rows[known_row[which]], first + known_col[which]
    coefs[r, c] += np.where(coefs[r, c] > 0, bit, -bit) << low


def decode(files: list[bytes]) -> list[tuple[Frame, np.ndarray]]:
    """Each file's Frame and its coefficient rows."""
    raw = np.frombuffer(b"".join(files), np.uint8)
    offsets = np.cumsum([0, *map(len, files)])
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    again = (after >= 0xD0) & (after <= 0xD7)
    restarts, ends = ff[again], ff[~again & (after != 0) & (after != 255)]
    parts = np.searchsorted(ends, offsets)
    frames = [Frame(f, (ends[a:b] - at).tolist()) for f, at, a, b in zip(files, offsets, parts, parts[1:], strict=False)]
    bits = _Bits(raw)
    found: list = [None] * len(frames)
    groups = defaultdict(list)
    for i, f in enumerate(frames):
        groups[f.sampling, f.script()].append(i)
    for (sampling, script), members in groups.items():
        own = [frames[i] for i in members]
        firsts = np.cumsum([0, *(geometry(f.width, f.height, sampling)[3] for f in own)])
        coefs = np.zeros((int(firsts[-1]), 64), np.int64)
        orders = {}
        for comps in {s[0] for s in script}:
            rows = [scan_rows(f.width, f.height, sampling, comps) for f in own]
            orders[comps] = np.concatenate([r + at for (r, _), at in zip(rows, firsts, strict=False)]), rows[0][1], np.array([len(r) for r, _ in rows])
        for s, (comps, first, last, high, low) in enumerate(script):
            rows, place, n_rows = orders[comps]
            units = n_rows // len(place)
            step = np.array([f.scans[s][6] for f in own])
            step = np.where(step > 0, step, units)
            n = -(-units // step)
            begin, end = (np.array([f.scans[s][i] for f in own]) + offsets[members] for i in (7, 8))
            low_at, high_at = np.searchsorted(restarts, begin), np.searchsorted(restarts, end)
            if (high_at - low_at + 1 < n).any():
                raise ValueError("a scan ends too early")
            file = np.repeat(np.arange(len(own)), n)
            segment = np.arange(len(file)) - np.repeat(np.cumsum(n) - n, n)
            at = begin[file]
            later = segment > 0
            at[later] = restarts[(low_at[file] + segment - 1)[later]] + 2
            start = bits.place(at)
            counts = np.minimum(step[file], units[file] - step[file] * segment) * len(place)
            lane_first = np.cumsum(counts) - counts
            bodies: dict[bytes, int] = {}
            table = 65536 * np.array([[bodies.setdefault(b, len(bodies)) for b in f.scans[s][5]] for f in own])[file]
            lut = np.concatenate([_lookup(b) if b else np.zeros(65536, np.uint16) for b in bodies])
            if first == 0 and high:
                _read_dc_bits(coefs, bits, start, rows, lane_first, counts, low)
            elif first == 0:
                _read_dc(coefs, bits, start, table, lut, rows, lane_first, counts, place, low)
            else:
                (_read_ac_bits if high else _read_ac)(coefs, bits, start, table, lut, rows, lane_first, counts, first, last, low)
        for i, a, b in zip(members, firsts, firsts[1:], strict=False):
            found[i] = (frames[i], coefs[a:b])
    return found


# ---- pixels


@lru_cache(1)
def _basis() -> np.ndarray:
    """(zigzag coefficient, pixel) of the inverse transform."""
    u = np.arange(8)
    one = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)  # (pixel, frequency)
    both = np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)
    return both[zigzag()]


def pixels(frame: Frame, coefs: np.ndarray) -> np.ndarray:
    """Full-resolution RGB (height, width, 3) uint8: inverse transform, chroma upsampled by repetition."""
    _, _, parts, _ = geometry(frame.width, frame.height, frame.sampling)
    hmax, vmax = max(h for h, _ in frame.sampling), max(v for _, v in frame.sampling)
    planes = []
    for (first, across, down, _, _), (h, v), q in zip(parts, frame.sampling, frame.tables_of, strict=True):
        values = (coefs[first : first + across * down] * frame.quant[q]) @ _basis() + 128
        plane = np.clip(np.rint(values, out=values), 0, 255, out=values).astype(np.float32).reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)
        if vmax > v:
            plane = plane.repeat(vmax // v, 0)
        if hmax > h:
            plane = plane.repeat(hmax // h, 1)
        planes.append(plane[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.empty((*y.shape, 3), np.float32)
    rgb[..., 0] = y + np.float32(1.402) * cr
    rgb[..., 1] = y - np.float32(0.344136) * cb - np.float32(0.714136) * cr
    rgb[..., 2] = y + np.float32(1.772) * cb
    return np.clip(np.rint(rgb, out=rgb), 0, 255, out=rgb).astype(np.uint8)
