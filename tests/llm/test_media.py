import hashlib
import random
import zlib

import numpy as np
import pytest

from leafstream.llm import jpeg, media


def rows_of(rng, units, density, top):
    across, down = jpeg.frame_size(units)
    shape = (6 * across * down, 64)
    return (rng.integers(-top, top + 1, shape) * (rng.random(shape) < density)).astype(np.int64)


@pytest.mark.parametrize("density,top", [(0, 1), (0.02, 1), (0.1, 3), (0.5, 200), (1, 700)])
def test_coefficients_come_back(density, top):
    rng = np.random.default_rng(5)
    images = [rows_of(rng, n, density, top) for n in (1, 2, 7)]
    for (frame, got), want in zip(jpeg.decode(jpeg.encode(images, [b"x"] * 3)), images, strict=True):
        assert (got == want).all() and frame.comment == b"x"


def scalar_decode(data):
    """A plain reader of the same format, bit by bit, for 4:2:0 files with any restart interval."""
    tables, scans, at, interval, size = {}, [], 2, 0, None
    while data[at + 1] != 0xD9:
        kind, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xC4:
            i = 0
            while i < len(body):
                counts, code, book, j = body[i + 1 : i + 17], 0, {}, i + 17
                for length, c in enumerate(counts, 1):
                    for _ in range(c):
                        book[length, code] = body[j]
                        code, j = code + 1, j + 1
                    code <<= 1
                tables[body[i]], i = book, j
        elif kind == 0xC2:
            size = int.from_bytes(body[3:5], "big") // 16, int.from_bytes(body[1:3], "big") // 16
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xDA:
            end = at
            while not (data[end] == 0xFF and data[end + 1] not in (0, *range(0xD0, 0xD8))):
                end += 1
            scans.append((body, data[at:end], interval))
            at = end
    across, down = size
    out = np.zeros((6 * across * down, 64), np.int64)
    first = [0, 4 * across * down, 5 * across * down]
    for body, raw, interval in scans:
        comps = [body[1 + 2 * i] - 1 for i in range(body[0])]
        ss, se, approx = body[1 + 2 * body[0] :]
        high, low = approx >> 4, approx & 15
        if len(comps) == 1:
            c = comps[0]
            units = [[(c, first[c] + i)] for i in range((4 if c == 0 else 1) * across * down)]
        else:
            units = []
            for y in range(down):
                for x in range(across):
                    luma = [(0, (2 * y + a) * 2 * across + 2 * x + b) for a in (0, 1) for b in (0, 1)]
                    units.append([*luma, (1, first[1] + y * across + x), (2, first[2] + y * across + x)])
        parts, i = [bytearray()], 0
        while i < len(raw):
            if raw[i] == 0xFF and raw[i + 1] == 0:
                parts[-1].append(255)
                i += 2
            elif raw[i] == 0xFF:
                parts.append(bytearray())
                i += 2
            else:
                parts[-1].append(raw[i])
                i += 1
        step = interval or len(units)
        for s, part in enumerate(parts):
            bits = "".join(f"{b:08b}" for b in part)
            pos, eob, pred = 0, 0, {}

            def take(n):
                nonlocal pos
                pos += n
                return int(bits[pos - n : pos] or "0", 2)

            def symbol(book):
                nonlocal pos
                for n in range(1, 17):
                    if (v := book.get((n, int(bits[pos : pos + n], 2)))) is not None:
                        pos += n
                        return v
                raise AssertionError("no code")

            def extend(n):
                v = take(n)
                return v if n and v >> (n - 1) else v - (1 << n) + 1

            for unit in units[s * step : (s + 1) * step]:
                for c, row in unit:
                    refs = body[2 + 2 * comps.index(c)]
                    if ss == 0 and high:
                        out[row, 0] |= take(1) << low
                    elif ss == 0:
                        n = symbol(tables[refs >> 4])
                        pred[c] = pred.get(c, 0) + (extend(n) if n else 0)
                        out[row, 0] = pred[c] << low
                    else:
                        book, k = tables[0x10 | refs & 15], ss
                        while k <= se and not (eob and not high):
                            if eob:
                                break
                            v = symbol(book)
                            r, n = v >> 4, v & 15
                            if n == 0 and r < 15:
                                eob = (1 << r) + (take(r) if r else 0)
                                break
                            if not high:
                                k += r
                                if n:
                                    out[row, k] = extend(n) << low
                                k += 1
                            else:
                                sign = (1 if take(1) else -1) if n else 0
                                while k <= se:
                                    if out[row, k]:
                                        out[row, k] += (1 if out[row, k] > 0 else -1) * (take(1) << low)
                                    elif r == 0:
                                        break
                                    else:
                                        r -= 1
                                    k += 1
                                if sign and k <= se:
                                    out[row, k] = sign << low
                                k += 1
                        if eob:
                            if high:
                                for j in range(k, se + 1):
                                    if out[row, j]:
                                        out[row, j] += (1 if out[row, j] > 0 else -1) * (take(1) << low)
                            eob -= 1
    return out


def test_a_plain_reader_agrees():
    rng = np.random.default_rng(2)
    images = [rows_of(rng, 3, d, t) for d, t in ((0.05, 2), (0.4, 90), (0.02, 1))]
    for file, want in zip(jpeg.encode(images, [b""] * 3), images, strict=True):
        assert (scalar_decode(file) == want).all()


def test_tables_are_prefix_codes():
    for body in jpeg.TABLES.values():
        words = [f"{c:0{n}b}" for _, c, n in jpeg._codes(body)]
        assert not any(a != b and b.startswith(a) for a in words for b in words) and not any(set(w) == {"1"} for w in words)


def test_inverse_transform_and_chroma():
    coefs = np.zeros((6, 64), np.int64)
    coefs[:4, 0], coefs[4, 0] = (8, 16, 24, 32), 40
    frame, got = jpeg.decode(jpeg.encode([coefs], [b""], quant=2))[0]
    rgb = jpeg.pixels(frame, got)
    assert rgb.shape == (16, 16, 3)
    luma = [128 + 2, 128 + 4, 128 + 6, 128 + 8]
    for (y, x), v in zip(((0, 0), (0, 8), (8, 0), (8, 8)), luma, strict=True):
        assert tuple(rgb[y + 3, x + 3]) == (v, round(v - 0.344136 * 10), round(v + 17.72))
    basis = jpeg._basis()
    assert np.allclose(basis @ basis.T, np.eye(64))


def brute(text):
    data = (text or "").encode()
    payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def test_round_trip(docs, rows):
    extra = ["\x00\x01 weird \U0001f600", "x" * 192, "é" * 97]
    df = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(9000 + i, t) for i, t in enumerate(extra)], "doc_id bigint, text string"))
    texts = {d: t for d, t, *_ in rows} | {9000 + i: t for i, t in enumerate(extra)}
    seen = {}
    for r in media.round_trip_digests(df).collect():
        if r.doc_id is not None:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == brute(texts[r.doc_id])
            assert seen.setdefault(texts[r.doc_id], r[4:]) == r[4:]


def test_store_and_load(docs, clashing, empty):
    stored = media.store(docs)
    loaded = media.load(stored).collect()
    assert len(loaded) == docs.count() and all(len(r.rgb) == 3 * r.width * r.height for r in loaded)
    assert media.load(stored.where("doc_id = 1").selectExpr("doc_id", "CAST(NULL AS BINARY) AS media")).first().rgb is None
    assert media.round_trip_digests(clashing).count() == clashing.count() and media.round_trip_digests(empty).count() == 0
    with pytest.raises(ValueError):
        jpeg.decode([b"no image"])


def test_wide_image():
    rng = random.Random(1)
    text = "".join(rng.choice("abc dé") for _ in range(1_700_000))
    frame, coefs = jpeg.decode(media.store_texts([text]))[0]
    assert frame.width > 16 and media.payload_from(frame, coefs)[1].rstrip(b" ") == text.encode().rstrip(b" ")
