"""Barcodes: descriptors and module patterns (1 dark, 0 light) as strings, in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import be_uint, once

# Widths of Code 128's symbols 0 to 105 (dark and light in turn) and its stop.
_C128 = """
212222 222122 222221 121223 121322 131222 122213 122312 132212 221213 221312 231212 112232 122132 122231 113222 123122 123221
223211 221132 221231 213212 223112 312131 311222 321122 321221 312212 322112 322211 212123 212321 232121 111323 131123 131321
112313 132113 132311 211313 231113 231311 112133 112331 132131 113123 113321 133121 313121 211331 231131 213113 213311 213131
311123 311321 331121 312113 312311 332111 314111 221411 431111 111224 111422 121124 121421 141122 141221 112214 112412 122114
122411 142112 142211 241211 221114 413111 241112 134111 111242 121142 121241 114212 124112 124211 411212 421112 421211 212141
214121 412121 111143 111341 131141 114113 114311 411113 411311 113141 114131 311141 411131 211412 211214 211232
"""
_C128_STOP, _START_B = "2331112", 104
# Code 39 (w wide, n narrow; dark and light in turn).
_C39 = """
0nnnwwnwnn 1wnnwnnnnw 2nnwwnnnnw 3wnwwnnnnn 4nnnwwnnnw 5wnnwwnnnn 6nnwwwnnnn 7nnnwnnwnw 8wnnwnnwnn 9nnwwnnwnn
Awnnnnwnnw Bnnwnnwnnw Cwnwnnwnnn Dnnnnwwnnw Ewnnnwwnnn Fnnwnwwnnn Gnnnnnwwnw Hwnnnnwwnn Innwnnwwnn Jnnnnwwwnn
Kwnnnnnnww Lnnwnnnnww Mwnwnnnnwn Nnnnnwnnww Ownnnwnnwn Pnnwnwnnwn Qnnnnnnwww Rwnnnnnwwn Snnwnnnwwn Tnnnnwnwwn
Uwwnnnnnnw Vnwwnnnnnw Wwwwnnnnnn Xnwnnwnnnw Ywwnnwnnnn Znwwnwnnnn -nwnnnnwnw .wwnnnnwnn $nwnwnwnnn /nwnwnnnwn
+nwnnnwnwn %nnnwnwnwn *nwnnwnwnn
"""
_C39_BLANK = "nwwnnnwnn"
# EAN left patterns of the digits, and which of a code's left digits are of the even set.
_EAN_L = "0001101 0011001 0010011 0111101 0100011 0110001 0101111 0111011 0110111 0001011".split()
_EAN_SETS = "LLLLLL LLGLGG LLGGLG LLGGGL LGLLGG LGGLLG LGGGLL LGLGLG LGLGGL LGGLGL".split()
# Interleaved 2 of 5, wide elements of the digits.
_I25 = "nnwwn wnnnw nwnnw wwnnn nnwnw wnwnn nwwnn nnnww wnnwn nwnwn".split()
# Barcode type codes.
KINDS = {0x01: "code39", 0x03: "upca", 0x08: "ean13", 0x0C: "interleaved2of5", 0x11: "code128", 0x1C: "datamatrix", 0x20: "qr"}


def _bars(widths: str) -> str:
    return "".join("10"[i % 2] * int(w) for i, w in enumerate(widths))


def _wide(pattern: str, wide: int = 3) -> str:
    return "".join("10"[i % 2] * (wide if c == "w" else 1) for i, c in enumerate(pattern))


C128 = [_bars(w) for w in _C128.split()]
C39 = {t[0]: _wide(t[1:]) for t in _C39.split()} | {" ": _wide(_C39_BLANK)}
EAN_L = _EAN_L
EAN_R = ["".join("10"[int(c)] for c in p) for p in EAN_L]
EAN_G = [p[::-1] for p in EAN_R]


def _table(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _codes(text: Column) -> Column:
    """Values of the characters that Code 128 B has."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - 32)


def code128_checksum(text: Column) -> Column:
    """Start B and every value times its place, modulo 103; other characters count nothing but keep their place."""
    weighted = F.transform(_codes(text), lambda v, i: F.when((v >= 0) & (v < len(C128)), v * (i + 1)).otherwise(0))
    return F.pmod(F.aggregate(weighted, F.lit(_START_B), lambda a, v: a + v), F.lit(103))


def code128(text: Column) -> Column:
    """Modules of Code 128 B: start, characters, checksum, stop."""
    table = _table(C128)
    kept = F.filter(_codes(text), lambda v: (v >= 0) & (v < len(C128)))
    body = F.array_join(F.transform(kept, lambda v: F.get(table, v)), "")
    return F.concat(F.lit(C128[_START_B]), body, F.get(table, code128_checksum(text)), F.lit(_bars(_C128_STOP)))


def code39(text: Column) -> Column:
    """Modules of Code 39 between stars, a light module behind each character."""
    table = F.create_map(*[F.lit(x) for p in C39.items() for x in p])
    marked = F.split(F.concat(F.lit("*"), F.upper(text), F.lit("*")), "")
    known = F.filter(marked, lambda c: c.isin(*C39))
    return F.array_join(F.transform(known, lambda c: F.concat(F.element_at(table, c), F.lit("0"))), "")


def ean13(text: Column) -> Column:
    """Modules of EAN-13 of the text's digits, filled with leading zeros or cut to 13."""
    digits = F.substring(F.lpad(F.regexp_replace(text, "[^0-9]", ""), 13, "0"), 1, 13)

    def modules(d: Column) -> Column:
        at = lambda i: F.get(d, i).cast("int")
        sets = F.get(_table(_EAN_SETS), at(0))
        left = [F.when(F.substring(sets, i, 1) == "L", F.get(_table(EAN_L), at(i))).otherwise(F.get(_table(EAN_G), at(i))) for i in range(1, 7)]
        right = [F.get(_table(EAN_R), at(i)) for i in range(7, 13)]
        return F.concat(F.lit("101"), *left, F.lit("01010"), *right, F.lit("101"))

    return once(F.split(digits, ""), modules)


def interleaved(text: Column) -> Column:
    """Modules of interleaved 2 of 5 of the text's digits (an odd number gets a leading zero)."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    even = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    pairs = [_wide("".join(x + y for x, y in zip(_I25[a], _I25[b], strict=True))) for a in range(10) for b in range(10)]
    table = F.create_map(*[F.lit(x) for i, p in enumerate(pairs) for x in (f"{i:02d}", p)])
    body = F.array_join(F.transform(F.regexp_extract_all(even, F.lit("(..)")), lambda p: F.element_at(table, p)), "")
    return F.concat(F.lit("1010"), body, F.lit("11101"))


def modules(kind: Column, text: Column) -> Column:
    """Modules by kind; matrix codes have none here (placeholder()), unknown kinds are Code 128."""
    return F.when(kind == "code39", code39(text)).when(kind.isin("ean13", "upca"), ean13(text)).when(kind == "interleaved2of5", interleaved(text)).when(kind.isin("qr", "datamatrix"), F.lit(None).cast("string")).otherwise(code128(text))


def placeholder(label: Column) -> Column:
    """10 rows of 10 cells that stand for a matrix code: a hash of the label's characters."""
    cell = lambda r, c: (F.ascii(F.substring(label, F.pmod(F.lit(r), F.greatest(F.length(label), F.lit(1))) + 1, F.lit(1))) * 31 + c * 17 + r * 7).bitwiseAND(255) > 128
    return F.concat_ws("/", *[F.concat(*[F.when(cell(r, c), "1").otherwise("0") for c in range(10)]) for r in range(10)])


def descriptor(data: Column) -> dict[str, Column]:
    """kind, module_width, bar_height, human_readable, orientation and color of a descriptor."""
    n = F.length(data)
    kinds = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    turn = be_uint(data, 6, 1)
    return {
        "kind": F.coalesce(F.get(F.map_values(F.map_filter(kinds, lambda k, v: k == be_uint(data, 0, 1))), F.lit(0)), F.lit("code128")),
        "module_width": F.when((n >= 2) & (be_uint(data, 1, 1) > 0), be_uint(data, 1, 1)).otherwise(10),
        "bar_height": F.when((n >= 4) & (be_uint(data, 2, 2) > 0), be_uint(data, 2, 2)).otherwise(720),
        "human_readable": F.when(n >= 6, be_uint(data, 5, 1) % 2 == 1).otherwise(True),
        "orientation": F.when(turn == 0x5A, 90).when(turn == 0xB4, 180).when(turn.isin(0x0E, 0x10), 270).otherwise(0),
        "color": F.when(n >= 8, be_uint(data, 7, 1)).otherwise(0),
    }
