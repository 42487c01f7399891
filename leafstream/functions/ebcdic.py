"""EBCDIC text in Catalyst: a code page is a 256-character string, decoding is ``translate``.

``decode`` first reads bytes as Latin-1, so every byte is one character, and then translates those
characters to the code page's; ``encode`` goes the other way.  NUL stands for itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BYTES = bytes(range(256))
_LATIN = _BYTES.decode("latin-1")


def _changed(base: str, changes: dict[int, str]) -> str:
    return "".join(changes.get(i, c) for i, c in enumerate(base))


# Where the international page used here leaves the standard one, and the French one leaves that.
CP037 = _BYTES.decode("cp037")
CP500 = _changed(_BYTES.decode("cp500"), {0xA1: "ß", 0xB5: "@", 0xC0: "ä", 0xD0: "ü", 0xE0: "Ö", 0xEC: "Ä", 0xFC: "Æ"})
CP297 = _changed(CP500, {0x5A: "é", 0xC0: "à", 0xD0: "è"})

_PAGES = {"cp037": CP037, "cp500": CP500, "cp297": CP297, "cp1147": CP297, "cp1144": CP297}


def register_code_page(name: str, mapping: list[int] | str) -> None:
    """Adds a code page of exactly 256 code points (given as numbers or as a string)."""
    text = mapping if isinstance(mapping, str) else "".join(map(chr, mapping))
    if len(text) != 256:
        raise ValueError(f"a code page has 256 entries, not {len(text)}")
    _PAGES[name.lower()] = text


def code_page(name: str) -> str:
    try:
        return _PAGES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown code page: {name}") from None


def decode(data: Column, page: str = "cp037") -> Column:
    """Bytes to text."""
    table = code_page(page)
    moved = [(a, b) for a, b in zip(_LATIN, table, strict=True) if a != b and b != "\0"]
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(a for a, _ in moved), "".join(b for _, b in moved))


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    """Runs of neighbouring numbers."""
    out: list[list[int]] = []
    for p in sorted(points):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def encode(text: Column, page: str = "cp037") -> Column:
    """Text to bytes; a character that the page lacks becomes 0x3F."""
    table = code_page(page)
    places: dict[str, int] = {}
    for i, c in enumerate(table):
        places[c] = i  # of two bytes for a character the later one counts
    inside = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _ranges([ord(c) for c in places]))
    known = F.regexp_replace(text, f"[^{inside}]", "\x1a")  # the page's 0x3F
    moved = [(c, _LATIN[i]) for c, i in sorted(places.items()) if c != _LATIN[i] and i]
    return F.encode(F.translate(known, "".join(a for a, _ in moved), "".join(b for _, b in moved)), "ISO-8859-1")


def strip_controls(text: Column) -> Column:
    """Without C0 and C1 control characters and DEL."""
    return F.regexp_replace(text, "[\\x00-\\x1F\\x7F-\\x9F]", "")


#: The white space that js_trim() takes off, for str.strip() in tasks.
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(text: Column) -> Column:
    """Without white space (any that Unicode has) at both ends."""
    space = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"
    return F.regexp_replace(text, f"^{space}|{space}$", "")


_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# The symbols that each name decoder knows, besides letters and digits.
_SYMBOLS = {
    "group": " .,'*-/%&@",
    "tag": " .,'-/&_:;!=*#@()",
    "label": " _",
    "upper": " .-_/$#@",
}


def _kept(policy: str) -> str:
    letters = _UPPER if policy == "upper" else _UPPER + _LOWER
    return letters + _DIGIT + _SYMBOLS[policy]


def decode_name(data: Column, policy: str = "tag") -> Column:
    """A name field, decoded from letters, digits and a few symbols.

    group: ends at the first blank, other bytes become '?'; tag: other bytes vanish, trimmed;
    label: blanks become '_', other bytes vanish, trailing '_' go; upper: as tag, without lower case.
    """
    if policy == "group":
        first = F.substring_index(F.decode(data, "ISO-8859-1"), "\x40", 1)
        table = {c: CP037.index(c) for c in _kept(policy)}
        source = "".join(_LATIN[i] for i in table.values())
        other = "".join(c for c in _LATIN if c not in source)
        return F.translate(first, source + other, "".join(table) + "?" * len(other))
    table = {c: (0x4F if c == "!" else CP037.index(c)) for c in _kept(policy)}
    source = "".join(_LATIN[i] for i in table.values())
    other = "".join(c for c in _LATIN if c not in source and c != "\0")
    text = F.translate(F.decode(data, "ISO-8859-1"), source + other, "".join(table))
    text = F.regexp_replace(text, "\\x00", "")
    if policy == "label":
        return F.regexp_replace(F.translate(text, " ", "_"), "_+$", "")
    return js_trim(text)
