r"""Secret scan by token efficiency.

Natural words need few vocabulary tokens for their length, random strings need many.  A run of
key characters whose characters-per-token ratio under a tiktoken vocabulary is low is therefore
reported as kind ``random``, unless it is a known digest (hex of a digest's length), a UUID, a
decimal number or words joined by separators, each in one case or capitalised; other identifiers
pass by their own ratio.  Of a run that passes, the parts between ``/`` and ``=``, then those between
``_``, ``-`` and ``+`` are tested alike; runs and parts have LEAST characters or more.
Beside these the scan reports three fixed kinds: ``assign``, ``access`` and ``hex``.

Defined results: null text counts as empty (no spans); spans are code-point offsets, end
exclusive, in order of start, then kind; of a ``random`` run or
part that overlaps fixed spans what lies outside them is reported; texts are scanned whole; a repeated row is scanned like any other;
an empty table gives an empty table; other columns of the input aren't looked at.
"""

from __future__ import annotations

import bisect
import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import VOCAB_PATH, encoding, map_rows

KINDS = ("assign", "access", "hex", "random")
#: Only a text with one of these (in lower case) can hold an assignment.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
LEAST = 16
#: What a run is split at, then its parts.
CUTS = (re.compile(r"[^/=]+"), re.compile(r"[^/=_+-]+"))
#: Lengths in hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
HEX_ANY = re.compile(r"[0-9a-fA-F]+")
ALPHA = re.compile(r"[A-Za-z_/=+-]+")
JOINED = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[/_=+-]+(?:[A-Z]?[a-z]+|[A-Z]+))+")
LETTER = re.compile(r"[A-Za-z]")


def is_known(run: str) -> bool:
    """Digests and identifiers, which look random but are no secrets."""
    bare = run.strip("=-_/+")
    if len(bare) in DIGESTS and HEX_ANY.fullmatch(bare):
        return True
    if UUID.fullmatch(bare) or not ALPHA.search(bare):
        return True
    # digit-free: rules of punctuation, words joined by separators
    return not any(c.isdigit() for c in bare) and (len(LETTER.findall(bare)) < LEAST or bool(JOINED.fullmatch(bare)) and max(map(len, re.split(r"[/_=+-]+", bare))) < LEAST)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The three fixed kinds, leftmost and non-overlapping within a kind."""
    found = []
    low = text.lower() if ("=" in text or ":" in text) else ""
    if low and any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def random_spans(text: str, ratio: float, vocab_path: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The runs and parts of low ratio, less what the base spans cover.

    reach: how far the base spans up to one go, so that what covers a part is found by bisection, however many there are.
    """
    out, encode = [], None
    taken = sorted((a, b) for a, b, _ in base)
    starts, reach = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    behind = lambda at: reach[i - 1] if (i := bisect.bisect_right(starts, at)) else 0
    for m in RUN.finditer(text):
        # a run that a fixed span covers in part is judged by parts: the fixed span alone can make its ratio low
        free = behind(m.start()) <= m.start() and bisect.bisect_right(starts, m.start()) == bisect.bisect_left(starts, m.end())
        todo = [(*m.span(), 0)] if free else [(m.start() + p.start(), m.start() + p.end(), 1) for p in CUTS[0].finditer(m[0])]
        while todo:
            start, end, level = todo.pop()
            if end - start < LEAST or behind(start) >= end:
                continue
            run = text[start:end]
            encode = encode or encoding(vocab_path).encode_ordinary
            if not is_known(run) and end - start < ratio * len(encode(run)):
                at = max(start, behind(start))
                for a, b in taken[bisect.bisect_right(starts, start) : bisect.bisect_left(starts, end)]:
                    if at < a:
                        out.append((at, a, "random"))
                    at = max(at, b)
                if at < end:
                    out.append((at, end, "random"))
            elif level < len(CUTS):
                todo += [(start + p.start(), start + p.end(), level + 1) for p in CUTS[level].finditer(run)]
    return out


def scan_text(text: str, ratio: float = 2.0, vocab_path: str = VOCAB_PATH) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text, by start, then kind as listed in KINDS."""
    base = base_spans(text)
    return sorted(base + random_spans(text, ratio, vocab_path, base), key=lambda s: (s[0], KINDS.index(s[2])))


def redact_text(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with each union of overlapping spans replaced by the mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ratio: float = 2.0, vocab_path: str = VOCAB_PATH) -> DataFrame:
    """A row per input row: the columns of keep and spans array<struct<start,end,kind>>."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", spans array<struct<start:bigint,end:bigint,kind:string>>"

    def rows(batch: list[dict]) -> list[dict]:
        return [{c: r[c] for c in keep} | {"spans": [dict(zip(("start", "end", "kind"), s, strict=True)) for s in scan_text(r[text] or "", ratio, vocab_path)]} for r in batch]

    return map_rows(df.select(*dict.fromkeys((*keep, text))), rows, schema)


def redact(df: DataFrame, text: str = "text", length: str | None = None, ratio: float = 2.0, vocab_path: str = VOCAB_PATH) -> DataFrame:
    """The input with every span of the text replaced by a mark; the schema stays.

    length: a column that is to hold the new text's length.  A null text stays null.
    """

    def rows(batch: list[dict]) -> list[dict]:
        for r in batch:
            if r[text] and (spans := scan_text(r[text], ratio, vocab_path)):
                r[text] = redact_text(r[text], spans)
                if length:
                    r[length] = len(r[text])
        return batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_rows(df, rows, schema)


def _said(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined."""
    some = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(df: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of scan()'s rows."""
    counted = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [counted(k).alias(f"n_{k}") for k in KINDS[:3]]
    return df.select("doc_id", *counts, F.sha2(_said(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), _said(KINDS).alias("spans"))
