r"""Token counts by offset-mapped attribution.

A document is encoded once, whole.  The tokens' character spans follow from their byte lengths; they
are joined with the spans of the document's sections, and each section gets the tokens in it.  A
token that crosses a boundary goes by an explicit rule:

* ``majority``: to the section that has most of its characters, the first of those that tie;
* ``first``: to the section of its first character;
* ``split``: to all of them, in proportion to their characters.

A character that takes several tokens begins in the first of them; the others count 0 characters
and go to the section of that character.

Sections tile the document: here lines with their line feed; sections_of can be any function that
gives ascending offsets, 0 first.  fields() joins named fields into one document with its offsets.

Defined results: null text is empty; an empty document has one empty section with 0 tokens; an empty
section gets no token; repeated rows get equal results; a null doc_id is returned as it is; an
empty table gives an empty table; further columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import VOCAB_PATH, encode_text, encoding

RULES = ("majority", "first", "split")
_LENGTHS: dict[str, np.ndarray] = {}


def token_lengths(vocab_path: str) -> np.ndarray:
    """Bytes by token id."""
    if vocab_path not in _LENGTHS:
        enc = encoding(vocab_path)
        _LENGTHS[vocab_path] = np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)
    return _LENGTHS[vocab_path]


def line_starts(text: str) -> np.ndarray:
    """Offsets (code points) at which lines start."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.flatnonzero(points == 10) + 1])
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(points) else starts


def token_starts(text: str, vocab_path: str = VOCAB_PATH) -> np.ndarray:
    """The code point at which each token of the whole text starts, and the text's length."""
    data = text.encode()
    ids = encode_text(text, vocab_path)
    ends = np.concatenate([[0], np.cumsum(token_lengths(vocab_path)[ids])]) if ids else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
    return chars[ends.astype(np.int64)]


def attribute(starts: np.ndarray, sections: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section (starts: token_starts(), sections: offsets from 0)."""
    n = len(sections)
    bounds = np.concatenate([sections, [starts[-1]]])
    begin, end = starts[:-1], starts[1:]
    held = np.searchsorted(sections, np.where(end > begin, begin, begin - 1), "right") - 1
    last = np.searchsorted(sections, np.maximum(end - 1, begin), "right") - 1
    last = np.maximum(last, held)
    crossing = np.flatnonzero(last > held)
    counts = np.bincount(np.delete(held, crossing), minlength=n).astype(np.float64)
    crossed = np.zeros(n, np.int64)
    for t in crossing:
        span = np.arange(held[t], last[t] + 1)
        inside = np.minimum(end[t], bounds[span + 1]) - np.maximum(begin[t], bounds[span])
        crossed[span[inside > 0]] += 1
        if rule == "split":
            counts[span] += inside / inside.sum()
        else:
            counts[span[np.argmax(inside)] if rule == "majority" else held[t]] += 1
    return counts, crossed


def fields(*named: tuple[str, Column], between: str = "\n\n") -> Column:
    """A struct of text (the fields joined) and starts (where each field starts); null fields are empty."""
    parts = [F.coalesce(c, F.lit("")) for _, c in named]
    text, starts = parts[0], [F.lit(0)]
    for part in parts[1:]:
        text = F.concat(text, F.lit(between))
        starts.append(F.length(text))
        text = F.concat(text, part)
    return F.struct(text.alias("text"), F.array(*starts).alias("starts"))


_OUT = "doc_id bigint, section bigint, start bigint, n_chars bigint, n_tokens double, n_crossing bigint"


def section_tokens(df: DataFrame, doc_id: str = "doc_id", text: str = "text", starts: str | None = None, rule: str = "majority", sections_of: Callable[[str], np.ndarray] = line_starts, vocab_path: str = VOCAB_PATH) -> DataFrame:
    """A row per section: doc_id, section (from 0), start, n_chars, n_tokens, n_crossing.

    starts: a column of ascending section offsets (as fields() gives them) instead of sections_of.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = [F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")] + ([F.col(starts).alias("s")] if starts else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, rows = [], []
                for i, (d, t) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    t = t or ""
                    bounds = np.array(part.column(2)[i].as_py() or [0]) if starts else sections_of(t)
                    counts, crossed = attribute(token_starts(t, vocab_path), bounds, rule)
                    ids += [d] * len(bounds)
                    rows.append((np.arange(len(bounds)), bounds, np.diff([*bounds, len(t)]), counts, crossed))
                if rows:
                    cols = [np.concatenate(c) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())] + [pa.array(c, pa.float64() if i == 3 else pa.int64()) for i, c in enumerate(cols)], names=[f.split()[0] for f in _OUT.split(", ")])

    return df.select(*columns).mapInArrow(run, _OUT)
