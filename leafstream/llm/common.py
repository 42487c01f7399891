"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Shelf, batches_of  # noqa: F401  (the operators take both from here)

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Where the vocabulary files lie by default; every operator takes the path as a parameter.
VOCAB_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the byte-level 50k ranks.
VOCAB_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODINGS: dict[str, object] = {}


def encoding(path: str = VOCAB_PATH):
    """The tiktoken encoding of a rank file, loaded once in each Python worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=VOCAB_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


#: White space as the split pattern means it, in runs that its look-ahead can't take (it keeps a state a character).
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{65536,}")


def encode_text(text: str, path: str = VOCAB_PATH) -> list[int]:
    """The tokens of a text of any length.

    The split pattern takes a run of white space but for its last character as one piece, or all of it
    at the text's end; such pieces of long runs are encoded without the pattern, to the same tokens.
    """
    enc = encoding(path)
    out, at = [], 0
    for m in _BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def map_rows(df: DataFrame, rows: Callable[[list[dict]], list[dict]], schema: str, slice_rows: int = 512) -> DataFrame:
    """mapInArrow over small slices, so that a worker holds few Python objects at a time.

    rows: takes and returns a list of dicts; it need not keep the number of rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                got = rows(batch.slice(at, slice_rows).to_pylist())
                if got:
                    yield pa.RecordBatch.from_pylist(got, schema=arrow)

    return df.mapInArrow(run, schema)


def n_words(text: Column) -> Column:
    """How many words a text has; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def token_count(text: Column, vocab_path: str = VOCAB_PATH) -> Column:
    """How many vocabulary tokens a text has; null counts as empty."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encode_text(t, vocab_path)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row even where use has it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)
