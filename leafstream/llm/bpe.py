"""Byte-level BPE: encoding to token ids and decoding, by contiguous rank arrays.

A text is split at the vocabulary's added tokens, the rest by the byte-level split pattern into words.
Of a short word the part boundaries and the ranks of adjacent parts are held in two contiguous lists: the
least rank is looked for from the left, its boundary deleted and the neighbouring ranks refreshed, until no
two adjacent parts merge.  A word of more than SHORT bytes would make that scan quadratic; its ranks wait
in a heap beside linked boundaries, which gives the same merges in the same order.

The vocabulary is a tokenizers file (``byte_bpe_50k.json``) with a BPE model, a byte-level pre-tokenizer without prefix
space and no normalizer; other kinds are errors.  Nothing is trained.  Words of up to CACHED characters
are encoded once a worker; that memory is emptied at CACHE entries.

Defined results: null text is empty (no tokens, decoded to an empty text); texts are encoded whole; the string of
an added token in a text becomes that token, as the library does it unless told otherwise (``special=False`` takes
it as ordinary text); ids that the vocabulary lacks decode to nothing and bytes that aren't UTF-8 to U+FFFD; a repeated
row is encoded like any other; an empty table gives an empty table; further columns aren't looked at.
"""

from __future__ import annotations

import heapq
import itertools
import json
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import VOCAB_PATTERN

#: Where the vocabulary lies by default; a parameter of every operator.
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.json"
SHORT, CACHED, CACHE = 128, 64, 1 << 19
#: Characters of a text that are split in one go.
STRETCH = 1 << 20
NEVER = sys.maxsize


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Vocabulary:
    """Ids by byte, ranks of merges by pair of ids, bytes by id, and the added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre, model = told.get("pre_tokenizer") or {}, told["model"]
        plain = not (told.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        added = told.get("added_tokens") or []
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError(f"{path} has added tokens that take in what is beside them")
        ids = model["vocab"]
        of_char = {c: b for b, c in byte_characters().items()}
        self.bytes = {i: bytes(of_char[c] for c in token) for token, i in ids.items()} | {a["id"]: a["content"].encode() for a in added}
        self.first = [ids[c] for _, c in sorted(byte_characters().items())]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: By left << 32 | right: the merge's rank; by rank: the merged id.
        self.ranks, self.merged = {}, []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[ids[a] << 32 | ids[b]] = rank
            self.merged.append(ids[a + b])
        self.added = {a["content"]: a["id"] for a in added}
        self.cuts = regex.compile("|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True))) if added else None


def encode_short(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """The ids of a word: its parts and the ranks of adjacent parts in contiguous lists."""
    rank, merged = vocabulary.ranks.get, vocabulary.merged
    parts = list(map(vocabulary.first.__getitem__, word))
    ranks = [rank(a << 32 | b, NEVER) for a, b in itertools.pairwise(parts)]
    while ranks and (least := min(ranks)) < NEVER:
        at = ranks.index(least)
        parts[at] = new = merged[least]
        del parts[at + 1], ranks[at]
        if at:
            ranks[at - 1] = rank(parts[at - 1] << 32 | new, NEVER)
        if at < len(ranks):
            ranks[at] = rank(new << 32 | parts[at + 1], NEVER)
    return parts


def encode_long(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """The same ids for a word of any length: ranks in a heap, by rank, then place."""
    rank, merged = vocabulary.ranks.get, vocabulary.merged
    parts = list(map(vocabulary.first.__getitem__, word))
    n = len(parts)
    behind, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(itertools.pairwise(parts)) if (r := rank(a << 32 | b)) is not None]
    heapq.heapify(heap)

    def adjacent(at: int) -> None:
        if at >= 0 and behind[at] < n and (r := rank(parts[at] << 32 | parts[behind[at]])) is not None:
            heapq.heappush(heap, (r, at, parts[at], parts[behind[at]]))

    while heap:
        least, at, left, right = heapq.heappop(heap)
        then = behind[at]
        if parts[at] != left or then >= n or parts[then] != right:
            continue  # one of the two was merged meanwhile
        parts[at], parts[then] = merged[least], -1
        behind[at] = behind[then]
        if behind[at] < n:
            before[behind[at]] = at
        adjacent(at)
        adjacent(before[at])
    return [p for p in parts if p >= 0]


class _Words(dict):
    """Packed ids by word, encoded when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = encode_short(raw, self.vocabulary) if len(raw) <= SHORT else encode_long(raw, self.vocabulary)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHED:
            if len(self) >= CACHE:
                self.clear()
            self[word] = packed
        return packed


class Codec:
    """Encodes and decodes with a vocabulary; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str = TOKENIZER_PATH):
        self.vocabulary = Vocabulary(path)
        self.words = _Words(self.vocabulary)
        self.split = regex.compile(VOCAB_PATTERN)
        self.size = max(self.vocabulary.bytes) + 1
        # one entry more, empty: that of every id that the vocabulary lacks
        self.table = pa.array([self.vocabulary.bytes.get(i, b"") for i in range(self.size + 1)], pa.large_binary())

    def _ordinary(self, text: str) -> Iterator[bytes]:
        if len(text) <= STRETCH:
            yield b"".join(map(self.words.__getitem__, self.split.findall(text)))
            return
        found = self.split.finditer(text)
        while some := [m[0] for m in itertools.islice(found, STRETCH // 16)]:
            yield b"".join(map(self.words.__getitem__, some))

    def encode(self, text: str, special: bool = True) -> bytes:
        """The packed ids of a text."""
        out, at = [], 0
        cuts = self.vocabulary.cuts.finditer(text) if special and self.vocabulary.cuts else ()
        for m in cuts:
            out += self._ordinary(text[at : m.start()])
            out.append(struct.pack("<I", self.vocabulary.added[m[0]]))
            at = m.end()
        out += self._ordinary(text[at:] if at else text)
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: their bytes are taken from one table, which lays them behind each other."""
        ids = np.minimum(np.frombuffer(packed, "<u4"), self.size).astype(np.int64)
        taken = self.table.take(pa.array(ids))
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, np.int64)
        return bytes(memoryview(data)[: ends[len(ids)]]).decode("utf-8", "replace") if len(ids) else ""


_CODECS: dict[str, Codec] = {}


def codec(path: str = TOKENIZER_PATH) -> Codec:
    """The codec of a vocabulary file, read once in each Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


#: Bytes of texts or ids that a result batch holds at most, a row more.
BATCH = 8 << 20


def _mapped(df: DataFrame, keep: tuple[str, ...], column: str, results: str, make) -> DataFrame:
    """The columns of keep and what make gives for a column's value, in batches of bounded size."""
    kept = [df.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [results])
    arrow = [to_arrow_type(f.dataType) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, made, held = 0, [], 0
            for i in range(batch.num_rows):
                row = make(batch.column(len(kept))[i].as_py())
                made.append(row)
                held += sum(len(v) for v in row if isinstance(v, (str, bytes)))
                if held > BATCH or i == batch.num_rows - 1:
                    columns = [c.cast(t) for c, t in zip(batch.slice(start, i + 1 - start).columns[: len(kept)], arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, zip(*made, strict=True))], names=[*keep, *(r.split()[0] for r in results.split(", "))])
                    start, made, held = i + 1, [], 0

    return df.select(*keep, F.col(column).alias("__given")).mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = TOKENIZER_PATH, special: bool = True) -> DataFrame:
    """A row per input row: the columns of keep, n_tokens and ids (binary: little-endian unsigned 32-bit integers)."""

    def make(said: str | None) -> tuple[int, bytes]:
        ids = codec(path).encode(said or "", special)
        return len(ids) // 4, ids

    return _mapped(df, keep, text, "n_tokens bigint, ids binary", make)


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str = TOKENIZER_PATH) -> DataFrame:
    """A row per input row: the columns of keep and text, decoded from ids as encode() gives them; null ids are none."""
    return _mapped(df, keep, ids, "text string", lambda raw: (codec(path).decode(raw or b""),))


def digests(df: DataFrame, text: str = "text", path: str = TOKENIZER_PATH) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of texts that were encoded, then decoded."""
    encoded = encode(df, text, path=path).select("doc_id", F.struct("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256")).alias("__row"), "ids")
    decoded = decode(encoded, keep=("__row",), path=path)
    return decoded.select("__row.*", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
