r"""Media columns: progressive JPEG files in, full-resolution RGB tensors out.

load() reads a binary column of progressive JPEG files: spectral-selection and successive-approximation
scans are accumulated into coefficient arrays, the inverse transform is a matrix product, chroma is
upsampled, and the RGB tensor is stored as height * width * 3 bytes.

store() makes such files from texts without loss: a text's UTF-8 bytes, filled with bytes 32 to a
positive multiple of 192, are the quantised coefficients (less BIAS) of a 4:2:0 image, the format's
own unit; pixels would not survive the transform.  A comment segment holds the unfilled length.

Defined results: null and empty text give one image of 192 fill bytes; equal texts give equal files;
a null file gives nulls; a file that isn't progressive JPEG raises; texts are stored whole (an image
is 16 pixels wide up to 1.5 MB, then wider); a null doc_id is returned as it is; an empty table
gives an empty table; further columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .common import map_rows

UNIT, BIAS, FILL = 192, 96, b" "
#: Payload bytes that are encoded or decoded at a time.
CHUNK = 400_000


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + FILL * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def store_texts(texts: list[str | None]) -> list[bytes]:
    """A file for each text."""
    coefs, notes = [], []
    for text in texts:
        data = payload_of(text)
        across, down = jpeg.frame_size(-(-len(data) // 384))
        rows = np.zeros(across * down * 384, np.int64)
        rows[: len(data)] = np.frombuffer(data, np.uint8).astype(np.int64) - BIAS
        coefs.append(rows.reshape(-1, 64))
        notes.append(b"bytes=%d" % len((text or "").encode()))
    return jpeg.encode(coefs, notes)


def payload_from(frame: jpeg.Frame, coefs: np.ndarray) -> tuple[int, bytes]:
    """(unfilled length, payload) of a stored text's file."""
    n = int(frame.comment.partition(b"=")[2])
    size = max(UNIT, -(-n // UNIT) * UNIT)
    return n, (coefs.reshape(-1)[:size] + BIAS).astype(np.uint8).tobytes()


def feature(rgb: np.ndarray) -> str:
    """Size, channel sums and the sum of absolute vertical green steps: whole numbers only."""
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    green = rgb[..., 1].astype(np.int64)
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{sums[0]}:{sums[1]}:{sums[2]}:{np.abs(np.diff(green, axis=0)).sum()}"


def _chunks(items: list, size_of) -> Iterator[list]:
    chunk, held = [], 0
    for item in items:
        chunk.append(item)
        held += size_of(item)
        if held >= CHUNK:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def store(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per input row: doc_id, media."""

    def rows(batch: list[dict]) -> list[dict]:
        out = []
        for part in _chunks(batch, lambda r: len(r[text] or "")):
            out += [{"doc_id": r[doc_id], "media": m} for r, m in zip(part, store_texts([r[text] for r in part]), strict=True)]
        return out

    return map_rows(df.select(doc_id, text), rows, "doc_id bigint, media binary", 64)


def load(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per input row: the columns of keep, width, height, rgb."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", width int, height int, rgb binary"

    def rows(batch: list[dict]) -> list[dict]:
        out = []
        for part in _chunks(batch, lambda r: len(r[media] or b"")):
            files = [r[media] for r in part if r[media] is not None]
            read = iter(jpeg.decode(files) if files else [])
            for r in part:
                own = {c: r[c] for c in keep} | {"width": None, "height": None, "rgb": None}
                if r[media] is not None:
                    rgb = jpeg.pixels(*next(read))
                    own |= {"width": rgb.shape[1], "height": rgb.shape[0], "rgb": rgb.tobytes()}
                out.append(own)
        return out

    return map_rows(df.select(*dict.fromkeys((*keep, media))), rows, schema, 64)


_DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def round_trip_digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text, reads the stored bytes back and describes both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _DIGEST.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = []
                pairs = list(zip(batch.column(0).slice(at, 128).to_pylist(), batch.column(1).slice(at, 128).to_pylist(), strict=True))
                for part in _chunks(pairs, lambda p: len(p[1] or "")):
                    files = store_texts([t for _, t in part])
                    for (d, _), file, (frame, coefs) in zip(part, files, jpeg.decode(files), strict=True):
                        n, payload = payload_from(frame, coefs)
                        rows.append((d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature(jpeg.pixels(frame, coefs))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    return df.select(doc_id, text).mapInArrow(run, _DIGEST)
