"""Exports: JSON, HTML, PDF, ZIP and files of parts."""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import format_size, html_escape


def json_documents(metadata: DataFrame, pages: DataFrame, tags: DataFrame) -> DataFrame:
    """file_id and a JSON document: metadata, its tags, and the pages with their text.

    metadata: a row a file; pages: file_id, page_pos, text; tags: file_id, key, value, seq.
    """
    paged = pages.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_pos", "text"))), lambda p: F.struct(p["page_pos"].alias("pageNumber"), p["text"].alias("text"))).alias("pages"))
    tagged = tags.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "key", "value"))), lambda t: F.struct(t["key"].alias("key"), t["value"].alias("value"))).alias("tags"))
    rows = metadata.join(paged, "file_id", "left").join(tagged, "file_id", "left")
    document = F.struct(*[F.col(c) for c in metadata.columns], format_size(F.col("file_size")).alias("size"))
    return rows.select("file_id", F.to_json(F.struct(document.alias("document"), F.struct("tags").alias("metadata"), "pages")).alias("json"))


_STYLE = "body{font-family:sans-serif}pre{white-space:pre-wrap}section{border:1px solid #ccc;margin:1em;padding:1em}"


def html_documents(pages: DataFrame, title: str = "file_id") -> DataFrame:
    """file_id and an HTML document with a section for each page."""
    section = F.concat(F.lit('<section id="page-'), F.col("page_pos").cast("string"), F.lit('"><h2>Page '), F.col("page_pos").cast("string"), F.lit("</h2><pre>"), html_escape(F.col("text")), F.lit("</pre></section>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_pos", section.alias("s")))), lambda x: x["s"]), "\n")
    head = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), html_escape(F.first(title)), F.lit(f"</title><style>{_STYLE}</style></head><body>\n"))
    return pages.groupBy("file_id").agg(F.concat(head, body, F.lit("\n</body></html>")).alias("html"))


def pdf(pages: list[tuple[float, float, bytes | None, tuple[int, int]]]) -> bytes:
    """A PDF of pages (width and height in points, RGB pixels or None, their size)."""
    objects: list[bytes] = [b"", b""]
    kids = []
    for width, height, rgb, (w, h) in pages:
        content = b""
        resources = b"<< >>"
        if rgb is not None:
            packed = zlib.compress(rgb)
            objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n" % (w, h, len(packed)) + packed + b"\nendstream")
            resources = b"<< /XObject << /Im0 %d 0 R >> >>" % len(objects)
            content = b"q %.2f 0 0 %.2f 0 0 cm /Im0 Do Q" % (width, height)
        objects.append(b"<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Resources %s /Contents %d 0 R >>" % (width, height, resources, len(objects)))
        kids.append(b"%d 0 R" % len(objects))
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at)
    return bytes(out)


def pdf_pages(pages: DataFrame) -> DataFrame:
    """file_id, page_pos and a one-page PDF; pages: file_id, page_pos, width_pt, height_pt, rgb, px, py (rgb can be null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["file_id"], r["page_pos"], pdf([(r["width_pt"], r["height_pt"], r["rgb"], (r["px"] or 0, r["py"] or 0))])) for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["file_id", "page_pos", "pdf"])

    return pages.select("file_id", F.col("page_pos").cast("long").alias("page_pos"), F.col("width_pt").cast("double").alias("width_pt"), F.col("height_pt").cast("double").alias("height_pt"), "rgb", "px", "py").mapInArrow(run, "file_id string, page_pos bigint, pdf binary")


class _Archive:
    """A ZIP (stored) that grows part by part and ends with a manifest of names and sizes."""

    def __init__(self):
        self.buffer = io.BytesIO()
        self.zip = zipfile.ZipFile(self.buffer, "w", zipfile.ZIP_STORED)
        self.listing: list[str] = []

    def add(self, name: str, content: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
        self.listing.append(f"{name}\t{len(content)}\n")

    def close(self) -> bytes:
        self.zip.writestr(zipfile.ZipInfo("_manifest.txt", (1980, 1, 1, 0, 0, 0)), "".join(self.listing))
        self.zip.close()
        return self.buffer.getvalue()


def zip_parts(parts: DataFrame) -> DataFrame:
    """file_id and zip of parts(file_id, part, name, content), in order of part.

    A file's parts come sorted and go into its archive one by one: a task holds an archive and a batch.
    """
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = parts.select("file_id", "part", "name", "content").repartition(n, "file_id").sortWithinPartitions("file_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, archive = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([archive.close()], pa.binary())], names=["file_id", "zip"])

        for batch in batches:
            for file, name, content in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if archive is None or file != now:
                    if archive is not None:
                        yield done()
                    now, archive = file, _Archive()
                archive.add(name, content.as_py())
        if archive is not None:
            yield done()

    return ordered.mapInArrow(run, "file_id string, zip binary")


def zip_entries(zips: DataFrame) -> DataFrame:
    """file_id, entry (from 0), name, n_bytes and sha256 of what is in each archive of zip_parts()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw.as_buffer())) as held:
                    rows = []
                    for i, name in enumerate(held.namelist()):
                        data = held.read(name)
                        rows.append((file, i, name, len(data), hashlib.sha256(data).hexdigest()))
                columns = zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["file_id", "entry", "name", "n_bytes", "sha256"])

    return zips.select("file_id", "zip").mapInArrow(run, "file_id string, entry bigint, name string, n_bytes bigint, sha256 string")


def write_files(parts: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes every part as a file of the folder (a path or a store's address) from the executors; name, n_bytes.

    Separators in a name are written as %2F, so names stay apart.
    """
    import re
    import uuid

    import pyarrow.fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder) if re.match(r"[a-z0-9]+:/", folder) else (pyarrow.fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                safe = re.sub(r"[/\\\0%]", lambda m: f"%{ord(m[0]):02X}", n)
                passing = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(passing) as f:
                    f.write(c)
                system.move(passing, f"{root}/{safe}")  # a task that runs twice leaves one whole file
                done.append((safe, len(c)))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["name", "n_bytes"])

    return parts.select(name, content).mapInArrow(run, "name string, n_bytes bigint")
