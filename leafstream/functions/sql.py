"""The engine's decoders as SQL functions: register(spark), then SELECT ... FROM afp_fields(content)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import ArrayType, pandas_udf, udtf  # noqa: F401
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..operators import codepages, graphics, images, ptoca, tags
from ..sources import framing

_FIELD = StructType([StructField("sf_no", LongType()), StructField("offset", LongType()), StructField("length", IntegerType()), StructField("type_id", StringType()), StructField("data", BinaryType())])
_TRIPLET = StructType([StructField("id", IntegerType()), StructField("body", BinaryType())])
_FONT = StructType([StructField("local_id", IntegerType()), StructField("coded_font", BinaryType()), StructField("char_set", BinaryType())])
_ENTRY = StructType([StructField("byte", IntegerType()), StructField("code_point", IntegerType())])


class Fields:
    """Table function: the structured fields of a file's content."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        data = bytes(content or b"")
        for i, (at, length, _) in enumerate(framing.walk(data)):
            yield i, at, length, data[at + 3 : at + 6].hex().upper(), data[at + framing.HEADER : at + 1 + length]


class Triplets:
    """Table function: the self-sized triplets of a field's data."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        yield from tags.split_triplets(bytes(data or b""))


class Fonts:
    """Table function: the groups of a coded-font map."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        yield from tags.font_groups(bytes(data or b""))


class Entries:
    """Table function: the mappings of a code page's index."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        yield from codepages.index_entries(bytes(data or b""))


def _each(function, kind: str):
    """A function of one binary column, over Arrow batches."""

    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else function(bytes(b)))

    return pandas_udf(run, kind)


def _image(data: bytes) -> bytes | None:
    found = images.raster([data])
    return None if found is None else images.png(images.fit(images.shown(found)))


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, kind, schema in (("afp_fields", Fields, _FIELD), ("afp_triplets", Triplets, _TRIPLET), ("afp_mcf", Fonts, _FONT), ("afp_cpi", Entries, _ENTRY)):
        spark.udtf.register(name, udtf(kind, returnType=schema))
    spark.udf.register("ptoca_runs", _each(ptoca.interpret, f"array<{ptoca.RUN}>"))
    spark.udf.register("goca_orders", _each(lambda b: [{"type": k, "params": list(p)} for k, p in graphics.parse(b)], graphics.ORDER))
    spark.udf.register("goca_display", _each(lambda b: graphics.display(graphics.parse(b)), graphics.OP))
    spark.udf.register("im_image", _each(_image, "binary"))
