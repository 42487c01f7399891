r"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted; a sequence costs its length, a fixed overhead and a part that
grows with its square (attention), so long ones cost more a token and short ones pay the overhead
more often.  Documents are cut into parts of at most the longest length.  Within a shard, parts are
taken by falling length: a part goes into the open bin that it leaves with the least room; if none
has room, the bin size opens whose cost a token is least, with what its remaining room can be filled
with counted in: that follows from the lengths of all parts still to place (and from the room of open
bins, which they fill first).  At the end each bin is downsized to the least permitted length that
holds its contents.

Shards are stretches of a place in [0, 1) that every copy of a row has, by a hash or by ``place`` (the
order of a mix), and have about ``shard_docs`` rows whatever the table's size.  Rows that are equal
are numbered copies: copy n is placed by n, and only copies of equal n modulo EPOCHS share shards, so a
sequence doesn't hold a document twice unless it has more copies than that.  Shards are numbered in
order of (copy, place).  A row's result depends on its shard's rows only.

Defined results: null or empty text (0 tokens) is packed nowhere and returned with bin null;
a document longer than the longest length is cut into parts in order; equal lengths are taken by
doc_id (nulls first), then copy, then part; repeated rows are packed separately; an empty table gives an
empty table; further columns aren't looked at.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, n_words

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD, SPAN, SHARD_DOCS, EPOCHS, CHUNK = 32, 32768, 8192, 64, 4096


def cost(size: int, overhead: int = OVERHEAD, span: int = SPAN) -> float:
    """What a sequence of this length costs; a token at a distance of span costs as much again."""
    return size + overhead + size * size / span


class Parts:
    """The lengths still to place, falling, and what of them would fill a room."""

    def __init__(self, lengths: list[int]):
        self.negative = [-n for n in lengths]  # ascending, for bisect
        self.sums = [0, *accumulate(lengths)]

    def left(self, start: int) -> int:
        return self.sums[-1] - self.sums[start]

    def fill(self, room: int, start: int) -> int:
        """How much of the room the parts from start on fill, the longest that fits first."""
        filled, n = 0, len(self.negative)
        while room:
            start = bisect_left(self.negative, -room, start)
            if start == n:
                break
            # as many in a row as fit
            end = bisect_left(self.sums, self.sums[start] + room + 1, start) - 1
            got = self.sums[end] - self.sums[start]
            filled, room, start = filled + got, room - got, end
        return filled


def opening_size(length: int, parts: Parts, start: int, room: int, capacities: tuple[int, ...], overhead: int = OVERHEAD, span: int = SPAN) -> int:
    """The bin size of least cost a token for a part of this length; room: that of the open bins."""
    spare = max(0, parts.left(start) - room)

    def price(size: int) -> float:
        filled = length + min(parts.fill(size - length, start), spare)
        return cost(min(c for c in capacities if c >= filled), overhead, span) / filled

    return min((c for c in capacities if c >= length), key=lambda c: (price(c), c))


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, span: int = SPAN) -> tuple[list[tuple[int, int]], list[int]]:
    """lengths (falling) to (bin, start in it) for each, and each bin's capacity after downsizing."""
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    used: list[int] = []
    places = []
    parts, free = Parts(lengths), 0
    for i, length in enumerate(lengths):
        at = bisect_left(rooms, (length, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = opening_size(length, parts, i + 1, free, capacities, overhead, span), len(used)
            used.append(0)
            free += room
        places.append((b, used[b]))
        used[b] += length
        free -= length
        if room > length:
            insort(rooms, (room - length, b))
    return places, [min(c for c in capacities if c >= u) for u in used]


_OUT = "shard bigint, bin bigint, capacity bigint, start bigint, doc_id bigint, copy bigint, part bigint, part_start bigint, n_tokens bigint"


def copies(counted: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row per copy (from 0) of counted rows (doc_id, n, h, c); of many copies, chunks are dealt out first."""
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = counted.where(F.col("c") <= chunk).withColumn("low", F.lit(0).cast("long"))
    many = counted.where(F.col("c") > chunk).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(chunk).cast("long")))).repartition(parts, "h", "low")
    high = F.least(F.col("low") + chunk, F.col("c")) - 1
    return few.unionByName(many).select("doc_id", "n", "h", F.explode(F.sequence("low", high)).alias("copy"))


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokens: Column | None = None, key: Column | None = None, place: Callable[[Column, Column], Column] | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, span: int = SPAN, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row per part of a document: its shard, bin, the bin's capacity and the part's place in it.

    bin counts within the shard; part_start is the part's first token in the document, n_tokens its length.
    place: of a copy's number and the row's key, where in [0, 1) it lies.
    """
    capacities = tuple(sorted(set(capacities)))
    longest = capacities[-1]
    tokens = n_words(F.col(text)) if tokens is None else tokens
    key = F.xxhash64(F.col(doc_id), F.col(text)) if key is None else key
    sized = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n"), key.alias("h"))
    unit = lambda h: F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))
    at = unit(F.xxhash64("copy", "h")) if place is None else place(F.col("copy").cast("int"), F.col("h"))
    with Shelf(df.sparkSession) as shelf:
        counted = shelf.put(sized.groupBy("doc_id", "n", "h").agg(F.count(F.lit(1)).alias("c")))  # tokens are counted once
        placed = shelf.keep(shelf.put(copies(counted).select("doc_id", "n", "copy", F.pmod("copy", F.lit(EPOCHS)).alias("e"), at.cast("double").alias("at"))))
    held = {r.e: r.c for r in placed.groupBy("e").agg(F.count(F.lit(1)).alias("c")).collect()}  # EPOCHS rows at most
    first, shards = [], 0
    for e in range(EPOCHS):
        first.append((shards, math.ceil(held.get(e, 0) / shard_docs)))
        shards += first[-1][1]
    get = lambda i: F.get(F.array(*[F.lit(f[i]) for f in first]), F.col("e").cast("int"))
    within = F.least(F.floor(F.col("at") * get(1)), get(1) - 1)
    keyed = placed.select((get(0) + within).cast("long").alias("shard"), "doc_id", "copy", "n")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(max(1, min(parts, shards)), "shard").sortWithinPartitions("shard")

    def packed(shard: int, docs: list[tuple[int | None, int, int]]) -> pa.RecordBatch:
        pieces, rows = [], []
        for d, copy, n in docs:
            if not n:
                rows.append((shard, None, None, None, d, copy, 0, 0, 0))
            pieces += [(min(longest, n - at), d, copy, at // longest, at) for at in range(0, n, longest)]
        pieces.sort(key=lambda p: (-p[0], p[1] is not None, p[1] or 0, p[2], p[3]))
        places, sizes = best_fit([p[0] for p in pieces], capacities, overhead, span)
        rows += [(shard, b, sizes[b], start, d, copy, part, at, n) for (b, start), (n, d, copy, part, at) in zip(places, pieces, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in _OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs = None, []
        for batch in batches:
            for shard, d, copy, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if docs and shard != now:
                    yield packed(now, docs)
                    docs = []
                now = shard
                docs.append((d, copy, n))
        if docs:
            yield packed(now, docs)

    return dealt.mapInArrow(run, _OUT)
