r"""Phrase collocations from word-id suffix arrays.

A task reads its documents into shards: the words of each language as ids in one row of numbers, pieces of text
apart from each other.  Of a shard a suffix array is built by prefix doubling (to the depth that the longest phrase
asks for); the common prefixes of neighbours make intervals, and an interval at depth d is a phrase of d words with
its count.  Counts of all shards are merged by language and phrase.

Phrases are counted size by size.  A phrase that is frequent has frequent parts only, so from two words on a shard's
positions are first narrowed to those whose parts may be frequent.  That is told by a bitmap of fixed size that
is made of the frequent phrases one word shorter: it errs on one side only, so it saves rows but loses none.  What is left is
counted by 40 bits of its hash, packed four bytes a phrase and part of a task's shards, and a second map tells which hashes
have enough occurrences: a sum over all phrases of a hash is never less than one's own.  Whatever passes is counted exactly, from
the suffix arrays; only such phrases are dealt out as text.

Score: a frequent phrase of a occurrences is cut in two; with l and r occurrences of the parts its score is
2000000 * a div (l + r), by the cut with the lowest score, the first of these.  Phrases that lie in a longer frequent one
with nearly as many occurrences are dropped.  Counts and products are exact (decimals of 38 digits).

Words are `[^\x20\x09]+` of pieces between `[.,;:!?\x0A-\x0D]`, with A-Z lower-cased.

Defined results: null text is empty; a null language is ``und``, together with that language's texts; a text is taken whole, however
long (a shard ends where it is full, and the words whose phrases are cut there open the next one); repeated rows
count as often as they are there; ties of score go by count, then by the phrase's bytes; an empty table gives an empty
table; further columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, batches_of

#: Words that a shard holds, and bytes of text that are split in one go.
SHARD_WORDS, STRETCH = 1 << 19, 1 << 20
#: Bits of the map of phrases that may be frequent; its size doesn't depend on the data.
MAP_BITS = 1 << 26
#: Bits of a phrase's hash that are counted; the first ones tell the part that counts it, so a part's share falls with their number.
KEY_BITS, PART_BITS = 40, 11
#: Phrases whose hashes a task holds before it hands them on.
HELD_KEYS = 1 << 21

SHARDS = "lang string, sign int, words array<string>, counts array<bigint>, hashes binary, ids binary"
COUNTS = "lang string, phrase string, n bigint"

_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Lower case, line feeds for the ends of pieces, blanks for tabs.
_TABLE = bytes(10 if i in _ENDS else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))


def stretches(text: str) -> Iterator[bytes]:
    """A text's bytes, mapped, in stretches that end at a blank or a piece's end."""
    data = text.encode().translate(_TABLE)
    at = 0
    while at < len(data):
        end = at + STRETCH
        if end < len(data):
            places = [p for p in (data.find(b" ", end), data.find(b"\n", end)) if p >= 0]
            end = min(places) + 1 if places else len(data)
        yield data[at:end]
        at = end


class Shard:
    """Words of one language as ids from 1 on; 0 ends a piece."""

    def __init__(self, lang: str, words: Sequence[bytes] = ()):
        self.lang, self.numbers = lang, {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
        self.ids = [self.numbers[w] for w in words]

    def take(self, data: bytes) -> int:
        """Goes on with a stretch; how many ids were added."""
        ids, number, before = self.ids, self.numbers, len(self.ids)
        for i, piece in enumerate(data.split(b"\n")):
            if i:
                self.close()
            ids += [number.setdefault(w, len(number) + 1) for w in piece.split()]
        return len(ids) - before

    def close(self) -> None:
        """Ends the piece."""
        if self.ids and self.ids[-1]:
            self.ids.append(0)

    def tail(self, most: int) -> list[bytes]:
        """The last words, at most so many, of a piece that hasn't ended."""
        last = self.ids[max(len(self.ids) - most, 0) :]
        last = last[max((i + 1 for i, x in enumerate(last) if x == 0), default=0) :]
        words = list(self.numbers)
        return [words[i - 1] for i in last]

    def batch(self, sign: int = 1) -> pa.RecordBatch:
        self.close()
        ids, words = np.array(self.ids, "<i4"), list(self.numbers)
        seed = self.lang.encode() + b"\0"
        hashes = np.array([xxhash.xxh64_intdigest(seed + w) for w in words], "<u8")
        counts = np.bincount(ids, minlength=len(words) + 1)[1:] * sign
        listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), values)
        columns = [pa.array([self.lang]), pa.array([sign], pa.int32()), listed(pa.array(words, pa.binary()).cast(pa.string())), listed(pa.array(counts, pa.int64())), pa.array([hashes.tobytes()]), pa.array([ids.tobytes()])]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SHARDS.split(", ")])


def shards(df: DataFrame, text: str, lang: str, longest: int, most: int = SHARD_WORDS) -> DataFrame:
    """A task's documents as shards, a row a language whenever they hold most words together.

    Where a shard ends inside a piece, the next one begins with the piece's last words, as many as a phrase can need;
    what the two have in common is a shard of its own with the sign -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for said, spoken in zip(batch.column(0), batch.column(1), strict=True):
                spoken = "und" if spoken.as_py() is None else spoken.as_py()
                for data in stretches(said.as_py() or ""):
                    size += held.setdefault(spoken, Shard(spoken)).take(data)
                    if size >= most:
                        common = held[spoken].tail(longest - 1)
                        yield from (s.batch() for s in held.values())
                        if common:
                            yield Shard(spoken, common).batch(-1)
                        held, size = {spoken: Shard(spoken, common)}, 0
                if spoken in held:
                    held[spoken].close()
        yield from (s.batch() for s in held.values() if s.ids)

    return df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(run, SHARDS)


# ---- suffix arrays


def _ordered(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places in the order of (high, low); where the three numbers fit 63 bits, they are sorted as one."""
    n = len(high)
    bits = [int(max(x, 1)).bit_length() for x in (high.max(initial=0), low.max(initial=0), n)]
    if sum(bits) > 63:
        return np.lexsort((low, high))
    key = (high << bits[1] | low) << bits[2] | np.arange(n)
    key.sort()
    return key & ((1 << bits[2]) - 1)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ids in the order of their suffixes' first depth ids or more, by prefix doubling."""
    rank, done = ids.astype(np.int64), 1
    while True:
        behind = np.zeros_like(rank)
        behind[:-done] = rank[done:]
        order = _ordered(rank, behind)
        done *= 2
        if done >= depth:
            return order
        a, b = rank[order], behind[order]
        fresh = np.empty_like(rank)
        fresh[order] = np.concatenate([[1], 1 + np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = fresh  # 0 stays what is behind the end


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For every place in the order how many ids its suffix shares with the one before, depth at most; none beyond a 0."""
    out = np.zeros(len(order), np.int8)
    if len(order) < 2:
        return out
    same = np.ones(len(order) - 1, bool)
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    for d in range(depth):
        a = padded[order + d]
        same &= (a[1:] == a[:-1]) & (a[1:] != 0)
        out[1:][same] = d + 1
    return out


def lengths(ids: np.ndarray, depth: int) -> np.ndarray:
    """How many ids stand from each place to its piece's end, depth at most."""
    out = np.zeros(len(ids), np.int8)
    inside = np.ones(len(ids), bool)
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    for d in range(depth):
        inside &= padded[d : d + len(ids)] != 0
        out[inside] = d + 1
    return out


def intervals(ids: np.ndarray, order: np.ndarray, shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A place and the number of places of every distinct run of depth ids: maximal stretches of the order that share so much."""
    whole = lengths(ids, depth)[order] >= depth
    begins = np.flatnonzero(whole & (shared < depth))
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # suffixes that share depth ids stand behind each other, and all of them are whole
    run = np.cumsum(whole & (shared < depth)) - 1
    return order[begins], np.bincount(run[whole], minlength=len(begins))


# ---- the map of phrases that may be frequent


def _chained(parts: list[np.ndarray]) -> np.ndarray:
    """A phrase's hash from its words' hashes."""
    out = parts[0]
    for p in parts[1:]:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + p
    return out


def _mixed(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(hashes) % np.uint64(bits)).astype(np.int64)


def _in(place: np.ndarray, known: np.ndarray) -> np.ndarray:
    return ((known[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _set(seen: np.ndarray, place: np.ndarray) -> None:
    np.bitwise_or.at(seen, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))




def possible(frequent: DataFrame, size: int, bits: int = MAP_BITS) -> np.ndarray:
    """A map with the bit of every frequent phrase (lang, phrase of size words) set, as 64-bit integers.

    Bits are merged by their place before they come to the driver: at most bits / 64 numbers, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            words = pc.list_flatten(pc.split_pattern(batch.column(1), " "))
            langs = pc.take(batch.column(0), pa.array(np.repeat(np.arange(batch.num_rows), size)))
            pairs = pc.binary_join_element_wise(langs, words, "\0").dictionary_encode()
            hashed = np.array([xxhash.xxh64_intdigest(p.encode()) for p in pairs.dictionary.to_pylist()], np.uint64)
            each = hashed[pairs.indices.to_numpy(zero_copy_only=False)].reshape(-1, size)
            _set(seen, _bit(_chained([each[:, d] for d in range(size)]), bits))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at].view(np.int64))], names=["at", "bits"])

    merged = frequent.select("lang", "phrase").mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[merged["at"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
    return out


def _runs(ids: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the size ids from each place on; it means something where no piece ends within."""
    of_word = np.concatenate([np.zeros(1, np.uint64), hashes])
    padded = np.concatenate([ids, np.zeros(size, ids.dtype)])
    return _chained([of_word[padded[d : d + len(ids)]] for d in range(size)])


def likely(ids: np.ndarray, hashes: np.ndarray, size: int, known: np.ndarray) -> np.ndarray:
    """Whether a run of size words begins at each place whose parts, one word shorter, are all in the map."""
    whole = lengths(ids, size)
    part = (whole >= size - 1) & _in(_bit(_runs(ids, hashes, size - 1), len(known) * 64), known)
    return (whole >= size) & part & np.concatenate([part[1:], [False]])


def _keys(hashes: np.ndarray) -> np.ndarray:
    return _mixed(hashes) >> np.uint64(64 - KEY_BITS)


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a key; it rises with the key, so that each part has a stretch of the map."""
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Keys, ascending, with their counts by parts: how many occur once, these, the others and their counts."""
    rest = (keys & np.uint64((1 << KEY_BITS - PART_BITS) - 1)).astype("<u4")
    ends = np.searchsorted(keys >> np.uint64(KEY_BITS - PART_BITS), np.arange((1 << PART_BITS) + 1, dtype=np.uint64))
    for part in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
        some, times = rest[ends[part] : ends[part + 1]], n[ends[part] : ends[part + 1]]
        once = times == 1
        yield part, b"".join([np.array([once.sum()], "<u4").tobytes(), some[once].tobytes(), some[~once].tobytes(), times[~once].astype("<i8").tobytes()])


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    once = int(np.frombuffer(blob, "<u4", 1)[0])
    more = (len(blob) - 4 - 4 * once) // 12
    return np.frombuffer(blob, "<u4", once + more, 4), np.concatenate([np.ones(once, np.int64), np.frombuffer(blob, "<i8", more, 4 + 4 * (once + more))])


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def enough(held: DataFrame, size: int, known, least: int, bits: int = MAP_BITS) -> np.ndarray:
    """A map of the keys of size words that occur least times or more in all shards; known: the broadcast map of their parts.

    A part's stretch of the map comes to the driver: bits / 8 bytes and a few a part, whatever the input.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed() -> pa.RecordBatch:
            rows = list(packed(*summed(np.concatenate(keys), np.concatenate(counts))))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["part", "keys"])

        keys, counts, n = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                ids, hashes = np.frombuffer(batch.column(2)[i].as_buffer(), "<i4"), np.frombuffer(batch.column(1)[i].as_buffer(), "<u8")
                some, times = np.unique(_keys(_runs(ids, hashes, size)[likely(ids, hashes, size, known.value)]), return_counts=True)
                keys.append(some)
                counts.append(times * batch.column(0)[i].as_py())
                n += len(some)
                if n >= HELD_KEYS:
                    yield handed()
                    keys, counts, n = [], [], 0
        if n:
            yield handed()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blobs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [unpacked(b.as_buffer()) for b in blobs.values]
                rest, n = summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))
                place = _place(np.uint64(part << KEY_BITS - PART_BITS) | rest[n >= least].astype(np.uint64), bits)
                if len(place):
                    first = int(place[0]) >> 6
                    seen = np.zeros((int(place[-1]) >> 6) - first + 1, np.uint64)
                    _set(seen, place - (first << 6))
                    yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([seen.astype("<u8").tobytes()], pa.binary())], names=["at", "bits"])

    parts = held.select("sign", "hashes", "ids").mapInArrow(keyed, "part int, keys binary").groupBy("part").agg(F.collect_list("keys").alias("keys"))
    out = np.zeros(bits // 64, np.uint64)
    for first, stretch in zip(*parts.mapInArrow(marked, "at bigint, bits binary").toArrow().to_pydict().values(), strict=True):
        words = np.frombuffer(stretch, "<u8")
        out[first : first + len(words)] |= words
    return out


def narrowed(ids: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """ids without the places that none of the runs of size words that begin there covers."""
    n = len(ids)
    covered = np.zeros(n + size, bool)
    for d in range(size):
        covered[d : d + n] |= begins
    covered = covered[:n]
    # a gap becomes one 0, so that runs on its two sides stay apart
    opens = covered & ~np.concatenate([[False], covered[:-1]])
    kept = ids[covered]
    return np.insert(kept, np.cumsum(covered)[opens] - 1, 0) if len(kept) else kept


def counted(held: DataFrame, size: int, known) -> DataFrame:
    """lang, phrase and n of the phrases of size words in all shards whose keys occur often enough; known: the broadcast map of enough().

    The others' occurrences may lack here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, hashes = np.frombuffer(batch.column(4)[i].as_buffer(), "<i4"), np.frombuffer(batch.column(3)[i].as_buffer(), "<u8")
                often = lambda ids, hashes=hashes: _in(_place(_keys(_runs(ids, hashes, size)), len(known.value) * 64), known.value)
                ids = narrowed(ids, (lengths(ids, size) >= size) & often(ids), size)
                if not len(ids):
                    continue
                order = suffix_array(ids, size)
                place, n = intervals(ids, order, common_prefixes(ids, order, size), size)
                kept = often(ids)[place]
                place, n = place[kept], n[kept] * batch.column(1)[i].as_py()
                words = batch.column(2)[i].values
                for at in range(0, len(place), 1 << 17):
                    some = place[at : at + (1 << 17)]
                    said = pc.binary_join_element_wise(*[words.take(pa.array(ids[some + d] - 1)) for d in range(size)], " ")
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(some)), said, pa.array(n[at : at + len(some)], pa.int64())], names=["lang", "phrase", "n"])

    # frequent phrases come again from shard to shard: a task's are combined before they are dealt
    return held.select("lang", "sign", "words", "hashes", "ids").mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(df: DataFrame, shelf: Shelf, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, shard_words: int = SHARD_WORDS, bits: int = MAP_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang and n, its words in all; a table of lang, phrase and n for each size of phrases with least occurrences or more)."""
    spark = df.sparkSession
    with batches_of(spark, 1000):
        held = shelf.put(shards(df, text, lang, longest, shard_words))
    single = held.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("n"))
    totals = held.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    totals, found = shelf.put(totals), [shelf.put(single.where(F.col("n") >= least))]
    for size in range(2, longest + 1):
        known = spark.sparkContext.broadcast(possible(found[-1], size - 1, bits))
        with batches_of(spark, 1):  # a shard is a row
            often = spark.sparkContext.broadcast(enough(held, size, known, least, bits))
            known.destroy()
            found.append(shelf.put(counted(held, size, often).where(F.col("n") >= least)))
        often.destroy()
    shelf.drop(held)
    return totals, found


def _exact(name: str) -> str:
    return f"CAST({name} AS DECIMAL(20,0))"


def scored(found: list[DataFrame]) -> DataFrame:
    """lang, phrase, size, a, l, r and score of the phrases of two words or more, by the cut with the lowest score."""
    words = F.split("phrase", " ")
    every = found[0].select("lang", "phrase", "n", F.lit(1).alias("size"))
    for size, table in enumerate(found[1:], 2):
        every = every.unionByName(table.select("lang", "phrase", "n", F.lit(size).alias("size")))
    cuts = every.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    part = every.where(F.col("size") < len(found)).select("lang", "phrase", "n")
    cuts = cuts.join(part.withColumnsRenamed({"phrase": "first", "n": "l"}), ["lang", "first"]).join(part.withColumnsRenamed({"phrase": "rest", "n": "r"}), ["lang", "rest"])
    score = F.expr(f"({_exact('a')} * 2000000) DIV ({_exact('l')} + {_exact('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "size", "a", "b.l", "b.r", "b.score")


def enclosed(found: list[DataFrame]) -> DataFrame:
    """lang, phrase and most: of the phrases of two words or more inside longer ones, the longer ones' largest count."""
    w, inside = F.split("phrase", " "), None
    for size in range(3, len(found) + 1):
        spans = [(i, short) for short in range(2, size) for i in range(1, size - short + 2)]
        parts = F.array(*[F.array_join(F.slice(w, i, short), " ") for i, short in spans])
        some = found[size - 1].select("lang", F.explode(parts).alias("phrase"), F.col("n").alias("most"))
        inside = some if inside is None else inside.unionByName(some)
    return inside.groupBy("lang", "phrase").agg(F.max("most").alias("most"))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, cover: int = 80, most: int = 2000, shard_words: int = SHARD_WORDS, bits: int = MAP_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first phrases of every language.

    longest: words of the longest phrases (two at least); least: occurrences of a candidate; cover: a candidate is dropped if a longer
    one has this many in a hundred of its occurrences; most: rows a language.
    """
    if longest < 2:
        raise ValueError("a collocation has two words or more")
    with Shelf(df.sparkSession) as shelf:
        totals, found = frequent_phrases(df, shelf, text, lang, longest, least, shard_words, bits)
        rows = scored(found)
        if longest > 2:
            rows = rows.join(enclosed(found), ["lang", "phrase"], "left").where(f"most IS NULL OR {_exact('most')} * 100 < {_exact('a')} * {cover:d}")
        by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).join(totals, "lang")
        return shelf.keep(shelf.put(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")))
