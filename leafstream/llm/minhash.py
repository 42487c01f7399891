r"""Near-duplicates by bottom-k sketches of one hash function.

A document's set is that of its distinct 5-word shingles (words ``[^\x20\x09-\x0D]+``, A-Z in lower
case; fewer words: the whole sequence as one), each hashed once to 64 bits; the k smallest hashes
are its sketch.  Documents with equal sets form a class; all that follows is between classes.

* Two sets of Jaccard similarity t share, of the k smallest hashes of their union, a binomial (k, t)
  number.  ``sketch_floor`` is what a sketch must share at least: the exact bound for sets that a
  sketch holds whole, else the mean less ``SPREAD`` standard deviations.
* A first sketch of K values of every class finds the classes of which floor values occur in another
  class.  Only these get a second sketch of WIDE values and go on.
* Inverted lists.  A class enters lists under its rarest retained values only, all but floor - 1 of
  them: passages common to many documents build no lists, and the rarest value that two similar
  sets share is a list of both.
* Overlaps.  Within a list every member is paired with the list's pivot, the member with the fewest
  values of its own (the likely original).  So a group of n copies costs n pairs, not n * n.
* The estimate on the union's sketch drops the pairs too far apart (``too_far``: a similarity below 1/2);
  all others are compared exactly, on the full sets, which also gives what a member has and its pivot lacks.

What a pivot p leaves open, with x and y for two members that it doesn't link both:

* Distances 1 - similarity obey the triangle inequality.  So a member that p links isn't similar to one
  that was too far from p for a comparison.
* If both were compared and are similar, they share a shingle that p lacks, or (of which x is linked)
  x is smaller than p, and at least 3/4 of what each unlinked one has lies in p.

So the open lists are: the members of a list that p doesn't link, where one is too far; the members of
a pivot that share a shingle which it lacks, where one isn't linked; the unlinked members that lie in p
for 3/4, with the smaller linked ones.  In each some members are due: to be paired with all others.

* Lists whose members are all in one component, or the same as another list's, are left out.
* In lists of up to SMALL members the due ones are joined with the others.
* In larger ones PIVOTS due members, picked by hash, are compared with all members as above.  That joins
  the groups in such a list, of any size; of what is left, a pair of members in two components whose
  distances to one of these pivots differ by more than 1/4 can't be similar.  The others are compared
  exactly, block against block, on the full sets; a pair of blocks gives a link for each two
  components that it joins, so less rows than members, however many pairs are similar or nearly so.
* The pairs of small lists are filtered by the union sketch's estimate and compared exactly.

Defined results: null or blank text: n_shingles 0, linked with nothing, its own component; null
doc_id: linked with nothing, component_id null, kept true; rows that share a doc_id are one node
of the link graph, whatever their texts (each row gets its result); ties of the pivot go to the
smallest class number; texts are taken whole; an empty table gives an empty table; further columns
aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, bind
from .components import connected_components

K, WIDE, WIDTH, PERCENT, SPREAD, SMALL, BLOCK, VALUES, PIVOTS = 64, 256, 5, 75, 5.0, 32, 1024, 2_000_000, 16
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending (int64)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    mixed = hashed[: len(words) - width + 1].copy()
    for i in range(1, width):
        mixed *= _PRIME
        mixed += hashed[i : len(words) - width + 1 + i]
    mixed += np.uint64(width)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed ^= mixed >> np.uint64(shift)
        mixed *= np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed.view(np.int64))


def sketch_floor(n: int, k: int = K, percent: int = PERCENT) -> int:
    """How many retained values a set of n has at least in common with any set similar enough."""
    whole = k * percent // 100
    if n <= whole:  # it and every set similar enough are retained whole
        return -(-n * percent // 100)
    t = percent / 100
    return max(1, int(k * t - SPREAD * (k * t * (1 - t)) ** 0.5))


def too_far(percent: int) -> int:
    """The similarity (percent) below which nothing is similar to both members of a pair."""
    return 2 * percent - 100


_SIGNED = "doc_id bigint, n bigint, h1 bigint, h2 bigint, sketch array<bigint>"


def signatures(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, n (set size), h1 and h2 (128-bit hash of the set, null if empty), sketch (ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            marks = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            half = lambda i: pa.array([m and int.from_bytes(m[i : i + 8], "little", signed=True) for m in marks], pa.int64())
            short = [s[:k] for s in sets]
            ends = np.cumsum([0, *map(len, short)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*short, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), half(0), half(8), lists], names=["doc_id", "n", "h1", "h2", "sketch"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _SIGNED)


def _floor_column(n: Column, k: int, percent: int) -> Column:
    whole = k * percent // 100
    return F.when(n <= whole, F.ceil(n * percent / 100)).otherwise(sketch_floor(whole + 1, k, percent)).cast("int")


def _shared(sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """cid, n, vs (its (df, v) that other sketches have too, rarest first): classes with floor of them."""
    entries = sketches.select("cid", "n", F.explode("sketch").alias("v"))
    often = entries.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = entries.join(often, "v").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    return shared.where(F.size("vs") >= _floor_column(F.col("n"), k, percent))


def inverted_lists(sketches: DataFrame, k: int = WIDE, percent: int = PERCENT) -> DataFrame:
    """v, cid, n, own (how many of its values no other class has): the members of each list."""
    shared = _shared(sketches, k, percent)
    prefix = F.slice("vs", 1, F.size("vs") - _floor_column(F.col("n"), k, percent) + 1)
    return shared.select("cid", "n", (F.least(F.col("n"), F.lit(k)) - F.size("vs")).cast("int").alias("own"), F.explode(prefix).alias("e")).select(F.col("e.v").alias("v"), "cid", "n", "own")


def _likely(pairs: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs(a, b) whose union sketch shares enough for a similarity of percent; of whole sets those that have it."""
    side = lambda x: sketches.select(F.col("cid").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    joined = joined.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    floor = sketch_floor(k, k, percent)
    # bound once a pair: lambdas would compute the arrays for every element again
    hits = lambda s: bind(F.get(s["u"], F.least(F.size(s["u"]), F.lit(k)) - 1), lambda kth: F.size(F.filter(s["i"], lambda x: x <= kth)))
    alike = lambda s: F.when(F.greatest("na", "nb") <= k, 100 * F.size(s["i"]) >= percent * F.size(s["u"])).otherwise(hits(s) >= floor)
    both = F.struct(F.array_intersect("sa", "sb").alias("i"), F.sort_array(F.array_union("sa", "sb")).alias("u"))
    return joined.where(bind(both, alike)).select("a", "b")


_TESTED = "a bigint, b bigint, both bigint, na bigint, nb bigint, plus array<bigint>"


def verified(pairs: DataFrame, near: DataFrame, width: int = WIDTH, crowd: int = 256) -> DataFrame:
    """pairs(a, b) with both (size of the intersection), na, nb and plus (what b has and a lacks), on the full sets.

    near: cid, sketch, text (null if the sketch is the whole set).  The b of an a are dealt out in
    shares of about crowd, each with a copy of a's set.
    """
    crowds = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("m"))
    members = pairs.join(crowds, "a").select(F.col("b").alias("cid"), "a", F.pmod(F.xxhash64("b"), F.col("m")).cast("int").alias("share"), F.lit(1).alias("kind"))
    heads = crowds.select(F.col("a").alias("cid"), "a", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("share"), F.lit(0).alias("kind"))
    dealt = near.select("cid", F.when(F.col("text").isNull(), F.col("sketch")).alias("whole"), "text").join(members.unionByName(heads), "cid").select("a", "share", "kind", "cid", "whole", "text")
    parts = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "a", "share").sortWithinPartitions("a", "share", "kind", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            out = []
            for a, share, kind, b, whole, text in zip(*batch.columns, strict=True):
                key = (a.as_py(), share.as_py())
                found = whole.values.to_numpy() if text.as_py() is None else shingle_set(text.as_py(), width)
                if kind.as_py() == 0:
                    head, own = key, found
                elif head == key:
                    plus = np.setdiff1d(found, own, assume_unique=True)
                    out.append((key[0], b.as_py(), len(found) - len(plus), len(own), len(found), plus))
            if out:
                cols = list(zip(*out, strict=True))
                ends = np.cumsum([0, *map(len, cols[5])], dtype=np.int32)
                plus = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cols[5])))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), plus], names=["a", "b", "both", "na", "nb", "plus"])

    return dealt.mapInArrow(run, _TESTED)


def wide_sketches(classes: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int = WIDTH, k: int = WIDE) -> DataFrame:
    """cid, n, sketch of k values, text (null if the sketch is the whole set) of the classes(cid, rep, h1, h2)."""
    wanted = classes.select(F.col("rep").alias("doc_id"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(wanted, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for d, t in zip(*batch.columns, strict=True):
                found = shingle_set(t.as_py(), width)
                mark = xxhash.xxh3_128_digest(found.tobytes())
                h1, h2 = (int.from_bytes(mark[i : i + 8], "little", signed=True) for i in (0, 8))
                rows.append((d.as_py(), h1, h2, len(found), found[:k], t.as_py() if len(found) > k else None))
            if rows:
                cols = list(zip(*rows, strict=True))
                ends = np.cumsum([0, *map(len, cols[4])], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cols[4])))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), lists, pa.array(cols[5], pa.string())], names=["rep", "h1", "h2", "n", "sketch", "text"])

    made = texts.mapInArrow(run, "rep bigint, h1 bigint, h2 bigint, n bigint, sketch array<bigint>, text string")
    # rows that share a doc_id can have other sets than the class's
    return made.join(classes.select("cid", "rep", "h1", "h2"), ["rep", "h1", "h2"]).dropDuplicates(["cid"]).select("cid", "n", "sketch", "text")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many values each of left shares with each of right (arrays of distinct values)."""
    out = np.zeros((len(left), len(right)), np.float32)
    one, two = np.concatenate(left), np.concatenate(right)
    rows, cols = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    values = np.intersect1d(one, two)
    for at in range(0, len(values), columns):
        some = values[at : at + columns]
        sides = []
        for n, of, v in ((len(left), rows, one), (len(right), cols, two)):
            place = np.minimum(np.searchsorted(some, v), len(some) - 1)
            hit = some[place] == v
            dense = np.zeros((n, len(some)), np.float32)
            dense[of[hit], place[hit]] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _apart(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of members the triangle inequality tells apart.

    left, right: a row a member, a column a pivot: the exact similarity, or nan if they are too far apart.
    """
    out = np.zeros((len(left), len(right)), bool)
    reach = 1 - percent / 100 + 1e-9
    for x, y in zip(left.T, right.T, strict=True):
        with np.errstate(invalid="ignore"):
            out |= np.abs(np.subtract.outer(x, y)) > reach
            out |= np.logical_and.outer(x >= percent / 100, np.isnan(y)) | np.logical_and.outer(np.isnan(x), y >= percent / 100)
    return out


def _block_links(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is similar among the members (cid, g, set, similarities) of two blocks: a spanning forest over the components g."""
    (ra, ga), (rb, gb) = (tuple(np.array(c, np.int64) for c in list(zip(*x, strict=True))[:2]) for x in (left, right))
    na, nb = (np.array([len(x[2]) for x in side], np.int64) for side in (left, right))
    fits = (100 * np.minimum.outer(na, nb) >= percent * np.maximum.outer(na, nb)) & np.not_equal.outer(ga, gb)
    if fits.any():
        fits &= ~_apart(np.array([x[3] for x in left]), np.array([x[3] for x in right]), percent)
    rows, cols = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
    if not len(rows):
        return []
    ra, ga, na, rb, gb, nb = ra[rows], ga[rows], na[rows], rb[cols], gb[cols], nb[cols]
    both = _overlaps([left[i][2] for i in rows], [right[j][2] for j in cols])
    linked = fits[np.ix_(rows, cols)] & (100 * both >= percent * (np.add.outer(na, nb) - both))
    found = []
    for i in np.flatnonzero(linked.any(axis=1)):
        near = np.flatnonzero(linked[i])
        marks, first = np.unique(gb[near], return_index=True)
        for mark, j in zip(marks, near[first], strict=True):
            if mark != ga[i]:
                found.append((int(ra[i]), int(rb[j])))
                ga[ga == mark], gb[gb == mark] = ga[i], ga[i]
    return found


def crowded(members: DataFrame, near: DataFrame, width: int = WIDTH, pivots: int = PIVOTS, percent: int = PERCENT, block: int = BLOCK, values: int = VALUES) -> DataFrame:
    """Links (a, b) that connect a due and any other member of a list where they are similar; members: v, cid, g, due, sims (slot, sim).

    A list's due members and all its members are dealt into blocks of about block members or values
    values; each block meets each in one group of rows, so no task holds more than two blocks.
    A pair of blocks makes less links than it has members, whatever the number of similar pairs.
    """
    sized = members.join(near.select("cid", "n"), "cid")
    n_blocks = lambda x: F.greatest(F.ceil(F.count_if(x) / block), F.ceil(F.sum(F.when(x, F.col("n"))) / values)).cast("int")
    counted = sized.groupBy("v").agg(n_blocks(F.col("due")).alias("ml"), n_blocks(F.lit(True)).alias("mr"))
    joined = members.join(counted, "v")
    place = lambda m: F.pmod(F.xxhash64("cid"), F.col(m)).cast("int")
    upto = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    lefts = joined.where("due").select("v", place("ml").alias("i"), upto("mr").alias("j"), F.lit(0).alias("side"), "cid", "g", "sims")
    rights = joined.select("v", upto("ml").alias("i"), place("mr").alias("j"), F.lit(1).alias("side"), "cid", "g", "sims")
    sets = near.select("cid", F.when(F.col("text").isNull(), F.col("sketch")).alias("whole"), "text")
    dealt = lefts.unionByName(rights).join(sets, "cid").select("v", "i", "j", "side", "cid", "g", "sims", "whole", "text")
    parts = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "v", "i", "j").sortWithinPartitions("v", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if sides[0] and sides[1] and (found := _block_links(*sides, percent)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            plain = [c.to_pylist() for c in batch.columns[:7]]
            for *at, side, cid, g, sims, whole, text in zip(*plain, *batch.columns[7:], strict=True):
                if at != key:
                    yield from done()
                    key, sides = at, ([], [])
                known = np.full(pivots, np.nan)
                for s in sims or ():
                    known[s["slot"]] = s["sim"]
                found = whole.values.to_numpy() if text.as_py() is None else shingle_set(text.as_py(), width)
                sides[side].append((cid, g, found, known))
        yield from done()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _open_lists(starred: DataFrame, placed: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """v, cid, g, due, size: the lists that the pivots leave open, each set of members once.

    starred: v, a (pivot), b (member); placed: the compared (a, b) with ok, both, nb and plus; groups: m, g.
    """
    seen = placed.select("a", "b", "ok")
    far = starred.join(seen, ["a", "b"], "left").where("ok IS NULL OR NOT ok").select(F.xxhash64(F.lit(1), "a", "v").alias("v"), F.col("b").alias("cid"), F.col("ok").isNull().alias("due"))
    added = placed.select("a", F.col("b").alias("cid"), (~F.col("ok")).alias("due"), F.explode("plus").alias("w")).select(F.xxhash64(F.lit(2), "a", "w").alias("v"), "cid", "due")
    inside = placed.where(f"ok AND nb < na OR NOT ok AND 100 * both >= {percent} * nb").select(F.xxhash64(F.lit(3), "a").alias("v"), F.col("b").alias("cid"), (~F.col("ok")).alias("due"))
    found = far.unionByName(added).unionByName(inside).join(groups, F.col("cid") == F.col("m"), "left").select("v", "cid", F.coalesce("g", "cid").alias("g"), "due")
    marked = found.withColumn("h", F.xxhash64("cid", "due"))
    lists = marked.groupBy("v").agg(F.count(F.lit(1)).alias("size"), F.min("g").alias("low"), F.max("g").alias("high"), F.max("due").alias("any_due"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    lists = lists.where("any_due AND low <> high").groupBy("size", "x", "s").agg(F.min("v").alias("v")).select("v", "size")
    return found.join(lists, "v")


def _linked(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))


def _picked(large: DataFrame, pivots: int) -> DataFrame:
    """v, slot, a: up to pivots due members of each list; lists that share members share pivots, so their pairs are the same."""
    slot = F.pmod(F.xxhash64(F.lit(5), "cid"), F.lit(pivots)).cast("int")
    return large.where("due").groupBy("v", slot.alias("slot")).agg(F.min_by("cid", F.xxhash64("cid")).alias("a"))


def _large_lists(large: DataFrame, near: DataFrame, links: DataFrame, shelf: Shelf, wide: int, width: int, percent: int, pivots: int = PIVOTS) -> DataFrame:
    """Links of lists of any size: those that further pivots find, then those of the blocks; large: v, cid, due; links: those known, as a component table."""
    picked = _picked(large, pivots)
    met = shelf.put(large.select("v", F.col("cid").alias("b")).join(picked, "v").select("v", "slot", "a", "b"))
    star = met.where("a <> b").select("a", "b").distinct()
    # verified() reads its pairs three times
    likely = shelf.put(_likely(star, near, wide, too_far(percent)))
    tested = shelf.put(verified(likely, near, width).drop("plus"))
    shelf.drop(likely)
    more = tested.where(_linked(percent)).select("a", "b")
    groups = connected_components(links.unionByName(more), shelf).select(F.col("a").alias("m"), F.col("b").alias("g"))
    sim = tested.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("sim"))
    known = met.join(sim, ["a", "b"], "left").withColumn("sim", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("sim"))).where("sim IS NOT NULL")
    known = known.groupBy("v", F.col("b").alias("cid")).agg(F.collect_list(F.struct("slot", "sim")).alias("sims"))
    members = large.select("v", "cid", "due").join(groups, F.col("cid") == F.col("m"), "left").select("v", "cid", "due", F.coalesce("g", "cid").alias("g"))
    split = members.groupBy("v").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("v")
    members = shelf.put(members.join(split, "v", "left_semi").join(known, ["v", "cid"], "left"))
    return more.unionByName(shelf.put(crowded(members, near, width, pivots, percent)))


def links(classes: DataFrame, docs: DataFrame, shelf: Shelf, doc_id: str = "doc_id", text: str = "text", k: int = K, wide: int = WIDE, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between classes that connect what is similar; classes: cid, rep, h1, h2, n, sketch."""
    chosen = shelf.put(_shared(classes, k, percent).select("cid"))
    near = shelf.put(wide_sketches(classes.select("cid", "rep", "h1", "h2").join(chosen, "cid", "left_semi"), docs, doc_id, text, width, wide))
    lists = shelf.put(inverted_lists(near, wide, percent).select("v", "cid", "own"))
    pivots = lists.groupBy("v").agg(F.min(F.struct("own", "cid")).alias("p"), F.count(F.lit(1)).alias("size")).where("size > 1")
    starred = shelf.put(lists.join(pivots.select("v", F.col("p.cid").alias("a")), "v").where("a <> cid").select("v", "a", F.col("cid").alias("b")))
    stars = starred.select("a", "b").distinct()
    close = shelf.put(_likely(stars, near, wide, too_far(percent)))
    placed = shelf.put(verified(close, near, width).withColumn("ok", _linked(percent)))
    shelf.drop(close)
    known = connected_components(placed.where("ok").select("a", "b"), shelf)
    groups = known.select(F.col("a").alias("m"), F.col("b").alias("g"))
    left = shelf.put(_open_lists(starred, placed, groups, percent))
    shelf.drop(lists)

    small = left.where(F.col("size") <= SMALL)
    due = small.where("due").select("v", F.col("cid").alias("y"), F.col("g").alias("y_g"))
    pairs = due.join(small.select("v", "cid", "g", "due"), "v").where("g <> y_g AND (NOT due OR cid < y)").select(F.greatest("cid", "y").alias("a"), F.least("cid", "y").alias("b"))
    large = left.where(F.col("size") > SMALL)
    if not large.isEmpty():
        known = known.unionByName(_large_lists(large, near, known, shelf, wide, width, percent))
    likely = shelf.put(_likely(pairs.distinct(), near, wide, percent))
    if likely.isEmpty():
        return known
    return known.unionByName(verified(likely, near, width).where(_linked(percent)).select("a", "b"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, wide: int = WIDE, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    if percent <= 50:
        raise ValueError("percent is above 50")
    with Shelf(df.sparkSession) as shelf:
        signed = shelf.put(signatures(df, doc_id, text, k, width))
        known = signed.where("doc_id IS NOT NULL AND n > 0")
        classes = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        classes = shelf.put(classes.withColumn("cid", F.monotonically_increasing_id()))
        marks = F.struct("h1", "h2")
        several = known.groupBy("doc_id").agg(F.min(marks).alias("one"), F.max(marks).alias("other")).where("one <> other")
        placed = known.select("doc_id", "h1", "h2").join(several.select("doc_id", "one"), "doc_id").distinct().join(classes.select("cid", "h1", "h2"), ["h1", "h2"])
        same = placed.join(classes.select(F.col("cid").alias("b"), marks.alias("one")), "one").select(F.col("cid").alias("a"), "b")
        found = connected_components(links(classes, df, shelf, doc_id, text, k, wide, width, percent).unionByName(same), shelf)
        members = found.select(F.col("a").alias("cid"), "b").unionByName(found.select(F.col("b").alias("cid"), "b").distinct())
        members = classes.select("cid", "rep", "h1", "h2").join(members, "cid")
        least = members.groupBy("b").agg(F.min("rep").alias("component"))
        result = members.join(least, "b").select("h1", "h2", "component")
        alone = signed.select("doc_id", "n", "h1", "h2").join(classes.select("h1", "h2", "rep"), ["h1", "h2"], "left").join(result, ["h1", "h2"], "left")
        own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
        out = alone.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
        return shelf.keep(shelf.put(out))
