r"""Mixing sources to target weights by temperature.

The token share p of each source is raised to an exponent and normalised; the exponent is
bisected in [0, 1] (1: natural shares, 0: uniform) until either the weights' entropy meets a target
or the most repeated source meets a repetition limit.  The weights become token budgets.  Each
source is an endless sequence of block permutations: its documents are dealt to blocks by a hash,
blocks, their sub-blocks and the documents in those are taken in hash order, epoch after epoch (each
epoch has its own order), until the budget is met.

Budgets: with ``total`` given, weight * total.  Without, the total is the least one that takes every
source whole at least once, so nothing is dropped and small sources are repeated.

Sources are mixed by ``position``: an epoch's blocks lie at places in [0, 1) that the permutation
gives, alike for all sources, so any stretch of an epoch holds all of its sources in proportion.

A source's running token counts are made in steps: its blocks (n_blocks at most), the sub-blocks
of the one block that the budget cuts, then the documents of one sub-block (a source's rows over
n_blocks squared), so no source is sorted in one task.  One row a source: up to MAX_SENT of them
are sent to all tasks and to the driver's bisection; of more, the sums that a step of the bisection
needs are aggregated, and the rows are joined by shuffle.

Defined results: null text counts 0 tokens, a text without words has nothing to repeat and is
taken once; a null source is a source of its own; a null doc_id is an id like others; repeated
rows are separate documents that are taken alike; a table without tokens is taken once as it is; an
empty table gives an empty table; further columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, n_words

N_BLOCKS, SEED, MAX_SENT = 4096, 17, 50_000


def powered(shares: dict, alpha: float) -> dict:
    """share ** alpha, normalised; sources without tokens stay at 0."""
    raised = {s: p**alpha if p > 0 else 0.0 for s, p in shares.items()}
    whole = math.fsum(raised.values())
    return {s: r / whole for s, r in raised.items()} if whole else raised


def entropy(weights: dict) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def repetition(shares: dict, weights: dict) -> float:
    """Epochs of the most repeated source when the least repeated one is taken once."""
    ratios = [weights[s] / p for s, p in shares.items() if p > 0]
    return max(ratios) / min(ratios) if ratios else 1.0


def bisect_exponent(too_flat: Callable[[float], bool], steps: int = 60) -> float:
    """The least exponent in [0, 1] that isn't too flat; too_flat must turn from true to false once."""
    low, high = 0.0, 1.0
    if not too_flat(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


def exponent(moments: Callable[[float], tuple[float, float]], largest: float, smallest: float, max_repetition: float | None, target_entropy: float | None, steps: int = 60) -> float:
    """The exponent that meets the limits.

    moments: of an exponent, the sums of p ** a and of p ** a * log(p ** a) over all shares above 0;
    largest, smallest: those shares.  A source's epochs are in proportion to p ** (a - 1), so the most
    repeated one is the smallest.
    """

    def too_flat(alpha: float) -> bool:
        if max_repetition is not None and (largest / smallest) ** (1 - alpha) > max_repetition:
            return True
        if target_entropy is None:
            return False
        whole, logs = moments(alpha)
        return math.log(whole) - logs / whole > target_entropy

    return bisect_exponent(too_flat, steps) if largest else 0.0


def solve(tokens: dict, max_repetition: float | None = None, target_entropy: float | None = None) -> tuple[float, dict]:
    """(exponent, weight by source) for token counts by source.

    With max_repetition: the flattest mix that repeats no source more than that often (relative to
    the least repeated).  With target_entropy (nats): the mix of that entropy, or the nearest
    reachable one.  With both: the flattest mix that meets both bounds.
    """
    whole = sum(tokens.values())
    shares = {s: t / whole if whole else 0.0 for s, t in tokens.items()}
    some = [p for p in shares.values() if p > 0]

    def moments(alpha: float) -> tuple[float, float]:
        raised = [p**alpha for p in some]
        return math.fsum(raised), math.fsum(r * math.log(r) for r in raised)

    alpha = exponent(moments, max(some, default=0.0), min(some, default=0.0), max_repetition, target_entropy)
    return alpha, powered(shares, alpha)


def _moments_of(counts: DataFrame, whole: int) -> Callable[[float], tuple[float, float]]:
    """moments() of more sources than the driver takes, a job each."""
    share = F.col("__c") / F.lit(float(whole))

    def moments(alpha: float) -> tuple[float, float]:
        raised = F.pow(share, F.lit(alpha))
        return tuple(counts.where("__c > 0").agg(F.sum(raised), F.sum(raised * F.log(raised))).first())

    return moments


def budgets(counts: DataFrame, max_repetition: float | None, target_entropy: float | None, total: float | None) -> tuple[DataFrame, int]:
    """counts(__s, __c) with __whole epochs and the tokens (__part) of one more; and the number of sources."""
    n, whole, largest, smallest = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("__c"), F.lit(0)), F.max("__c"), F.min(F.when(F.col("__c") > 0, F.col("__c")))).first()
    if not whole:
        return counts.select("__s", "__c", F.lit(1).alias("__whole"), F.lit(0).cast("long").alias("__part")), n
    if n <= MAX_SENT:
        some = [r[0] / whole for r in counts.where("__c > 0").select("__c").collect()]

        def moments(alpha: float) -> tuple[float, float]:
            raised = [p**alpha for p in some]
            return math.fsum(raised), math.fsum(r * math.log(r) for r in raised)
    else:
        moments = _moments_of(counts, whole)
    alpha = exponent(moments, largest / whole, smallest / whole, max_repetition, target_entropy)
    norm, _ = moments(alpha)
    # without a total, the source with most tokens for its weight, the largest, is taken once
    total = (largest / whole) ** (1 - alpha) * norm * whole if total is None else total
    taken = F.pow(F.col("__c") / F.lit(float(whole)), F.lit(alpha)) / norm * total / F.col("__c")
    taken = F.when(F.col("__c") == 0, F.lit(1.0)).when(F.abs(taken - F.round(taken)) < 1e-9, F.round(taken)).otherwise(taken)
    return counts.withColumn("__e", taken).select("__s", "__c", F.floor("__e").cast("int").alias("__whole"), F.round((F.col("__e") - F.floor("__e")) * F.col("__c")).cast("long").alias("__part")), n


def key_of(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """The hash that deals a document to its blocks."""
    return F.xxhash64(F.lit(seed), doc_id, F.xxhash64(text))


def blocks_of(key: Column, n_blocks: int = N_BLOCKS) -> tuple[Column, Column]:
    """A document's block and sub-block."""
    return F.pmod(key, F.lit(n_blocks)).cast("long"), F.pmod(F.shiftrightunsigned(key, 24), F.lit(n_blocks)).cast("long")


def ordinals(epoch: Column, key: Column, n_blocks: int = N_BLOCKS, seed: int = SEED) -> tuple[Column, Column, Column]:
    """Places of a document's block, sub-block and of itself in an epoch's order."""
    return tuple(F.xxhash64(F.lit(seed), epoch, x) for x in (*blocks_of(key, n_blocks), key))


def position(epoch: Column, key: Column, n_blocks: int = N_BLOCKS, seed: int = SEED) -> Column:
    """Where an epoch takes a document, in [0, 1): blocks in order, sub-blocks within the block's stretch."""
    block, sub, _ = ordinals(epoch, key, n_blocks, seed)
    unit = lambda h: (F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))).cast("double")
    return F.least(unit(block) + unit(sub) / F.lit(float(1 << 24)), F.lit(1 - 2.0**-53))


def _order(seed: int, whole: Column, key: Column) -> Column:
    """The order of blocks or documents in a source's last, partial epoch (whole: its number)."""
    return F.struct(F.xxhash64(F.lit(seed), whole, key).alias("o"), key.alias("k"))


def _cut_at(rows: DataFrame, at: list[str], by: str, seed: int) -> DataFrame:
    """Of each at, the by in which the room ends, with what room is left there: at, __whole, by, __room, and the order of by.

    rows: at, by, __t (tokens), __whole, __room.
    """
    order = _order(seed, F.col("__whole"), F.col(by))
    before = F.sum("__t").over(Window.partitionBy(*at).orderBy(order)) - F.col("__t")
    ends = rows.withColumn("__before", before).where("__before < __room")
    last = F.struct(by, (F.col("__room") - F.col("__before")).alias("__room"))
    return ends.groupBy(*at, "__whole").agg(F.max_by(last, order).alias("__x")).select(*at, "__whole", f"__x.{by}", "__x.__room")


def mix(df: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", tokens: Column | None = None, max_repetition: float | None = 2.0, target_entropy: float | None = None, total: float | None = None, n_blocks: int = N_BLOCKS, seed: int = SEED) -> DataFrame:
    """The input's rows, each as often as its source's budget takes it, with __epoch, __block, __sub, __slot.

    __epoch counts from 0; (__epoch, __block, __sub, __slot) is the order within the source, and
    position() of an epoch and key_of() the row is the place among all sources.  The last, partial
    epoch takes the documents whose first token lies within the budget.  The rows aren't shuffled:
    what decides is one line a source.  tokens is computed once, for a table without the texts.
    """
    spark = df.sparkSession
    key = key_of(F.col(doc_id), F.col(text), seed)
    tokens = n_words(F.col(text)) if tokens is None else tokens
    with Shelf(spark) as shelf:
        keyed = df.select(F.col(source).alias("__s"), key.alias("__h"), F.coalesce(tokens, F.lit(0)).cast("long").alias("__t"))
        block, sub = blocks_of(F.col("__h"), n_blocks)
        keyed = shelf.put(keyed.select("__s", "__h", "__t", block.alias("__b"), sub.alias("__u")))
        totals = shelf.put(keyed.groupBy("__s", "__b").agg(F.sum("__t").alias("__t")))
        counts = shelf.put(totals.groupBy("__s").agg(F.sum("__t").cast("long").alias("__c")))
        plan, n = budgets(counts, max_repetition, target_entropy, total)
        plan = shelf.put(plan)
        # a line per source: sent to all tasks up to a number of sources, joined by shuffle beyond
        small = F.broadcast if n <= MAX_SENT else (lambda t: t)
        same = lambda t, line, more="true": t.join(small(line), F.col("__s").eqNullSafe(F.col("__p")) & F.expr(more))
        renamed = lambda t, **names: t.select(*[F.col(c).alias(names.get(c, c)) for c in t.columns])

        line = renamed(plan.where("__part > 0").select("__s", "__whole", F.col("__part").alias("__room")), __s="__p")
        ends = shelf.put(_cut_at(same(totals, line), ["__s"], "__b", seed))
        line = renamed(ends, __s="__p", __b="__pb")
        edge = same(keyed, line, "__b = __pb")
        ends = shelf.put(_cut_at(edge.groupBy("__s", "__b", "__whole", "__room", "__u").agg(F.sum("__t").alias("__t")), ["__s", "__b"], "__u", seed))
        line = renamed(ends, __s="__p", __b="__pb", __u="__pu")
        edge = same(keyed, line, "__b = __pb AND __u = __pu")
        ends = _cut_at(edge.groupBy("__s", "__b", "__u", "__whole", "__room", "__h").agg(F.sum("__t").alias("__t")), ["__s", "__b", "__u"], "__h", seed)
        last = F.struct(*[_order(seed, F.col("__whole"), F.col(c)).alias(c) for c in ("__b", "__u", "__h")]).alias("__last")
        done = plan.select(F.col("__s").alias("__p"), "__whole").join(small(ends.select(F.col("__s").alias("__q"), last)), F.col("__p").eqNullSafe(F.col("__q")), "left").drop("__q")
        done = shelf.keep(shelf.put(done))

    block, sub = blocks_of(F.col("__h"), n_blocks)
    placed = df.withColumn("__h", key).withColumns({"__b": block, "__u": sub}).join(small(done), F.col(source).eqNullSafe(F.col("__p")))
    here = F.struct(*[_order(seed, F.col("__whole"), F.col(c)).alias(c) for c in ("__b", "__u", "__h")])
    within = F.coalesce(here <= F.col("__last"), F.lit(False))
    times = F.when(n_words(F.col(text)) == 0, 1).otherwise(F.col("__whole") + within.cast("int"))
    out = placed.withColumn("__times", times).where("__times > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
    return out.select(*df.columns, "__epoch", *[o.alias(c) for o, c in zip(ordinals(F.col("__epoch"), F.col("__h"), n_blocks, seed), ("__block", "__sub", "__slot"), strict=True)])
