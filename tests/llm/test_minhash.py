import itertools
import random
import re

import numpy as np
import pytest

from leafstream.llm import components, minhash
from leafstream.llm.common import Shelf


def shingles(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows):
    """doc_id to (set size, component), rows with an id only."""
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, shingles(t))
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def check(df, rows):
    want = brute(rows)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_documents(docs, rows):
    check(docs, [(d, t) for d, t, *_ in rows])


def test_groups_chains_and_passages(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    rows, passage = [], say(60)
    for g, (size, n) in enumerate(((60, 90), (25, 400), (8, 700), (2, 30), (6, 7))):
        base = say(n)
        for i in range(size):
            text = base.copy()
            for _ in range(rng.randint(0, max(1, n // 25))):
                at = rng.randrange(len(text))
                text[at : at + rng.choice((0, 1, 1))] = [] if rng.random() < 0.3 else [rng.choice(words)]
            rows.append((1000 * g + i, " ".join(text)))
    link = say(200)  # each differs from the next a little: linked in a chain only
    for i in range(10):
        rows.append((9000 + i, " ".join(link)))
        at = 5 + 18 * i
        link[at : at + 8] = say(8)
    rows += [(7000 + i, " ".join(say(rng.randint(20, 70)) + passage)) for i in range(60)]
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


@pytest.mark.parametrize(("frame", "slot"), [(70, 15), (110, 30)])  # sets that a sketch holds whole, and larger ones
def test_slots_filled_from_few_variants(spark, monkeypatch, frame, slot):
    rng = random.Random(frame)
    say = lambda n: ["w%d" % rng.randrange(100_000) for _ in range(n)]
    parts, fill = [say(frame // 5) for _ in range(5)], [[say(slot) for _ in range(6)] for _ in range(5)]
    chosen = rng.sample(list(itertools.product(range(6), repeat=5)), 400)  # each variant is in about 67 texts
    rows = [(i, " ".join(w for p, f, c in zip(parts, fill, choice, strict=True) for w in p + f[c])) for i, choice in enumerate(chosen)]
    monkeypatch.setattr(minhash.crowded, "__defaults__", (minhash.WIDTH, minhash.PIVOTS, minhash.PERCENT, 24, 5000))  # several blocks a list
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


@pytest.mark.parametrize(("n", "base", "own", "excerpts", "least", "most"), [(60, 160, 24, 80, 60, 60), (150, 160, 24, 150, 30, 130), (60, 800, 120, 60, 100, 600)])
def test_texts_of_which_excerpts_are_pivots(spark, n, base, own, excerpts, least, most):
    """Excerpts have no value of their own, so they are the pivots of all lists, and too far from the texts."""
    rng = random.Random(n)
    say = lambda k: ["w%d" % rng.randrange(1_000_000) for _ in range(k)]
    common = say(base)
    rows = [(1000 + i, " ".join(common + say(own))) for i in range(n)]
    for i in range(excerpts):
        long_ = rng.randint(least, most)
        at = rng.randrange(base - long_ + 1)
        rows.append((i, " ".join(common[at : at + long_])))
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_cut_copies_of_one_text(spark):
    """Copies that lack one end or the other: similar to those cut alike, all inside the whole text."""
    rng = random.Random(12)
    words = ["w%d" % rng.randrange(1_000_000) for _ in range(260)]
    rows = [(i, " ".join(words[a:b] + ["x%d" % i])) for i, (a, b) in enumerate((rng.randint(0, 100), rng.randint(160, 260)) for _ in range(120))]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_groups_in_one_large_list_make_few_pairs(spark):
    """Groups of large near copies under one common list: the pivots join them, no group's pairs are all made."""
    rng = random.Random(13)
    say = lambda k: ["w%d" % rng.randrange(1_000_000) for _ in range(k)]
    rows, due = [], []
    for g in range(3):
        base = say(600)
        for i in range(60):
            text = base.copy()
            text[(at := rng.randrange(590)) : at + 5] = say(5)
            rows.append((100 * g + i, " ".join(text)))
            due.append((7, 100 * g + i, True))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    with Shelf(spark) as shelf:
        signed = minhash.signatures(df, k=minhash.WIDE).join(df, "doc_id")
        near = shelf.put(signed.selectExpr("doc_id AS cid", "n", "sketch", "text"))
        none = spark.createDataFrame([], "a bigint, b bigint")
        made = minhash._large_lists(spark.createDataFrame(due, "v bigint, cid bigint, due boolean"), near, none, shelf, minhash.WIDE, 5, 75)
        assert made.count() <= 17 * 180
        # without pivots: the blocks alone make a forest, not all pairs
        alone = spark.createDataFrame([(v, c, c, d, []) for v, c, d in due], "v bigint, cid bigint, g bigint, due boolean, sims array<struct<slot:int,sim:double>>")
        assert minhash.crowded(alone, near).count() == 177
    check(df, rows)


def test_one_id_with_different_texts(spark):
    rng = random.Random(14)
    one, two, three = (" ".join("w%d" % rng.randrange(1000) for _ in range(80)) for _ in range(3))
    rows = [(5, one), (5, two), (7, one + " x"), (9, two + " y"), (4, three), (3, three + " z"), (11, "q " * 9)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {5: 5, 7: 5, 9: 5, 4: 3, 3: 3, 11: 11}


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n)) for n in (1, 5, 30, 50, 0, 20)]
    assert minhash._overlaps(sets[:3], sets[2:], 7).tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:3]]


def test_edges(clashing, empty):
    assert minhash.near_duplicates(clashing).count() == clashing.count()
    assert minhash.near_duplicates(empty).count() == 0


def test_shingle_sets():
    assert len(minhash.shingle_set(None)) == len(minhash.shingle_set(" \n")) == 0
    assert len(minhash.shingle_set("a b")) == 1 and (minhash.shingle_set("A b") == minhash.shingle_set("a\tb")).all()
    assert (minhash.shingle_set("É x") != minhash.shingle_set("é x")).all()  # only A to Z are lower-cased
    text = "a b c d e f a b c d e"
    assert len(minhash.shingle_set(text)) == len(shingles(text)) and (np.diff(minhash.shingle_set(text)) > 0).all()


@pytest.mark.parametrize("n", [5, 48, 64, 192, 1000])
def test_floor_is_below_the_mean(n):
    assert 0 < minhash.sketch_floor(n, 256) <= 0.75 * min(n, 256) + 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5), (101, 100)]
    with Shelf(spark) as shelf:
        got = {r.a: r.b for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), shelf).collect()}
        assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint"), shelf).count() == 0
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_large_lists_of_the_same_members_share_pivots(spark):
    """40 lists of 60 members are compared with at most 16 pivots in all, not with 16 a list."""
    large = spark.range(40 * 60).selectExpr("id div 60 AS v", "id % 60 AS cid", "id % 60 < 50 AS due")
    picked = minhash._picked(large, 16).collect()
    assert len({r.a for r in picked}) <= 16 and len({(r.v, r.slot) for r in picked}) == len(picked)
    assert {r.v for r in picked} == set(range(40)) and all(r.a < 50 for r in picked)


def test_pairs_are_written_before_they_are_compared(spark, docs, monkeypatch):
    """verified() reads its pairs three times: they are a table, not the join of their sketches."""
    plans, verified = [], minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda pairs, *a: plans.append(pairs._jdf.queryExecution().optimizedPlan().toString()) or verified(pairs, *a))
    minhash.near_duplicates(docs)
    assert plans and not any("Join" in p for p in plans)
