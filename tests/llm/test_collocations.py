import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafstream.llm import collocations as co
from leafstream.llm.common import Shelf

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def phrase_counts(rows, longest):
    """Plain counts: rows of (text, lang)."""
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return f, total


def brute(rows, longest=4, least=3, cover=80, most=50):
    f, total = phrase_counts(rows, longest)
    out = []
    for lang, counts in f.items():
        long_ = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = Counter()
        for p, a in long_.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside[p[i : i + n]], a)
        rows_ = []
        for p, a in long_.items():
            if 100 * inside[p] >= cover * a:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, r, total[lang], -s) for i, (s, a, p, x, r) in enumerate(sorted(rows_)[:most], 1)]
    return sorted(out)


def got(df, **how):
    rows = co.collocations(df, **{"least": 3, "most": 50, "bits": 1 << 12, **how})
    return sorted(tuple(r) for r in rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def some_rows(seed=1, n=120):
    rng = random.Random(seed)
    words = ["Ab", "ab", "é", "É", "c", "d", "e\x00f", "-", "x\xa0y", "日本"]
    say = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r", "\x0b", "? "]) for _ in range(rng.randint(0, 40)))
    rows = [(say(), rng.choice(["a", "a", "b", None, "und"])) for _ in range(n)]
    return rows + [(None, "a"), ("", "b"), (" \t\n", "c"), ("one", "d"), (rows[0][0], rows[0][1])]


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame(some_rows(), "text string, lang string")


def test_equals_plain_counts(some):
    for longest in (2, 3, 4):
        assert got(some, longest=longest) == brute(some_rows(), longest)


def test_few_bits_lose_nothing(some):
    assert got(some, bits=64) == got(some, bits=1 << 20) == brute(some_rows())


def test_shards_that_end_anywhere(some, monkeypatch):
    monkeypatch.setattr(co, "STRETCH", 7)
    for words in (1, 5, 50):
        assert got(some, shard_words=words) == brute(some_rows())


def test_documents(docs, rows):
    assert got(docs, least=4, most=2000) == brute([(r[1], r[2]) for r in rows], least=4, most=2000)


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(2)
    for depth in (1, 2, 3, 4, 7):
        for n in (1, 2, 50, 400):
            ids = rng.integers(0, 4, n).astype(np.int32)
            order = co.suffix_array(ids, depth)
            heads = [tuple(np.concatenate([ids, np.zeros(depth, np.int32)])[i : i + depth].tolist()) for i in order]
            assert heads == sorted(heads) and sorted(order) == list(range(n))
            shared = co.common_prefixes(ids, order, depth)
            for d in range(1, depth + 1):
                place, count = co.intervals(ids, order, shared, d)
                whole = Counter(tuple(ids[i : i + d].tolist()) for i in range(n - d + 1) if 0 not in ids[i : i + d])
                assert {tuple(ids[i : i + d].tolist()): c for i, c in zip(place, count.tolist(), strict=True)} == dict(whole)


def test_wide_keys_sort_alike():
    rng = np.random.default_rng(3)
    high, low = rng.integers(0, 1 << 40, 500), rng.integers(0, 1 << 40, 500)
    assert (co._ordered(high, low) == np.lexsort((low, high))).all()


def test_one_long_text_is_taken_whole(spark):
    rng = random.Random(5)
    text = " ".join(rng.choice("abcdefgh") for _ in range(30_000))
    df = spark.createDataFrame([(text, "a")], "text string, lang string")
    assert got(df, shard_words=1000) == brute([(text, "a")])


def test_counts_that_pass_64_bits(spark):
    n = 9_000_000_000_000_000_000
    table = lambda rows: spark.createDataFrame(rows, "lang string, phrase string, n bigint")
    row = co.scored([table([("a", "x", n), ("a", "y", n)]), table([("a", "x y", n)])]).first()
    assert (row.l, row.r, row.score) == (n, n, 1_000_000)


def test_odd_tables(docs, clashing, empty):
    assert got(empty) == [] and got(clashing, least=4) == got(docs, least=4)
    with pytest.raises(ValueError):
        co.collocations(docs, longest=1)
    assert got(docs.select(F.col("text"), F.lit(None).cast("string").alias("lang")), least=4)[0][0] == "und"


def test_tables_on_the_way_are_deleted(spark, some):
    with Shelf(spark) as shelf:
        co.frequent_phrases(some, shelf, least=3, bits=1 << 12)
        assert len(shelf.held) == 5


def test_packed_counts_come_back():
    rng = np.random.default_rng(4)
    keys, n = co.summed(rng.integers(0, 1 << co.KEY_BITS, 5000).astype(np.uint64), rng.integers(-1, 4, 5000))
    back = [(part << co.KEY_BITS - co.PART_BITS | int(k), int(x)) for part, blob in co.packed(keys, n) for k, x in zip(*co.unpacked(blob), strict=True)]
    assert sorted(back) == list(zip(keys.tolist(), n.tolist(), strict=True))


def test_only_frequent_phrases_are_dealt_as_text(spark):
    """Every word is frequent, next to no pair is: what is dealt as text doesn't grow with the text."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows = [(" ".join(rng.choice(words) for _ in range(400)) + " w0 w1", "a") for _ in range(40)]
    df = spark.createDataFrame(rows, "text string, lang string")
    with Shelf(spark) as shelf:
        held = shelf.put(co.shards(df, "text", "lang", 4))
        single = df.select(F.explode(F.split("text", " ")).alias("phrase")).distinct().select(F.lit("a").alias("lang"), "phrase")
        known = spark.sparkContext.broadcast(co.possible(single, 1))
        often = spark.sparkContext.broadcast(co.enough(held, 2, known, 30))
        assert [tuple(r) for r in co.counted(held, 2, often).collect() if r.n >= 30] == [("a", "w0 w1", sum(" ".join(["", t, ""]).count(" w0 w1 ") for t, _ in rows))]
        assert co.counted(held, 2, often).count() == 1
