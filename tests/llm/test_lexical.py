import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from leafstream.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10, repeated=False):
    """Plain ranks of rows (id, text)."""
    have = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in have), sum(c.total() for _, c in have)
    df = Counter(t for _, c in have for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, c in wanted.items():
        scores = []
        for d, held in have:
            if not held:
                continue
            m = 100 - 90 + (90 * held.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * held[t]) // (1000 * held[t] + 8 * m)) * (c[t] if repeated else 1) for t in c if t in held)
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(i, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got(docs, items, **how):
    return sorted((tuple(r) for r in lexical.search(docs, items, **how).select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [(1, "one two three"), (2, None), (3, ""), (4, "nowhere-to-be-found"), (None, "one, THREE two two"), (5, "ünd Abc123Def456Ghi789"), (5, "token")]


def test_equals_plain_ranks(spark, docs, rows):
    rng = random.Random(1)
    asked = ITEMS + [(10 + i, " ".join(rng.sample((r[1] or "x").split() or ["x"], 1)[0] for r in rng.sample(rows, 8))) for i in range(20)]
    items = spark.createDataFrame(asked, "item_id bigint, text string")
    plain = [(r[0], r[1]) for r in rows]
    assert got(docs, items) == brute(plain, asked)
    assert got(docs, items, k=3, repeated=True) == brute(plain, asked, 3, True)
    assert got(docs, items, block_terms=7) == brute(plain, asked)  # several blocks of items


def test_small_blocks_and_stretches(spark, docs, rows, monkeypatch):
    asked = [(1, rows[0][1]), (2, rows[9][1])]
    items = spark.createDataFrame(asked, "item_id bigint, text string")
    for docs_, pairs, stretch in ((1, 1 << 20, 1 << 20), (50, 3, 1 << 20), (7, 100, 5)):
        monkeypatch.setattr(lexical, "BLOCK_DOCS", docs_)
        monkeypatch.setattr(lexical, "BLOCK_PAIRS", pairs)
        monkeypatch.setattr(lexical, "STRETCH", stretch)
        assert lexical.term_counts(rows[9][1]) == (Counter(t.encode() for t in terms(rows[9][1])), len(terms(rows[9][1])))
        assert got(docs, items) == brute([(r[0], r[1]) for r in rows], asked)


def test_terms():
    text = "A-b_C\x00d\x7f Ünd É 日本語 1a\x80\xa0x"
    assert set(lexical.term_counts(text)[0]) == {t.encode() for t in terms(text)}
    assert lexical.term_counts(None) == (Counter(), 0)


def test_ties_go_by_id(spark):
    rows = [(d, "same words here") for d in range(40, 0, -1)] + [(None, "same words here"), (7, "same words here")] + [(100 + i, "quite another thing") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "same words")], "item_id bigint, text string")
    found = lexical.search(docs, items).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8] and [r["rank"] for r in found] == list(range(1, 11))


def test_product_of_matrices():
    rng = np.random.default_rng(1)
    n_docs, n_terms, n_items = 30, 12, 5
    dense = rng.integers(0, 4, (n_docs, n_terms)) * (rng.random((n_docs, n_terms)) < 0.4)
    asked = (rng.random((n_items, n_terms)) < 0.3).astype(np.int64)
    begins, document, values = lexical.columns_of(np.cumsum((dense > 0).sum(1)), np.nonzero(dense)[1], dense[dense > 0], n_terms)
    for i in range(n_items):
        row = np.zeros(n_docs, np.int64)
        for t in np.flatnonzero(asked[i]):
            row[document[begins[t] : begins[t + 1]]] += values[begins[t] : begins[t + 1]]
        assert (row == dense @ asked[i]).all()
        want = sorted(((-s, d) for d, s in enumerate(row.tolist()) if s > 0))[:4]
        assert lexical.first_k(row, 4, np.arange(n_docs)).tolist() == [d for _, d in want]


def test_odd_tables(spark, docs, clashing, empty):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    more = items.withColumns({"doc_id": F.lit(1), "rank": F.lit(2), "score": F.lit(3)})
    assert got(clashing.withColumn("score", F.lit(1)), more) == got(docs, items)
    assert got(empty, items) == [] and got(docs, items.where("false")) == [] and got(docs.where("text = ''"), items) == []
    named = docs.select(F.col("doc_id").cast("string").alias("d"), F.col("text").alias("said"))
    assert {r[2] for r in got(named, items, doc_id="d", text="said")} == {None if r[2] is None else str(r[2]) for r in got(docs, items)}
