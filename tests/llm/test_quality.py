import random
import re
from collections import Counter, defaultdict

import pytest

from leafstream.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, max_docs, max_share, min_left, keep_first):
    carriers, contents, first = defaultdict(set), defaultdict(set), {}
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", x.lower())).strip(" ")
    for d, t, _, s, _ in rows:
        contents[s].add(t)
        for line in (t or "").split("\n"):
            if WORD.search(line):
                carriers[s, norm(line)].add(t)
                key = (s, norm(line))
                if d is not None:
                    first[key] = min(first.get(key, d), d)
    out = []
    for d, t, _, s, _ in rows:
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
        gone = [x for x in lines if len(carriers[s, norm(x)]) > max_docs and len(carriers[s, norm(x)]) > max_share * len(contents[s]) and not (keep_first and first.get((s, norm(x))) == d)]
        lost = sum(len(WORD.findall(x)) for x in gone)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((d, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, not failed and len(words) - lost >= min_left * len(words), len(gone), lost))
    return out


@pytest.mark.parametrize(("share", "keep_first"), [(0.0, False), (0.001, True), (0.9, False)])
def test_report_equals_brute_force(docs, rows, share, keep_first):
    got = quality.report(docs, max_docs=20, max_share=share, min_left=0.3, keep_first=keep_first)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_cut_lines", "n_cut_words"]
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows, 20, share, 0.3, keep_first))
    assert any(r[8] for r in brute(rows, 20, share, 0.3, keep_first)) == (share < 0.9)


def test_the_limit_does_not_grow_with_the_host(spark):
    """The same menu line in 30 documents of a small host and of one with many more."""
    rng = random.Random(5)
    say = lambda: " ".join("w%d" % rng.randrange(10_000) for _ in range(60))
    rows = [(i, ("home about\n" if i % 100 < 30 else "") + say(), host) for i, host in enumerate(["small"] * 100 + ["large"] * 100)] + [(1000 + i, say(), "large") for i in range(900)]
    got = quality.report(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert got.where("n_cut_lines = 1").count() == 60


def test_repeats_and_symbols(spark):
    text = "a b c a b c x # | <y>\nq\nq\n" + "\x0b".join("w%d" % i for i in range(60))
    r = quality.report(spark.createDataFrame([(1, text, "s")], "doc_id bigint, text string, source string")).first()
    assert (r.n_repeat_words, r.n_dup_lines, r.n_symbols) == (6, 1, 4)


def common_line(rows):
    return next(t for d, t, *_ in rows if d == 100).split("\n")[0]


def test_clean_keeps_schema_and_first_carrier(docs, rows):
    out = quality.clean(docs, length="n_chars", max_docs=20, min_left=0.3, keep_first=True)
    assert common_line(rows) not in {r.doc_id: r for r in quality.clean(docs).collect()}[100].text
    assert out.columns == docs.columns
    kept = {r.doc_id: r for r in out.collect()}
    common = common_line(rows)
    assert common in kept[100].text and common not in kept[101].text
    assert kept[101].n_chars == len(kept[101].text)
    assert 4 not in kept and 5 not in kept


def test_edges(clashing, empty):
    assert quality.report(clashing).count() == clashing.count()
    assert quality.clean(clashing).columns == clashing.columns
    assert quality.report(empty).count() == 0 and quality.clean(empty).count() == 0


def test_no_python_in_the_plan(docs):
    plan = quality.judged(quality.measured(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
