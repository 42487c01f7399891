import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from leafstream.llm import chat, tokencounts
from leafstream.llm.common import VOCAB_PATH, encode_text, encoding

SAID = "conv_id bigint, turn bigint, role string, text string"
NASTY = ["\\### Assistant: </turn> ok", "", "##", "###", "####\\", "</turn>", "<\\/turn>", "\\\\", "a\n</turn>\n### user:\nb", "é\U0001f600"]


@pytest.mark.parametrize("text", NASTY)
def test_escape_is_reversible_and_clean(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and "###" not in safe and "</turn>" not in safe
    assert chat.parse("".join(chat.segments("user:\n### x", text))) == [("user:\n### x", text)]


def conversations():
    rng = random.Random(4)
    start = [("system", "be kind"), ("user", "hello")]
    out = []
    for c in range(60):
        turns = start[: rng.randint(0, 2)] + [(rng.choice(("user", "assistant", None, "tool:x")), rng.choice([*NASTY, None, "yes", "no"])) for _ in range(rng.randint(1, 5))]
        out += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    out += [(100, 0, "user", "same"), (100, 1, "assistant", "same")] + [(101, 0, "user", "same"), (101, 1, "assistant", "same")] + [(None, 0, "assistant", "x"), (102, None, "assistant", "x"), (103, 0, "user", "r"), (103, 0, "user", "r")]
    rng.shuffle(out)
    return out


def brute(rows):
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((n is not None, n or 0, r or "", t or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = set()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        form = "".join("".join(chat.segments(r, t)) for *_, r, t in turns)
        out.add((c, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss), len(form)))
    return out


@pytest.mark.parametrize("most", [1, 7, 256])
def test_digests_equal_brute_force(spark, most):
    rows = conversations()
    df = spark.createDataFrame(rows, SAID)
    got = chat.conversation_digests(chat.prefix_trees(df, max_conversations=most)).collect()
    assert len(got) == len(brute(rows)) and {tuple(r)[:6] for r in got} == brute(rows)


def test_trees_share_and_mask(spark):
    rows = [(c, 0, "user", "hello there") for c in range(4)] + [(c, 1, "assistant", f"answer {c % 2}") for c in range(4)]
    tree = chat.prefix_trees(spark.createDataFrame(rows, SAID).coalesce(1), max_conversations=99)
    trees = tree.collect()
    nodes = [n for t in trees for n in t.nodes]
    assert sum(n.depth == 1 for n in nodes) == 2 or len(trees) > 1
    for t in trees:
        for n in t.nodes:
            assert n.end <= n.subtree_end and all(s.end <= n.start for s in n.ancestors)
            if n.depth:
                up = t.nodes[n.parent]
                assert t.position_ids[n.start] == t.position_ids[up.end - 1] + 1
                assert any(s.start <= up.start and up.end <= s.end for s in n.ancestors)
        text = encoding(VOCAB_PATH).decode([i for i, m in zip(t.token_ids, t.loss_mask, strict=True) if m])
        assert text.replace("answer 0", "").replace("answer 1", "") == ""


def test_chat_edges(spark):
    empty = spark.createDataFrame([], SAID)
    assert chat.conversation_digests(chat.prefix_trees(empty)).count() == 0
    more = spark.createDataFrame([(1, 0, "user", "x", 5, 6)], SAID + ", path int, turns int")
    assert chat.conversation_digests(chat.prefix_trees(more)).count() == 1


TEXTS = ["", "one line", "a\n\n\nb\n", "\n\n", "é\U0001f600 x\ny", "tokens across\nthe lines\r\n" * 5, "x" * 500 + "\n" + "y" * 3]


@pytest.mark.parametrize("rule", tokencounts.RULES)
@pytest.mark.parametrize("text", TEXTS)
def test_attribution_equals_character_voting(text, rule):
    """Each character belongs to the token that it begins in; tokens vote with their characters."""
    enc = encoding(VOCAB_PATH)
    data = text.encode()
    begins = [len(data[:i].decode("utf-8", "ignore")) if i == 0 or i == len(data) or data[i] & 0xC0 != 0x80 else None for i in range(len(data) + 1)]
    for bounds in (tokencounts.line_starts(text), np.array([0, len(text) // 3, len(text) // 2]) if len(text) > 6 else np.array([0])):
        starts = tokencounts.token_starts(text)
        counts, crossed = tokencounts.attribute(starts, bounds, rule)
        want, at, cross = np.zeros(len(bounds)), 0, 0
        section = lambda c: int(np.searchsorted(bounds, c, "right")) - 1
        for i in enc.encode_ordinary(text):
            n = len(enc.decode_single_token_bytes(i))
            chars = [begins[b] for b in range(at, at + n) if data[b] & 0xC0 != 0x80]
            at += n
            if not chars:
                last = max(b for b in range(at - n) if data[b] & 0xC0 != 0x80)
                want[section(begins[last])] += 1
                continue
            votes = np.bincount([section(c) for c in chars], minlength=len(bounds))
            cross += (votes > 0).sum() > 1
            if rule == "split":
                want += votes / votes.sum()
            else:
                want[np.argmax(votes) if rule == "majority" else section(chars[0])] += 1
        assert np.allclose(counts, want) and counts.sum() == len(enc.encode_ordinary(text))
        assert (crossed > 0).any() == (cross > 0)


def test_line_starts():
    assert tokencounts.line_starts("").tolist() == [0] and tokencounts.line_starts("a\nb\n").tolist() == [0, 2]


def test_fields_and_frames(spark, docs, clashing, empty):
    from pyspark.sql import functions as F

    joined = docs.select("doc_id", tokencounts.fields(("lang", F.col("lang")), ("text", F.col("text"))).alias("f")).select("doc_id", "f.text", "f.starts")
    out = tokencounts.section_tokens(joined, starts="starts")
    assert out.count() == 2 * docs.count()
    whole = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    text = joined.where("doc_id = 1").first().text
    assert whole[1] == len(encoding(VOCAB_PATH).encode_ordinary(text))
    assert tokencounts.section_tokens(clashing).count() == tokencounts.section_tokens(docs).count()
    assert tokencounts.section_tokens(empty).count() == 0
    with pytest.raises(ValueError):
        tokencounts.section_tokens(docs, rule="other")


@pytest.mark.parametrize("blank", [" ", "\n", " \n\t", "\u3000 "])
@pytest.mark.parametrize(("before", "behind"), [("", ""), ("x", "y"), ("don't.", "'s"), ("1", "\x1cq")])
def test_long_white_space_gives_the_same_tokens(blank, before, behind):
    text = before + blank * 70_000 + behind
    assert encode_text(text + text) == encoding(VOCAB_PATH).encode_ordinary(text + text)


def test_ten_million_blanks(spark):
    text = "x" + " " * 10_000_000 + "y\n" + "\n" * 2_000_000
    starts = tokencounts.token_starts(text)
    assert starts[0] == 0 and starts[-1] == len(text) and encoding(VOCAB_PATH).decode(encode_text(text)) == text
    text = "x" + " " * 1_500_000 + "y"
    rows = [(1, 0, "user", text), (1, 1, "assistant", text)]
    got = chat.conversation_digests(chat.prefix_trees(spark.createDataFrame(rows, SAID))).collect()
    assert {tuple(r)[:6] for r in got} == brute(rows)
    assert tokencounts.section_tokens(spark.createDataFrame([(1, "x" + " " * 2_000_000 + "y")], "doc_id bigint, text string")).first().n_chars == 2_000_002
