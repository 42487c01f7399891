import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafstream.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.TOKENIZER_PATH)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def same(library, text, special=True):
    library.encode_special_tokens = not special
    want = library.encode(text, add_special_tokens=False).ids
    library.encode_special_tokens = False
    got = bpe.codec().encode(text, special)
    assert ids(got) == want, text[:40]
    assert bpe.codec().decode(got) == library.decode(want, skip_special_tokens=False)


TEXTS = [
    "", " ", "\n\n  x", "don't we'll 'S x's they've", "<|endoftext|>", "a <|endoftext|><|endoftext|> b<|endoftext", "0123456789" * 30, "ab" * 500, "é" * 700, "日本語のテキスト 한국어 🙂🙂", " \x85　 x\x1c\x1d",
    "x" * 127 + " " + "y" * 128 + " " + "z" * 129, "internationalisation " * 50, "\x00\x01 \x7f", " " * 300 + "x", "aB3" * 400, "éé",
]


def test_equals_the_library(library, rows):
    for text in TEXTS + [r[1] or "" for r in rows]:
        same(library, text)
        same(library, text, special=False)


def test_code_points_in_all_places(library):
    """All up to U+30FF, then one in eleven: classes change in longer ranges there."""
    every = [i for i in (*range(0x3100), *range(0x3100, 0x110000, 11)) if not 0xD800 <= i < 0xE000]
    for low in range(0, len(every), 509):
        points = [chr(i) for i in every[low : low + 509]]
        same(library, "".join(f"a{c}b {c}1{c}  {c}{c} " for c in points))


def test_random_bytes_as_latin_and_long_words(library):
    rng = random.Random(3)
    for n in (1, 2, 3, 64, 128, 129, 2000):
        for _ in range(20):
            same(library, bytes(rng.randrange(256) for _ in range(n)).decode("latin-1"))
            same(library, "".join(rng.choice("etaoin") for _ in range(n)))


def test_short_and_long_words_alike():
    rng, vocabulary = random.Random(4), bpe.codec().vocabulary
    for _ in range(2000):
        word = "".join(rng.choice("aaabehinrst ") for _ in range(rng.randint(0, 90))).encode()
        assert bpe.encode_short(word, vocabulary) == bpe.encode_long(word, vocabulary)


def test_text_longer_than_a_stretch(library):
    same(library, "Some words, again and again; " * (bpe.STRETCH // 20))
    assert len(bpe.codec().encode(" " * 2_000_000 + "x")) % 4 == 0


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    fresh = bpe.Codec()
    assert fresh.encode("one two three four five six seven eight one") == bpe.codec().encode("one two three four five six seven eight one")
    assert len(fresh.words) <= 5


def test_ids_that_the_vocabulary_lacks_and_broken_bytes(library):
    packed = np.array([0, 60_000, 4_000_000_000, 1], "<u4").tobytes()
    assert bpe.codec().decode(packed) == '!"'
    one = bpe.codec().encode("é")[:4] if len(bpe.codec().encode("é")) > 4 else np.array([bpe.codec().vocabulary.first[0xC3]], "<u4").tobytes()
    assert bpe.codec().decode(one) == library.decode(ids(one), skip_special_tokens=False) == "�"


def test_other_vocabularies_are_errors(tmp_path):
    with open(bpe.TOKENIZER_PATH, encoding="utf-8") as f:
        told = json.load(f)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told | {"normalizer": {"type": "Lowercase"}}))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(path))


def test_digests(docs, rows, library):
    want = []
    for d, text, *_ in rows:
        encoded = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(encoded, skip_special_tokens=False)
        want.append((d or -1, len(encoded), hashlib.sha256(np.array(encoded, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = [(r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()]
    assert sorted(got) == sorted(want)


def test_round_trip_in_many_batches(spark, docs, monkeypatch):
    many = docs.crossJoin(spark.range(40).select(F.col("id").alias("n"))).coalesce(1)
    back = bpe.decode(bpe.encode(many, keep=("doc_id", "n", "text")).withColumnRenamed("text", "said"), keep=("doc_id", "n", "said"))
    assert back.where("text <> coalesce(said, '')").count() == 0 and back.count() == many.count()


def test_odd_tables(clashing, empty, docs):
    assert bpe.digests(empty).count() == 0
    assert sorted(map(str, bpe.digests(clashing).collect())) == sorted(map(str, bpe.digests(docs).collect()))
    odd = docs.select("doc_id", F.col("text").alias("ids"), F.lit(1).alias("n_tokens"), "text")
    assert bpe.encode(odd, keep=("doc_id",)).columns == ["doc_id", "n_tokens", "ids"]
