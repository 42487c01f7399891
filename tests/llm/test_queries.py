from collections import Counter

import os

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from leafstream.llm import mixing, queries
from leafstream.llm.common import encode_text, token_count


def test_names_and_whole_tables(spark, sf_dir):
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op2_line_frequency", "op3_progressive_jpeg", "op7_bottom_k", "op10_token_efficiency"):
        assert queries.QUERIES[name](spark, sf_dir).count() == n
    assert queries.QUERIES["op6_prefix_tree"](spark, sf_dir).where("conv_id = -7").first().n_turns == 2


@pytest.mark.parametrize("name", ["op11_sparse_product", "op12_suffix_array"])
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(folder, t)}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, folder)
    assert got.columns == names
    got, want = sorted(map(tuple, got.collect())), sorted(want.fetchall())
    assert len(want) > 100 and got == want


def test_pipeline_stages(spark, docs, clashing, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, clashing, empty):
            assert stage(spark, given, "").columns == given.columns, name
        assert stage(spark, empty, "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").count() == 0


def test_pipeline_equals_its_parts_by_brute_force(spark, docs, rows):
    from .test_minhash import brute

    cleaned = corpus_pipeline.quality_rules(spark, docs, "").cache()
    left = [(r.doc_id, r.text) for r in cleaned.collect()]
    want = brute(left)
    one = corpus_pipeline.near_duplicates(spark, cleaned, "")
    got = sorted(r.doc_id for r in one.collect() if r.doc_id is not None)
    assert got == sorted(d for d, _ in left if d is not None and want[d][1] == d)
    masked = corpus_pipeline.secret_scan(spark, one, "")
    assert masked.count() == one.count()
    mixed = corpus_pipeline.mixing_sources(spark, masked, "").cache()
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in one.collect()}
    packed = corpus_pipeline.best_fit_packing(spark, mixed, "").collect()
    assert sum(r.part_start == 0 for r in packed) == mixed.count()
    got, want = Counter(), Counter()  # longer documents are in parts, null ids share one
    for r in packed:
        got[r.doc_id] += r.n_tokens
    for r in mixed.collect():
        want[r.doc_id] += len(encode_text(r.text))
    assert got == want
    epochs = mixing.mix(masked, tokens=token_count(F.col("text"))).select("doc_id", "text", "__epoch").collect()
    assert Counter((r.doc_id, r["copy"]) for r in packed if r.part == 0) == Counter((r.doc_id, r["__epoch"]) for r in epochs)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "bin" in out.columns


def test_one_of_repeated_copies_stays(spark, docs):
    one = corpus_pipeline.near_duplicates(spark, docs.where("doc_id IN (7, 8)"), "")
    assert one.count() == 1
    eight = docs.where("doc_id = 8")
    assert eight.count() == 2 and corpus_pipeline.near_duplicates(spark, eight, "").collect() == eight.distinct().collect()
    other = eight.unionByName(spark.createDataFrame([(8, "quite another text of the same id", "en", "a", 33), (None, "x", "en", "a", 1), (None, "x", "en", "a", 1)], eight.schema))
    got = corpus_pipeline.near_duplicates(spark, other, "")
    assert got.columns == docs.columns and sorted(r.text for r in got.where("doc_id = 8").collect()) == ["one two three", "quite another text of the same id"]
