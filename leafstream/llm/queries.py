"""The queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, lexical, licenses, media, minhash, mixing, packing, pagetext, quality, secrets, tokencounts
from .common import token_count


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and epoch in the mix; tokens are the vocabulary's."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents", "doc_id", "source", "text"), tokens=token_count(F.col("text")))
    return mixed.selectExpr("doc_id", "source", "__epoch AS epoch", "__block AS block", "__sub AS sub", "__slot AS slot")


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip_digests(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), tokens=token_count(F.col("text")))


def op5_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per licence notice found."""
    return licenses.scan(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], said.schema)
    return chat.conversation_digests(chat.prefix_trees(said.unionByName(more))).drop("n_tokens")


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line of each document."""
    counted = tokencounts.section_tokens(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return counted.withColumn("n_tokens", counted.n_tokens.cast("bigint"))


def op9_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(_table(spark, sf_dir, "documents", "doc_id", "text")))


def op11_sparse_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents", "text", "lang"))


def op13_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_temperature_mixing": op1_temperature_mixing,
    "op2_line_frequency": op2_line_frequency,
    "op3_progressive_jpeg": op3_progressive_jpeg,
    "op4_best_fit": op4_best_fit,
    "op5_patience": op5_patience,
    "op6_prefix_tree": op6_prefix_tree,
    "op7_bottom_k": op7_bottom_k,
    "op8_token_attribution": op8_token_attribution,
    "op9_minimum_cut": op9_minimum_cut,
    "op10_token_efficiency": op10_token_efficiency,
    "op11_sparse_product": op11_sparse_product,
    "op12_suffix_array": op12_suffix_array,
    "op13_rank_array": op13_rank_array,
}

_WORD = r"[^\x20\x09-\x0D]+"
_NORM = r"trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
lines AS (SELECT doc_id, source, t, line FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
norm AS (SELECT doc_id, source, t, {_NORM} AS h, len(regexp_extract_all(line, '{_WORD}')) AS n FROM lines),
often AS (SELECT source, h FROM norm GROUP BY source, h HAVING count(DISTINCT t) > 20),
gone AS (SELECT n.doc_id, count(*) AS k, sum(n.n) AS n FROM norm n JOIN often o ON n.source IS NOT DISTINCT FROM o.source AND n.h = o.h GROUP BY n.doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             coalesce(gone.k, 0) AS n_cut_lines, coalesce(gone.n, 0) AS n_cut_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_cut_words >= 0.3 * n_words AS kept,
       CAST(n_cut_lines AS BIGINT) AS n_cut_lines, CAST(n_cut_words AS BIGINT) AS n_cut_words
FROM b
"""

# Escapes of chat.py: a backslash doubled, then one inside each control string.
_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')"

OP6_SQL = rf"""
WITH said AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
              SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM said),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x) AS whole,
             coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '') AS loss,
             sum(4 + length(replace({_ESCAPED.format('r')}, ':', '\:')) + 2 + length({_ESCAPED.format('x')}) + 9) AS n FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM c
"""

OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM pair JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

# The generated pages hold their article in one element; its blocks end at these tags.
OP9_SQL = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '<(br|/?p|/?h1|/?li|/?ul)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;?', '&', 'g'), '[\x09-\x0D\x20]+', ' ', 'g'), ' ') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
w AS (SELECT t, CAST(floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, c GROUP BY t, c.n),
m AS (SELECT r, doc_id, 10 + (90 * len(ts) * c.n) // c.l AS m FROM d, c WHERE len(ts) > 0),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""

OP12_SQL = rf"""
WITH p AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase
      FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS v(size) WHERE len(ws) >= size)),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 30),
k AS MATERIALIZED (SELECT lang, phrase, a, k, lang || chr(0) || array_to_string(w[1 : k], ' ') AS x, lang || chr(0) || array_to_string(w[k + 1 : size], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
h AS MATERIALIZED (SELECT lang || chr(0) || phrase AS x, n FROM f WHERE n >= 30),
s AS (SELECT k.lang, k.phrase, k.a, one.n AS l, two.n AS r, k.k, CAST((CAST(k.a AS HUGEINT) * 2000000) // (CAST(one.n AS HUGEINT) + two.n) AS BIGINT) AS score
      FROM k JOIN h one ON one.x = k.x JOIN h two ON two.x = k.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[j : j + z - 1], ' ') AS phrase, max(a) AS most
      FROM (SELECT lang, a, w, z, unnest(range(1, size - z + 2)) AS j FROM c, (VALUES (2), (3)) AS v(z) WHERE size > z) GROUP BY ALL),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, t.n, score
      FROM b JOIN t USING (lang) LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op2_line_frequency": OP2_SQL, "op6_prefix_tree": OP6_SQL, "op7_bottom_k": OP7_SQL, "op9_minimum_cut": OP9_SQL, "op11_sparse_product": OP11_SQL, "op12_suffix_array": OP12_SQL,
}
