"""The registered queries of this folder: each applies one operator to its whole table."""

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from . import (
    bpe_chunks, chat_tree, context_mixing, crf_toxicity, language_id, line_chunks, minhash_windows, phrase_tries, rans, simhash_bk, tput_topk,
    weak_quality, zfast_trie,
)

_SHIPPED = set()
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def tokenizer_path(name="word_bpe_49k.json"):
    import public_tokenizers
    return public_tokenizers.path(name)


def ship(spark):
    """Gives the Python workers this package, once per application, as --py-files would."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "gitgauge-package"), "zip", top, "gitgauge")
    spark.sparkContext.addPyFile(archive)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_mixing(spark, sf_dir):
    return context_mixing.lm_score(table(spark, sf_dir, "documents"))


def op2_tput_topk(spark, sf_dir):
    return tput_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op4_minhash_windows(spark, sf_dir):
    return minhash_windows.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_chunks(spark, sf_dir):
    return line_chunks.line_dedup(table(spark, sf_dir, "documents"))


def op6_rans(spark, sf_dir):
    return rans.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_simhash_bk(spark, sf_dir):
    return simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))


def op8_weak_quality(spark, sf_dir):
    return weak_quality.quality(table(spark, sf_dir, "documents"))


def op9_bpe_chunks(spark, sf_dir):
    return bpe_chunks.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_crf_toxicity(spark, sf_dir):
    return crf_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrase_tries(spark, sf_dir):
    return phrase_tries.collocations(table(spark, sf_dir, "documents"))


def op12_chat_tree(spark, sf_dir):
    probe = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    return chat_tree.chat_digests(table(spark, sf_dir, "conversations").select(*probe.columns).unionByName(probe))


def op13_zfast_trie(spark, sf_dir):
    return zfast_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_context_mixing, op2_tput_topk, op3_language_id, op4_minhash_windows, op5_line_chunks, op6_rans, op7_simhash_bk,
    op8_weak_quality, op9_bpe_chunks, op10_crf_toxicity, op11_phrase_tries, op12_chat_tree, op13_zfast_trie)}

TOP_K_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""

CONTAINED_SQL = r"""
WITH lowered AS (
  SELECT 0 AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT kind, id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM lowered),
places AS (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT kind, id, i - 1 AS place, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM places),
items AS (SELECT DISTINCT id AS item_id, s FROM shingles WHERE kind = 1),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY item_id),
hits AS (
  SELECT d.id AS doc_id, i.item_id, count(DISTINCT d.s) AS n_contained, min(d.place) AS first_word
  FROM shingles d JOIN items i ON d.s = i.s WHERE d.kind = 0 GROUP BY d.id, i.item_id)
SELECT doc_id, item_id, n_contained, n_shingles, n_contained / CAST(n_shingles AS DOUBLE) AS containment, first_word
FROM hits JOIN sizes USING (item_id) WHERE n_contained >= 0.8 * n_shingles
"""

PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
f1 AS MATERIALIZED (SELECT lang, x, count(*) AS c FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY lang, x),
spot AS MATERIALIZED (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w),
f2 AS MATERIALIZED (SELECT lang, w[i] AS a1, w[i + 1] AS a2, count(*) AS c FROM spot GROUP BY ALL HAVING count(*) >= 10),
f3 AS MATERIALIZED (
  SELECT lang, w[i] AS a1, w[i + 1] AS a2, w[i + 2] AS a3, count(*) AS c FROM spot WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
longer AS (
  SELECT lang, a1, a2, max(c) AS c FROM (SELECT lang, a1, a2, c FROM f3 UNION ALL SELECT lang, a2, a3, c FROM f3) GROUP BY ALL),
cuts AS (
  SELECT f.lang, f.a1 || ' ' || f.a2 AS phrase, f.c AS a, 1 AS k, p.c AS l, q.c AS r
  FROM f2 f JOIN f1 p ON p.lang = f.lang AND p.x = f.a1 JOIN f1 q ON q.lang = f.lang AND q.x = f.a2
  LEFT JOIN longer g ON g.lang = f.lang AND g.a1 = f.a1 AND g.a2 = f.a2 WHERE g.c IS NULL OR 100 * g.c < 50 * f.c
  UNION ALL
  SELECT f.lang, f.a1 || ' ' || f.a2 || ' ' || f.a3, f.c, 1, p.c, q.c
  FROM f3 f JOIN f1 p ON p.lang = f.lang AND p.x = f.a1 JOIN f2 q ON q.lang = f.lang AND q.a1 = f.a2 AND q.a2 = f.a3
  UNION ALL
  SELECT f.lang, f.a1 || ' ' || f.a2 || ' ' || f.a3, f.c, 2, p.c, q.c
  FROM f3 f JOIN f2 p ON p.lang = f.lang AND p.a1 = f.a1 AND p.a2 = f.a2 JOIN f1 q ON q.lang = f.lang AND q.x = f.a3),
weak AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth
  FROM (SELECT *, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weak WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM ranked JOIN (SELECT lang, sum(c) AS n FROM f1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(regexp_replace(text, '(<)(\\*)(/?s>|</?SYS>>)|(\[)(\\*)(/?(?:INST|ROLE)\])', '\1\4\\\2\5\3\6', 'g')) AS inner_chars,
    length(regexp_replace(role, '(<)(\\*)(/?s>|</?SYS>>)|(\[)(\\*)(/?(?:INST|ROLE)\])', '\1\4\\\2\5\3\6', 'g')) AS name_chars
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(inner_chars + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 19 ELSE 17 + name_chars END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s, c - c % 20 AS opener FROM t),
ids4 AS (
  SELECT c, opener, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(8 * length(s)), lambda i:
    CAST((ascii(s[i // 8 + 1]) >> CAST(i % 8 AS INTEGER)) & 1 AS BIGINT))), lambda a, b: xor(a >> 1, CASE WHEN (xor(a, b) & 1) = 1 THEN 3988292384 ELSE 0 END))) % 4 AS h
  FROM ids),
mixed AS (
  SELECT t.c, 1 AS side, pos, role, text FROM t JOIN ids4 USING (c) WHERE c = opener OR pos > h
  UNION ALL
  SELECT i.c, 0, pos, role, text FROM ids4 i JOIN t ON t.c = i.opener WHERE i.c <> i.opener AND pos <= h),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY side, pos) AS d FROM mixed),
path AS (
  SELECT c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS p
  FROM placed),
member AS (
  SELECT c, d, p, coalesce(lag(p) OVER (PARTITION BY c ORDER BY d), '') AS pp, words FROM path
  UNION ALL SELECT c, 0, '', NULL, 0 FROM ids),
node AS (
  SELECT p, any_value(pp) AS pp, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = m), '')) AS ends_sha256
  FROM (SELECT *, max(d) OVER (PARTITION BY c) AS m FROM member) GROUP BY p),
kids AS (SELECT pp AS p, count(*) AS n FROM node WHERE pp IS NOT NULL GROUP BY pp),
below AS (
  SELECT m.p, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved_tokens
  FROM node x LEFT JOIN kids k ON k.p = x.p JOIN member m ON m.c = x.conv_id AND m.d <= x.depth GROUP BY m.p)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, x.n_convs, coalesce(k.n, 0) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM node x JOIN below b ON b.p = x.p LEFT JOIN kids k ON k.p = x.p LEFT JOIN node u ON u.p = x.pp
"""


def queries():
    def bind(build):
        def run(spark, sf_dir):
            ship(spark)
            return build(spark, sf_dir)
        return run

    return {name: bind(build) for name, build in QUERIES.items()}


def oracle_sql():
    return {"op2_tput_topk": TOP_K_SQL, "op4_minhash_windows": CONTAINED_SQL, "op11_phrase_tries": PHRASES_SQL, "op12_chat_tree": CHAT_SQL,
            "op13_zfast_trie": TRIE_SQL}
