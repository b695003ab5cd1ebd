"""The registered queries of the operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpsieve.llm.audit import audit_filters
from dumpsieve.llm.byte_bpe import encode_documents
from dumpsieve.llm.embeddings import near_vectors
from dumpsieve.llm.exact import exact_groups
from dumpsieve.llm.html import extract_pages
from dumpsieve.llm.language import identify_language
from dumpsieve.llm.lines import drop_repeated_lines
from dumpsieve.llm.minhash import MinHash, near_duplicates
from dumpsieve.llm.packing import pack_documents
from dumpsieve.llm.quality import score_quality
from dumpsieve.llm.secrets import secret_spans
from dumpsieve.llm.shared import table
from dumpsieve.llm.sharding import shard_documents
from dumpsieve.llm.trie import prefix_trie, trie_report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@_query("op1_quality_classifier")
def op1(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _tokenizer(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@_query("op2_byte_bpe")
def op2(spark, sf_dir):
    ranks = _tokenizer("byte_bpe_multi_50k.tiktoken")
    found = encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query("op3_language_id")
def op3(spark, sf_dir):
    return identify_language(table(spark, sf_dir, "documents"))


@_query("op4_best_fit_packing")
def op4(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json").decode("utf-8"))


@_query("op5_secret_scan")
def op5(spark, sf_dir):
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )


@_query(
    "op6_minhash_near_dedup",
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM meets JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * meets.n >= 80 * (x.n + y.n - meets.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least ON least.a = d.doc_id""",
)
def op6(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), MinHash(shingle=2))


@_query(
    "op7_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, first IS NOT NULL AND first <> doc_id AS drop FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN drop THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
)
def op7(spark, sf_dir):
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=2, min_chars=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@_query(
    "op8_exact_dedup",
    r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
best AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-size, doc_id)) AS keep_id FROM rows GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM rows JOIN best USING (text_sha256)""",
)
def op8(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


@_query(
    "op9_embedding_near_dedup",
    r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings LEFT JOIN degree ON degree.a = vec_id JOIN least ON least.a = vec_id""",
)
def op9(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


@_query("op10_html_extraction")
def op10(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


@_query("op11_sharding")
def op11(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"), shards=24, law="rows")


@_query(
    "op12_prefix_trie",
    r"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
    lambda d: list_concat([ord(d)::BIGINT], [0, 0, 0, 0, 0, 0, 0]::BIGINT[])))),
    lambda r, x: xor(xor(r, x) >> 1, 3988292384 * (xor(r, x) & 1))) AS r FROM (SELECT DISTINCT c FROM turns)),
heads AS (SELECT c, c - c % 5 AS b, xor(r, 4294967295) % 9 AS h FROM convs),
joined AS (
  SELECT heads.c, 0 AS side, i, role, text FROM heads JOIN turns ON turns.c = b WHERE i <= h
  UNION ALL SELECT heads.c, 1, i, role, text FROM heads JOIN turns ON turns.c = heads.c WHERE i > h),
built AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY side, i) AS d, role, text FROM joined),
keys AS (
  SELECT c, d, text, string_agg(md5(concat(octet_length(encode(role)), ':', role, text)), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS k FROM built),
path AS (
  SELECT c, d, md5(k) AS k, lag(md5(k), 1, '') OVER (PARTITION BY c ORDER BY d) AS up, octet_length(encode(text)) AS bytes,
    d = max(d) OVER (PARTITION BY c) AS ends FROM keys
  UNION ALL SELECT heads.c, 0, '', NULL, 0, NOT EXISTS (SELECT 1 FROM built WHERE built.c = heads.c) FROM heads),
nodes AS (
  SELECT k, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM path GROUP BY k, d),
tree AS (
  SELECT nodes.*, p.conv_id AS parent_conv_id, coalesce(n, 0) AS n_children FROM nodes
  LEFT JOIN nodes p ON p.k = nodes.up AND p.d = nodes.d - 1
  LEFT JOIN (SELECT up, d - 1 AS d, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY ALL) q ON q.up = nodes.k AND q.d = nodes.d),
below AS (
  SELECT path.k, path.d, sum(CASE WHEN tree.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(tree.saved) AS saved_tokens
  FROM tree JOIN path ON path.c = tree.conv_id AND path.d <= tree.d GROUP BY ALL)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM tree JOIN below USING (k, d)""",
)
def op12(spark, sf_dir):
    return trie_report(prefix_trie(table(spark, sf_dir, "conversations")))


@_query(
    "op13_filter_audit",
    r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, list_filter(string_split_regex(t, '[ 	-
]+'), lambda x: x <> '') AS w FROM texts),
fails AS (
  SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM words),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_sum(list_transform(f, lambda x: x::INT)) AS n
  FROM fails LEFT JOIN said USING (doc_id)),
five AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM five a, five b, five c, five d, five e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, i AS step, o[i] AS filter, o[1:i - 1] AS earlier FROM orders, five),
kinds AS (SELECT part, f, good, toxic, n, count(*) AS docs FROM docs GROUP BY ALL),
counted AS (
  SELECT part, o, step, filter, f[filter] AS fail, len(list_filter(earlier, lambda j: f[j])) > 0 AS gone, good, toxic, n, docs FROM kinds, steps),
summed AS (
  SELECT part, o, step, filter, sum(CASE WHEN NOT gone AND NOT fail THEN docs ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND fail THEN docs ELSE 0 END) AS removed, sum(CASE WHEN gone AND fail THEN docs ELSE 0 END) AS redundant,
    sum(CASE WHEN fail AND n = 1 THEN docs ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fail AND good THEN docs ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND fail AND toxic THEN docs ELSE 0 END) AS toxic_lost FROM counted GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda j: 'ABCDE'[j]), '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM summed""",
)
def op13(spark, sf_dir):
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
