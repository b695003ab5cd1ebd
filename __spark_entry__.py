"""Queries over the benchmark tables, with the SQL that must give the same rows.

Most queries turn whole tables into dump-shaped JSON lines, run an operator on them
and are compared with SQL over the plain columns.  The file queries write such lines
as dump files first and read those.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import dump_fixtures as fx
from dumpsieve.functions import text as tx
from dumpsieve.functions import values as vals
from dumpsieve.functions.json_lines import parse_ndjson
from dumpsieve.functions.regex import re2_search
from dumpsieve.operators import counters
from dumpsieve.operators import projections as pj
from dumpsieve.operators.manifest import export_live, read_manifest, read_output, skip_processed
from dumpsieve.operators.predicates import field_present, file_name_filter, filter_lines, tag_matches
from dumpsieve.operators.value_list import value_list_source
from dumpsieve.plans.csv_run import csv_lines, csv_projection, read_csv_parts, run_csv, write_by_letter
from dumpsieve.plans.filter_run import filter_dump, filter_files, run_filter
from dumpsieve.sources.listing import NoInputError, dump_kind, list_input_files
from dumpsieve.sources.scan import ingest, only_lines, read_staged, scan_dump_lines, shared_folder
from dumpsieve.sources.zst import open_fs
from dumpsieve.specs import CsvSpec, FilterSpec
from dumpsieve.streaming.incremental import stream_filter

try:
    from corpus_pipeline import pipeline
    from dumpsieve.llm.queries import ORACLES as _LLM_ORACLES
    from dumpsieve.llm.queries import QUERIES as _LLM_QUERIES

    _LLM_QUERIES = {**_LLM_QUERIES, "pipeline": pipeline}
except ModuleNotFoundError as missing:  # they, or a module that only they need, are not there: the other queries are
    print(f"without the queries on training text: {missing}", file=sys.stderr)
    _LLM_QUERIES, _LLM_ORACLES = {}, {}

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = sql
        return run

    return add


def entry(spark: SparkSession) -> DataFrame:
    """Submissions of one community as a table."""
    sf_dir = "/root/testdata/sf0.001"
    lines = filter_lines(fx.submissions(spark, sf_dir), FilterSpec("subreddit", "src7"))
    return pj.project_submission(lines)


def queries() -> dict[str, Query]:
    return {**_QUERIES, **_LLM_QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**_ORACLES, **_LLM_ORACLES}


# ---------------------------------------------------------------- SQL pieces

LINE, TALK_LINE = fx.SUBMISSION_LINE_SQL, fx.COMMENT_LINE_SQL
START = fx.START
SUBREDDIT = "CASE WHEN lang = 'en' THEN source ELSE upper(source) END"
AUTHOR = "CASE WHEN lang IN ('de', 'es') THEN '' ELSE 'u/' || lang || '_' || source END"
TITLE = "'\"' || source || '\", ' || n_chars"
URL = "'https://' || source || '.example.com/' || doc_id"
SITE = vals.SITE
CREATED = f"""CASE WHEN lang = 'es' THEN 'None'
  ELSE strftime(make_timestamp(({START} + 3600 * doc_id) * 1000000), '%Y-%m-%d %H:%M') END"""
LINK = f"""CASE WHEN lang = 'en' THEN '{SITE}/r/' || source || '/comments//_/d' || doc_id || '/'
  ELSE '{SITE}/r/' || source || '/comments/' || doc_id || '/x/' END"""
SUBMISSION_ROW = f"""{AUTHOR} AS author, {TITLE} AS title, CAST(n_chars AS VARCHAR) AS score,
  {CREATED} AS created, {LINK} AS link, text AS text, {URL} AS url"""
TALK_CREATED = f"strftime(make_timestamp(({START} - conv_id * 31536000 + turn * 60) * 1000000), '%Y-%m-%d %H:%M')"
TALK_LINK = f"""CASE WHEN role = 'assistant' THEN '{SITE}/r/x/' || conv_id
  ELSE '{SITE}/r/' || role || '/comments/' || conv_id || '/_/c' || conv_id || '_' || turn || '/' END"""
COMMENT_ROW = f"""'u/' || role || conv_id AS author, CAST(turn AS VARCHAR) AS score,
  {TALK_CREATED} AS created, {TALK_LINK} AS link, text AS body"""
BAD = "lang IN ('fr', 'de', 'es')"


def _matching(where: str) -> str:
    return f"SELECT doc_id, {LINE} AS value FROM documents WHERE {where}"


def _both(docs: str, talk: str) -> str:
    """Lines of both kinds under a condition each."""
    return f"""SELECT 'd' || doc_id AS id, {LINE} AS value FROM documents WHERE {docs}
  UNION ALL SELECT 'c' || conv_id || '_' || turn, {TALK_LINE} FROM conversations WHERE {talk}"""


def _with_id(lines: DataFrame) -> DataFrame:
    return lines.select(F.regexp_extract("value", '^..id...([dc][0-9_]+)', 1).alias("id"), "value")


def _filtered(spark: SparkSession, sf_dir: str, spec: FilterSpec) -> DataFrame:
    return filter_lines(fx.submissions(spark, sf_dir), spec).select("doc_id", "value")


# ---------------------------------------------------------------- predicates


@query("filter_exact", _matching("lower(source) = 'src7'"))
def filter_exact(spark, sf_dir):
    return _filtered(spark, sf_dir, FilterSpec("subreddit", "Src7"))


@query("filter_exact_no_ascii_fold", _matching("lower(source) || '.example.com' = 'src11.example.com'"))
def filter_exact_no_ascii_fold(spark, sf_dir):
    # A long s in the value folds to s.
    return _filtered(spark, sf_dir, FilterSpec("domain", "ſRC11.EXAMPLE.COM"))


@query("filter_partial", _matching("contains(lower(text), 'tion des')"))
def filter_partial(spark, sf_dir):
    return _filtered(spark, sf_dir, FilterSpec("selftext", "TION Des", partial=True))


@query("filter_partial_no_ascii", _matching("contains(lower(text), 'éau')"))
def filter_partial_no_ascii(spark, sf_dir):
    return _filtered(spark, sf_dir, FilterSpec("selftext", "ÉAU", partial=True))


@query("filter_regex", _matching(r"regexp_matches(text, '(?i)\bth[a-z]+ing\b.*\.$')"))
def filter_regex(spark, sf_dir):
    return _filtered(spark, sf_dir, FilterSpec("selftext", r"(?i)\bth[a-z]+ing\b.*\.$", regex=True))


@query("filter_regex_plain", _matching(f"regexp_matches({SUBREDDIT}, '^(src|SRC)1[0-5]$')"))
def filter_regex_plain(spark, sf_dir):
    return _filtered(spark, sf_dir, FilterSpec("subreddit", "^(src|SRC)1[0-5]$", regex=True))


_SHORT_SOURCES = """
  SELECT source FROM documents GROUP BY source
  HAVING sum(n_chars) * (SELECT count(*) FROM documents) < count(*) * (SELECT sum(n_chars) FROM documents)"""


@query("filter_value_list", _matching(f"source IN ({_SHORT_SOURCES})"))
def filter_value_list(spark, sf_dir):
    # The sources whose documents are shorter than the average.
    path = shared_folder(spark, "names")
    sql = _SHORT_SOURCES.replace("FROM documents", "FROM {documents}")
    short = spark.sql(sql, documents=fx.table(spark, sf_dir, "documents"))
    short.select(F.initcap("source")).write.option("lineSep", "\n").text(path)
    spec = FilterSpec("subreddit", value_list=path)
    return filter_lines(fx.submissions(spark, sf_dir), spec, value_list_source(spark, path)).select("doc_id", "value")


_EVENT_LINE = "'{\"id\":\"' || event_id || '\",\"subreddit\":\"' || event_type || '\",\"body\":' || to_json(props) || '}'"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("subreddit"), F.col("props").alias("body")
    ))
    return fx.table(spark, sf_dir, "events").select("event_id", line.alias("value"))


@query("filter_events", f"SELECT event_id, {_EVENT_LINE} AS value FROM events WHERE event_type = 'purchase'")
def filter_events(spark, sf_dir):
    return filter_lines(_events(spark, sf_dir), FilterSpec("subreddit", "PURCHASE"))


@query("filter_body", f"SELECT event_id, {_EVENT_LINE} AS value FROM events WHERE regexp_matches(props, ': *[0-9]*7}}')")
def filter_body(spark, sf_dir):
    return filter_lines(_events(spark, sf_dir), FilterSpec("body", ": *[0-9]*7}", regex=True))


@query("field_is_string", _matching("lang NOT IN ('de', 'es')"))
def field_is_string(spark, sf_dir):
    return _filtered(spark, sf_dir, FilterSpec("author", ".*", regex=True))


@query("field_present", _matching("lang <> 'es'"))
def field_is_present(spark, sf_dir):
    parsed = parse_ndjson(fx.submissions(spark, sf_dir), ["author"])
    return parsed.where(field_present(F.col("author"))).select("doc_id", "value")


@query("project_raw_line", f"SELECT doc_id, {LINE} AS value FROM documents")
def project_raw_line(spark, sf_dir):
    return _filtered(spark, sf_dir, FilterSpec("domain", "example.com", partial=True))


# ---------------------------------------------------------------- projections


@query("project_submission", f"SELECT doc_id, {SUBMISSION_ROW} FROM documents")
def project_submission(spark, sf_dir):
    return pj.project_submission(fx.submissions(spark, sf_dir), keep=("doc_id",))


@query("project_comment", f"SELECT conv_id, turn, {COMMENT_ROW} FROM conversations")
def project_comment(spark, sf_dir):
    return pj.project_comment(fx.comments(spark, sf_dir), keep=("conv_id", "turn"))


@query("project_mixed_kinds", f"""
  SELECT {AUTHOR} AS author, CAST(n_chars AS VARCHAR) AS score, {CREATED} AS created, {LINK} AS link, '' AS body
  FROM documents UNION ALL SELECT {COMMENT_ROW} FROM conversations""")
def project_mixed_kinds(spark, sf_dir):
    # One walk over both kinds; comment files come first, so theirs are the columns.
    both = fx.submissions(spark, sf_dir).select("value").union(fx.comments(spark, sf_dir).select("value"))
    return pj.project_comment(both)


@query("union_inputs", f"""
  SELECT 'submission' AS kind, {LINE} AS value FROM documents UNION ALL SELECT 'comment', {TALK_LINE} FROM conversations""")
def union_inputs(spark, sf_dir):
    lines = only_lines(scan_dump_lines(spark, fx.dump(spark, sf_dir)))
    return lines.select(dump_kind(tx.base_name(F.col("file"))).alias("kind"), "value")


def _column(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parsed = parse_ndjson(fx.submissions(spark, sf_dir), pj.keys_for((name,)))
    return parsed.select("doc_id", pj.column(name))


@query("col_author", f"SELECT doc_id, {AUTHOR} AS author FROM documents")
def col_author(spark, sf_dir):
    return _column(spark, sf_dir, "author")


@query("col_created", f"SELECT doc_id, {CREATED} AS created FROM documents")
def col_created(spark, sf_dir):
    return _column(spark, sf_dir, "created")


@query("col_link", f"SELECT doc_id, {LINK} AS link FROM documents")
def col_link(spark, sf_dir):
    return _column(spark, sf_dir, "link")


@query("col_text", "SELECT doc_id, text FROM documents")
def col_text(spark, sf_dir):
    return _column(spark, sf_dir, "text")


@query("col_url", f"SELECT doc_id, {URL} AS url FROM documents")
def col_url(spark, sf_dir):
    return _column(spark, sf_dir, "url")


@query("col_default", f"SELECT doc_id, {TITLE} AS title FROM documents")
def col_default(spark, sf_dir):
    return _column(spark, sf_dir, "title")


@query("link_from_parts", f"""
  SELECT conv_id, turn, '{SITE}/r/' || role || '/comments/' || conv_id || '/_/c' || conv_id || '_' || turn || '/' AS link
  FROM conversations""")
def link_from_parts(spark, sf_dir):
    parsed = parse_ndjson(fx.comments(spark, sf_dir), ["subreddit", "link_id", "id"])
    link = vals.link_from_parts(F.col("subreddit"), F.col("link_id"), F.col("id"))
    return parsed.select("conv_id", "turn", link.alias("link"))


# ---------------------------------------------------------------- scalars


def _records(lines: DataFrame, keep: list[str], key: str, value: Column) -> DataFrame:
    """Lines with one member, decoded again: ``keep`` and the variant ``key``."""
    line = F.to_json(F.struct(value.alias(key)))
    return parse_ndjson(lines.select(*keep, line.alias("value")), [key]).drop("value", "is_bad")


@query("equal_fold", "SELECT doc_id, lower(text) AS folded, lower(source) = 'src12' AS same FROM documents")
def equal_fold(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    same = tx.equals_fold(F.upper("source"), "ſrc12")
    return docs.select("doc_id", tx.fold(F.col("text")).alias("folded"), same.alias("same"))


@query("lower", "SELECT doc_id, lower(text) AS low, contains(lower(text), 'über') AS has FROM documents")
def lower(spark, sf_dir):
    text = F.col("text")
    has = tx.contains_lower(text, "ÜBER")
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.lower_simple(text).alias("low"), has.alias("has"))


@query("regex_search", r"SELECT page_id, regexp_matches(html, '<title>[^<]*(\w+)\W+\d*</title>') AS found FROM pages")
def regex_search(spark, sf_dir):
    found = re2_search(F.col("html"), r"<title>[^<]*(\w+)\W+\d*</title>")
    return fx.table(spark, sf_dir, "pages").select("page_id", found.alias("found"))


@query("parse_created", """
  SELECT event_id, CASE event_type WHEN 'error' THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT)
    WHEN 'view' THEN 0 ELSE CAST(trunc(value * 1000000) AS BIGINT) END AS seconds FROM events""")
def parse_created(spark, sf_dir):
    # A string of digits, a string of anything else, a number with a fraction.
    kind = F.col("event_type")
    held = (
        F.when(kind == "error", fx.variant(F.regexp_extract("props", "[0-9]+", 0)))
        .when(kind == "view", fx.variant(F.col("props")))
        .otherwise(fx.variant(F.col("value") * 1_000_000))
    )
    records = _records(fx.table(spark, sf_dir, "events"), ["event_id"], "created_utc", held)
    return records.select("event_id", vals.parse_created(F.col("created_utc")).alias("seconds"))


@query("format_created", """
  SELECT o_orderkey, strftime(make_timestamp((CAST(floor(o_totalprice * 10000) AS BIGINT) - 2000000000) * 1000000),
    '%Y-%m-%d %H:%M') AS created FROM orders""")
def format_created(spark, sf_dir):
    seconds = F.floor(F.col("o_totalprice") * 10_000) - F.lit(2_000_000_000)
    orders = fx.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", vals.format_created(seconds.cast("bigint")).alias("created"))


@query("trim_prefix", "SELECT o_orderkey, CASE WHEN starts_with(o_orderpriority, '1-') THEN o_orderpriority[3:] ELSE o_orderpriority END AS trimmed FROM orders")
def trim_prefix(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", vals.trim_prefix(F.col("o_orderpriority"), "1-").alias("trimmed"))


@query("fmt_default", "SELECT event_id, regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS score FROM events")
def fmt_default(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    records = _records(events, ["event_id"], "score", F.col("value"))
    return records.select("event_id", vals.default_text(F.col("score")).alias("score"))


@query("fmt_default_exponent", """
  WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey * CAST(10007 AS BIGINT) * l_suppkey AS n FROM lineitem),
  d AS (SELECT *, rtrim(CAST(n AS VARCHAR), '0') AS m, length(CAST(n AS VARCHAR)) - 1 AS e FROM n)
  SELECT l_orderkey, l_linenumber, CASE WHEN n < 1000000 THEN CAST(n AS VARCHAR)
    ELSE m[1] || CASE WHEN length(m) > 1 THEN '.' || m[2:] ELSE '' END || 'e+' || lpad(CAST(e AS VARCHAR), 2, '0') END AS score FROM d""")
def fmt_default_exponent(spark, sf_dir):
    items = fx.table(spark, sf_dir, "lineitem")
    product = F.col("l_partkey") * F.lit(10007).cast("bigint") * F.col("l_suppkey")
    records = _records(items, ["l_orderkey", "l_linenumber"], "score", product)
    return records.select("l_orderkey", "l_linenumber", vals.default_text(F.col("score")).alias("score"))


@query("sanitize_filename", r"""SELECT page_id, regexp_replace(url, '[<>:"/\\|?*\x00-\x1F]', '_', 'g') AS name FROM pages""")
def sanitize_filename(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", tx.sanitize_filename(F.col("url")).alias("name"))


@query("output_name", r"""SELECT page_id, 'RS_' || page_id || '_' || regexp_replace(url, '[<>:"/\\|?*\x00-\x1F]', '_', 'g') || '.zst' AS name FROM pages""")
def output_name(spark, sf_dir):
    file = F.concat(F.lit("RS_"), F.col("page_id").cast("string"), F.lit(".zst"))
    return fx.table(spark, sf_dir, "pages").select("page_id", tx.output_name(file, F.col("url")).alias("name"))


@query("config_hash", "SELECT page_id, sha256('domain:' || url || ':false:true:RS_' || page_id) AS hashed FROM pages")
def config_hash(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    pattern = F.concat(F.lit("RS_"), F.col("page_id").cast("string"))
    hashed = tx.config_hash(F.lit("domain"), F.col("url"), F.lit(False), F.lit(True), pattern)
    return pages.select("page_id", hashed.alias("hashed"))


@query("base_name", r"SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_extract(regexp_extract(url, '[^/]*$'), '\.[^.]*$') AS ext FROM pages")
def base_name(spark, sf_dir):
    url = F.col("url")
    return fx.table(spark, sf_dir, "pages").select("page_id", tx.base_name(url).alias("base"), tx.file_ext(url).alias("ext"))


@query("csv_quote", r"""
  SELECT doc_id, CASE WHEN regexp_matches(text, '[",\r\n]|^[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') OR text = '\.'
    THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS quoted FROM documents""")
def csv_quote(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", vals.csv_quote(F.col("text")).alias("quoted"))


@query("dump_kind", """
  SELECT page_id, CASE WHEN url LIKE 'https://m.%' THEN 'comment' ELSE 'submission' END AS kind FROM pages""")
def kind_of_dump(spark, sf_dir):
    url = F.col("url")
    prefix = F.when(url.like("https://m.%"), "RC_").when(url.like("https:%"), "RS_").otherwise("other_")
    name = F.concat(prefix, F.col("page_id").cast("string"), F.lit(".zst"))
    return fx.table(spark, sf_dir, "pages").select("page_id", dump_kind(name).alias("kind"))


@query("file_name_filter", r"""
  SELECT page_id, regexp_matches('RS_20' || page_id || '.zst', '^RS_20[12][0-9]*\.zst$') AS picked FROM pages""")
def name_filter(spark, sf_dir):
    name = F.concat(F.lit("RS_20"), F.col("page_id").cast("string"), F.lit(".zst"))
    picked = file_name_filter(name, r"^RS_20[12][0-9]*\.zst$")
    return fx.table(spark, sf_dir, "pages").select("page_id", picked.alias("picked"))


# ---------------------------------------------------------------- decoding and counting


@query("parse_ndjson", f"SELECT doc_id, {BAD} AS is_bad FROM documents")
def parse_lines(spark, sf_dir):
    return parse_ndjson(fx.damaged(fx.submissions(spark, sf_dir)), ["id"]).select("doc_id", "is_bad")


@query("bad_line_policy", f"SELECT doc_id, {AUTHOR} AS author FROM documents WHERE NOT ({BAD})")
def bad_line_policy(spark, sf_dir):
    parsed = parse_ndjson(fx.damaged(fx.submissions(spark, sf_dir)), ["author"])
    return parsed.where(~F.col("is_bad")).select("doc_id", pj.column("author"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_matches(fx.damaged(fx.submissions(spark, sf_dir)), FilterSpec("subreddit", "src7"))


@query("count_processed", f"SELECT count(*) AS processed, count(*) FILTER (NOT ({BAD})) AS emitted FROM documents")
def count_processed(spark, sf_dir):
    return _tagged(spark, sf_dir).agg(counters.processed().alias("processed"), counters.emitted().alias("emitted"))


@query("count_matched", f"""
  SELECT source, count(*) FILTER (source = 'src7' AND NOT ({BAD})) AS matched FROM documents GROUP BY source""")
def count_matched(spark, sf_dir):
    return _tagged(spark, sf_dir).groupBy("source").agg(counters.matched().alias("matched"))


@query("count_errors", f"SELECT count(*) FILTER ({BAD}) AS errors FROM documents")
def count_errors(spark, sf_dir):
    return _tagged(spark, sf_dir).agg(counters.errors().alias("errors"))


@query("per_file_stats", f"""
  SELECT name, count(*) AS lines_processed, CAST(0 AS BIGINT) AS bad_lines, CAST(sum(strlen(value) + 1) AS BIGINT) AS bytes_processed
  FROM (SELECT 'RS_' || lang AS name, {LINE} AS value FROM documents
    UNION ALL SELECT 'RC_' || role, {TALK_LINE} FROM conversations) GROUP BY name""")
def per_file_stats(spark, sf_dir):
    lines = only_lines(scan_dump_lines(spark, fx.dump(spark, sf_dir)))
    parsed = parse_ndjson(lines, []).withColumn("name", fx.name_of(F.col("file")))
    return counters.per_file_stats(parsed, "name")


@query("error_rate_gate", f"""
  SELECT count(*) AS processed, count(*) FILTER ({BAD}) AS errors,
    count(*) FILTER ({BAD}) * 100.0 <= count(*) * 5.0 AS passed FROM documents""")
def error_rate_gate(spark, sf_dir):
    return counters.error_rate_gate(_tagged(spark, sf_dir), 5)


# ---------------------------------------------------------------- files


_BOTH_LINES = f"""
  SELECT 'RS_' || lang AS name, count(*) AS lines, CAST(sum(strlen({LINE})) AS BIGINT) AS bytes FROM documents GROUP BY 1
  UNION ALL SELECT 'RC_' || role, count(*), CAST(sum(strlen({TALK_LINE})) AS BIGINT) FROM conversations GROUP BY 1"""


def _per_name(lines: DataFrame) -> DataFrame:
    name = F.regexp_extract("file", "R[SC]_[a-z]+", 0).alias("name")
    return lines.groupBy(name).agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("value")).cast("bigint").alias("bytes")
    )


@query("list_input_files", """
  SELECT DISTINCT 'RS_' || lang AS name, 'submission' AS kind FROM documents
  UNION ALL SELECT DISTINCT 'RC_' || role, 'comment' FROM conversations""")
def listed_files(spark, sf_dir):
    files = list_input_files(spark, fx.dump(spark, sf_dir))
    name = F.regexp_extract("file_name", "R[SC]_[a-z]+", 0)
    return files.select(name.alias("name"), dump_kind(F.col("file_name")).alias("kind")).distinct()


@query("scan_dump_lines", f"SELECT lang, {LINE} AS value FROM documents")
def scan_lines(spark, sf_dir):
    lines = only_lines(scan_dump_lines(spark, fx.dump(spark, sf_dir), "^RS_"))
    return lines.select(fx.label_of(F.col("file")).alias("lang"), "value")


@query("scan_comment_lines", f"SELECT {COMMENT_ROW} FROM conversations")
def scan_comment_lines(spark, sf_dir):
    return pj.project_comment(only_lines(scan_dump_lines(spark, fx.dump(spark, sf_dir), "^RC_")))


@query("scan_long_window", _BOTH_LINES)
def scan_long_window(spark, sf_dir):
    root = fx.dump(spark, sf_dir, window_log=28)  # 256 MiB, past what the JVM reader takes
    return _per_name(only_lines(scan_dump_lines(spark, root)))


@query("scan_single_file", "SELECT count(*) AS lines FROM documents WHERE lang = 'en'")
def scan_single_file(spark, sf_dir):
    files = list_input_files(spark, fx.dump(spark, sf_dir), "^RS_en").select("path").collect()
    parts = [only_lines(scan_dump_lines(spark, f.path)) for f in files]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.agg(F.count("*").alias("lines"))


@query("line_length_guard", "SELECT count(*) AS lines, count(*) AS within FROM documents")
def line_length_guard(spark, sf_dir):
    lines = only_lines(scan_dump_lines(spark, fx.dump(spark, sf_dir), "^RS_"))
    within = F.count_if(F.octet_length("value") < 10 << 20)
    return lines.agg(F.count("*").alias("lines"), within.alias("within"))


@query("ingest", _BOTH_LINES)
def ingest_dump(spark, sf_dir):
    dest = shared_folder(spark, "ingest")
    ingest(spark, fx.dump(spark, sf_dir), dest)
    return _per_name(only_lines(read_staged(spark, dest)))


@query("value_list_source", "SELECT DISTINCT url AS item FROM pages WHERE url <> ''")
def read_value_list(spark, sf_dir):
    path = shared_folder(spark, "urls")
    fx.table(spark, sf_dir, "pages").select("url").write.option("lineSep", "\n").text(path)
    return value_list_source(spark, path).items


SPEC = FilterSpec("subreddit", "^(?i:src7|user)$", regex=True)
_MATCHED_LINES = _both("source = 'src7'", "role = 'user'")
_MATCHED_FILES = """
  SELECT 'RS_' || lang AS name, count(*) FILTER (source = 'src7') AS match_count, count(*) AS total_lines
  FROM documents GROUP BY lang
  UNION ALL SELECT 'RC_' || role, count(*) FILTER (role = 'user'), count(*) FROM conversations GROUP BY role"""


def _by_name(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy(fx.name_of(F.col("file")).alias("name")).agg(
        F.sum("match_count").cast("bigint").alias("match_count"),
        F.sum("total_lines").cast("bigint").alias("total_lines"),
    )


def _output_lines(spark: SparkSession, output: str) -> DataFrame:
    return _with_id(read_output(spark, output))


@query("filter_dump", _MATCHED_LINES)
def filter_whole_dump(spark, sf_dir):
    return _with_id(filter_dump(spark, fx.dump(spark, sf_dir), SPEC))


@query("sink_filtered_ndjson", _MATCHED_LINES)
def sink_filtered_ndjson(spark, sf_dir):
    output = shared_folder(spark, "filtered")
    run_filter(spark, fx.dump(spark, sf_dir), output, SPEC)
    return _output_lines(spark, output)


@query("sink_split_by_letter", f"""
  SELECT lang[1] AS letter, {LINE} AS value FROM documents WHERE lang IN ('en', 'fr')
  UNION ALL SELECT role[1], {TALK_LINE} FROM conversations WHERE contains(role, 's')""")
def sink_split_by_letter(spark, sf_dir):
    # A run without letters under the same value comes first: its outputs are not live any more.
    output, root = shared_folder(spark, "letters"), fx.dump(spark, sf_dir)
    run_filter(spark, root, output, FilterSpec("author", "s", partial=True))
    run_filter(spark, root, output, FilterSpec("author", "s", partial=True, split_by_letter=True))
    return read_output(spark, output).select(F.split_part("file", F.lit("/"), F.lit(1)).alias("letter"), "value")


@query("export_outputs", _MATCHED_LINES)
def export_outputs(spark, sf_dir):
    # Plain files under the outputs' own names, read like any dump.
    output, dest = shared_folder(spark, "filtered"), shared_folder(spark, "exported")
    run_filter(spark, fx.dump(spark, sf_dir), output, SPEC)
    export_live(spark, output, dest)
    return _with_id(only_lines(scan_dump_lines(spark, dest)))


@query("table_by_letter", f"SELECT left(lang, 1) AS letter, count(*) AS n FROM documents GROUP BY 1")
def table_by_letter(spark, sf_dir):
    path = shared_folder(spark, "by-letter")
    write_by_letter(fx.submissions(spark, sf_dir), "lang", path)
    return spark.read.parquet(path).groupBy("letter").agg(F.count("*").alias("n"))


_TABLE = f"""SELECT {SUBMISSION_ROW} FROM documents
  UNION ALL SELECT author, '' AS title, score, created, link, '' AS text, '' AS url FROM (SELECT {COMMENT_ROW} FROM conversations)"""


@query("sink_csv", _TABLE)
def sink_csv(spark, sf_dir):
    output = shared_folder(spark, "csv")
    run_csv(spark, fx.dump(spark, sf_dir), output, CsvSpec(exact=False))
    table = spark.read.options(header=True, multiLine=True, quote='"', escape='"', nullValue="\u0000", lineSep="\n")
    return table.csv(f"{output}/output.csv").na.fill("")


@query("sink_csv_default", _TABLE)
def sink_csv_default(spark, sf_dir):
    # The one table of a default run, read back from its parts.
    (report,) = run_csv(spark, fx.dump(spark, sf_dir), shared_folder(spark, "csv"))
    return read_csv_parts(spark, report.path)


@query("sink_csv_per_kind", f"""
  SELECT author, score, created, link, text AS body, 0 AS errors FROM (SELECT {SUBMISSION_ROW} FROM documents)
  UNION ALL SELECT author, score, created, link, body, 0 FROM (SELECT {COMMENT_ROW} FROM conversations)""")
def sink_csv_per_kind(spark, sf_dir):
    first, second = run_csv(spark, fx.dump(spark, sf_dir), shared_folder(spark, "csv"), CsvSpec(per_kind=True))
    names = ("author", "score", "created", "link")
    tables = [read_csv_parts(spark, r.path) for r in (first, second)]
    parts = [t.select(*names, F.col(t.columns[-1] if "body" in t.columns else "text").alias("body")) for t in tables]
    return parts[0].union(parts[1]).withColumn("errors", F.lit(first.errors + second.errors))


@query("csv_failure_policy", f"""
  SELECT {SUBMISSION_ROW}, true AS torn FROM documents WHERE lang = 'es'
  UNION ALL SELECT author, '', score, created, link, '', '', true FROM (SELECT {COMMENT_ROW} FROM conversations)""")
def csv_failure_policy(spark, sf_dir):
    # Some files end in something that is no frame: the rows in front of that stay, in one table with the whole files.
    root, damaged = fx.dump(spark, sf_dir), shared_folder(spark, "torn")
    files = list_input_files(spark, root, "^(RC_|RS_es)").select("file", "path", "length")

    def copy(row) -> None:
        source, name = open_fs(row.path)
        target, folder = open_fs(damaged)
        target.create_dir(f"{folder}/{row.file}".rsplit("/", 1)[0], recursive=True)
        with target.open_output_stream(f"{folder}/{row.file}", compression=None) as write:
            with source.open_input_file(name) as read:
                while data := read.read(1 << 20):
                    write.write(data)
            if "RS_es" in row.file:
                write.write(b"no frame")

    files.foreach(copy)
    (report,) = run_csv(spark, damaged, shared_folder(spark, "csv"), split_bytes=16 << 10)
    return read_csv_parts(spark, report.path).withColumn("torn", F.lit(report.errors > 0))


@query("sink_csv_exact", rf"""
  WITH t AS (SELECT {SUBMISSION_ROW} FROM documents)
  SELECT concat_ws(',', author, '"' || replace(title, '"', '""') || '"', score, created, link,
    CASE WHEN regexp_matches(text, '[",\r\n]|^[\s\x{{A0}}\x{{3000}}]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END, url) AS value
  FROM t""")
def sink_csv_exact(spark, sf_dir):
    return csv_lines(pj.project_submission(fx.submissions(spark, sf_dir)))


@query("csv_projection", _TABLE)
def csv_of_dump(spark, sf_dir):
    # The walk meets a submission file first: its columns serve the comments too.
    return csv_projection(spark, fx.dump(spark, sf_dir))


_STARTS = "SELECT DISTINCT replace(left(split_part(text, chr(10), 1), 30), '.', '[.]') AS item FROM {benchmark}"
_START = _STARTS.format(benchmark="benchmark").replace("replace(", "(").replace(", '.', '[.]')", ")")


def _starts(spark, sf_dir, sql) -> str:
    path = shared_folder(spark, "starts")
    spark.sql(sql.replace("FROM benchmark", "FROM {benchmark}"), benchmark=fx.table(spark, sf_dir, "benchmark")).where("item <> ''").write.text(path)
    return path


@query("filter_value_list_partial", _matching(f"EXISTS (SELECT 1 FROM ({_START}) WHERE item <> '' AND contains(lower(text), lower(item)))"))
def filter_value_list_partial(spark, sf_dir):
    # The beginnings of the benchmark's items, anywhere in a text.
    path = _starts(spark, sf_dir, _START.replace("split_part(text, chr(10), 1)", "split_part(text, '\n', 1)"))
    spec = FilterSpec("selftext", value_list=path, partial=True)
    return filter_lines(fx.submissions(spark, sf_dir), spec, value_list_source(spark, path)).select("doc_id", "value")


_PASSAGES = "SELECT DISTINCT item FROM (SELECT {lines} AS item FROM {documents} WHERE lang <> 'en') WHERE contains(item, ' ')"


@query("filter_value_list_passages", _matching(
    "EXISTS (SELECT 1 FROM (" + _PASSAGES.format(lines="unnest(string_split(text, chr(10)))", documents="documents")
    + ") WHERE contains(lower(documents.text), lower(item)))"))
def filter_value_list_passages(spark, sf_dir):
    # Whole lines, more than one automaton should hold, anywhere in a text.
    path = shared_folder(spark, "passages")
    sql = _PASSAGES.replace("{lines}", r"explode(split(text, '\n'))")
    spark.sql(sql, documents=fx.table(spark, sf_dir, "documents")).write.text(path)
    spec = FilterSpec("selftext", value_list=path, partial=True)
    return filter_lines(fx.submissions(spark, sf_dir), spec, value_list_source(spark, path)).select("doc_id", "value")


@query("filter_value_list_regex", _matching(
    f"EXISTS (SELECT 1 FROM ({_STARTS.format(benchmark='benchmark')}) WHERE item <> '' AND regexp_matches(text, item))"))
def filter_value_list_regex(spark, sf_dir):
    path = _starts(spark, sf_dir, _STARTS.replace("{benchmark}", "benchmark").replace("chr(10)", "'\n'"))
    spec = FilterSpec("selftext", value_list=path, regex=True)
    return filter_lines(fx.submissions(spark, sf_dir), spec, value_list_source(spark, path)).select("doc_id", "value")


_ONE_SPACE = "regexp_replace({}, ' +', ' ', 'g')"


@query("filter_value_list_patterns", _matching(
    "EXISTS (SELECT 1 FROM (" + _PASSAGES.format(lines="unnest(string_split(text, chr(10)))", documents="documents")
    + f") WHERE contains({_ONE_SPACE.format('documents.text')}, {_ONE_SPACE.format('item')}))"))
def filter_value_list_patterns(spark, sf_dir):
    # Whole lines as regular expressions that take any number of spaces, more than one expression should hold.
    path = shared_folder(spark, "line-patterns")
    lines = spark.sql(_PASSAGES.replace("{lines}", r"explode(split(text, '\n'))"), documents=fx.table(spark, sf_dir, "documents"))
    quoted = F.regexp_replace("item", r"([\\\[\]{}().*+?^$|])", r"\\$1")
    lines.select(F.regexp_replace(quoted, " +", " +")).write.text(path)
    spec = FilterSpec("selftext", value_list=path, regex=True)
    return filter_lines(fx.submissions(spark, sf_dir), spec, value_list_source(spark, path)).select("doc_id", "value")


@query("parse_deep_lines", "SELECT doc_id, doc_id % 2 = 1 AS is_bad, text FROM documents")
def parse_deep_lines(spark, sf_dir):
    # A key that nobody reads nests to the limit, or one level beyond.
    docs = fx.table(spark, sf_dir, "documents")
    depth = F.when(F.col("doc_id") % 2 == 1, 10_000).otherwise(9_999)
    line = F.concat(
        F.lit('{"deep":'), F.repeat(F.lit("["), depth), F.repeat(F.lit("]"), depth), F.lit(","),
        F.substring(F.to_json(F.struct(F.col("text").alias("read"))), 2, 1 << 30),
    )
    parsed = parse_ndjson(docs.select("doc_id", "text", line.alias("value")), ["read"])
    return parsed.select("doc_id", "is_bad", "text")


@query("parse_long_numbers", "SELECT doc_id, doc_id % 2 = 1 AS is_bad, CASE WHEN doc_id % 2 = 0 THEN text END AS text FROM documents")
def parse_long_numbers(spark, sf_dir):
    # Thousands of digits are a number; where they stand for more than a double holds, the line is bad.
    docs = fx.table(spark, sf_dir, "documents")
    number = F.concat(F.when(F.col("doc_id") % 2 == 1, "").otherwise("0."), F.repeat(F.lit("7"), F.lit(3_000)))
    line = F.concat(F.lit('{"long":'), number, F.lit(","), F.substring(F.to_json(F.struct(F.col("text").alias("read"))), 2, 1 << 30))
    parsed = parse_ndjson(docs.select("doc_id", line.alias("value")), ["read"])
    read = F.when(~F.col("is_bad"), F.col("read").cast("string"))
    return parsed.select("doc_id", "is_bad", read.alias("text"))


# ---------------------------------------------------------------- incremental runs


@query("sink_manifest", _MATCHED_FILES)
def sink_manifest(spark, sf_dir):
    output = shared_folder(spark, "manifest")
    return _by_name(run_filter(spark, fx.dump(spark, sf_dir), output, SPEC).files)


@query("incremental_filter", _MATCHED_FILES)
def incremental_filter(spark, sf_dir):
    # Files of some languages, then all: each file is read once.
    output = shared_folder(spark, "incremental")
    root = fx.dump(spark, sf_dir)
    filter_files(spark, list_input_files(spark, root, "_(en|fr|user)"), output, SPEC)
    filter_files(spark, list_input_files(spark, root), output, SPEC)
    return _by_name(read_manifest(spark, output))


@query("read_manifest", _MATCHED_FILES)
def manifest_of_run(spark, sf_dir):
    output = shared_folder(spark, "runs")
    run_filter(spark, fx.dump(spark, sf_dir), output, SPEC)
    return _by_name(read_manifest(spark, output))


@query("state_key", """
  SELECT 'talk/RC_' || role AS name, count(*) FILTER (contains(lower(text), 'ed')) AS match_count FROM conversations GROUP BY role""")
def state_key(spark, sf_dir):
    # The manifest knows files by their path below the input.
    output = shared_folder(spark, "keys")
    spec = FilterSpec("body", "ed", partial=True, file_filter="^RC_")
    files = run_filter(spark, fx.dump(spark, sf_dir), output, spec).files
    name = F.regexp_extract("file", "^talk/RC_[a-z]+", 0)
    return files.groupBy(name.alias("name")).agg(F.sum("match_count").cast("bigint").alias("match_count"))


@query("skip_processed_files", """
  SELECT DISTINCT 'RS_' || lang AS name FROM documents WHERE lang NOT IN ('en', 'fr')
  UNION SELECT 'RC_' || role FROM conversations WHERE role <> 'user'""")
def skip_processed_files(spark, sf_dir):
    output, root = shared_folder(spark, "skip"), fx.dump(spark, sf_dir)
    filter_files(spark, list_input_files(spark, root, "_(en|fr|user)"), output, SPEC)
    todo = skip_processed(list_input_files(spark, root), read_manifest(spark, output), SPEC.config_hash())
    return todo.select(fx.name_of(F.col("file")).alias("name")).distinct()


_ALL_LINES = "(SELECT doc_id FROM documents UNION ALL SELECT conv_id FROM conversations)"


@query("zero_match_reprocess", f"SELECT count(*) AS total_lines, CAST(0 AS BIGINT) AS reread FROM {_ALL_LINES}")
def zero_match_reprocess(spark, sf_dir):
    # Files without a match are recorded too, so a second run has nothing to read.
    output = shared_folder(spark, "zero")
    spec = FilterSpec("subreddit", "no such community")
    root = fx.dump(spark, sf_dir)
    run_filter(spark, root, output, spec)
    reread = run_filter(spark, root, output, spec).processed
    totals = read_manifest(spark, output).agg(F.sum("total_lines").cast("bigint").alias("total_lines"))
    return totals.withColumn("reread", F.lit(reread).cast("bigint"))


@query("stream_filter", _MATCHED_LINES)
def filter_stream(spark, sf_dir):
    output, checkpoint = shared_folder(spark, "stream"), shared_folder(spark, "stream-state")
    stream_filter(spark, fx.dump(spark, sf_dir), output, SPEC, checkpoint, max_files=2).awaitTermination()
    return _output_lines(spark, output)


def _cut(spark: SparkSession, root: str, names: str) -> str:
    """A copy of the dump in which the files so named end in the middle."""
    damaged = shared_folder(spark, "damaged")
    files = list_input_files(spark, root).select("file", "path", "length")

    def copy(row) -> None:
        source, name = open_fs(row.path)
        target, folder = open_fs(damaged)
        target.create_dir(f"{folder}/{row.file}".rsplit("/", 1)[0], recursive=True)
        left = row.length // 2 if names in row.file else row.length
        with source.open_input_file(name) as read, target.open_output_stream(f"{folder}/{row.file}", compression=None) as write:
            while left and (data := read.read(min(left, 1 << 20))):
                write.write(data)
                left -= len(data)

    files.foreach(copy)
    return damaged


@query("rerun_after_change", _both("source = 'src1'", "false"))
def rerun_after_change(spark, sf_dir):
    # Other settings in between replace the output, so the first settings run again.
    output, root = shared_folder(spark, "changed"), fx.dump(spark, sf_dir)
    exact = FilterSpec("subreddit", "src1")
    for spec in (exact, FilterSpec("subreddit", "src1", partial=True), exact):
        run_filter(spark, root, output, spec)
    return _output_lines(spark, output)


@query("rerun_without_match", _both("regexp_matches(source, 'src1.') AND lang NOT IN ('en', 'fr')", "false"))
def rerun_without_match(spark, sf_dir):
    # As a whole value the pattern matches nothing: the files of the second run have no output any more.
    output, root = shared_folder(spark, "without"), fx.dump(spark, sf_dir)
    run_filter(spark, root, output, FilterSpec("subreddit", "(?i)src1.", regex=True))
    run_filter(spark, root, output, FilterSpec("subreddit", "(?i)src1.", file_filter="_(en|fr|user)"))
    return _output_lines(spark, output)


@query("rerun_with_failure", _both("lang = 'en'", "role <> 'user'"))
def rerun_with_failure(spark, sf_dir):
    # The second run cannot read some files: what the first made of them is not live any more.
    output, root = shared_folder(spark, "failing"), fx.dump(spark, sf_dir)
    run_filter(spark, root, output, FilterSpec("author", "S", partial=True))
    run_filter(spark, _cut(spark, root, "RS_fr"), output, FilterSpec("author", "S", regex=True, file_filter="RS_fr"))
    run_filter(spark, _cut(spark, root, "RC_user"), output, FilterSpec("author", "S", regex=True, file_filter="RC_user"))
    return _output_lines(spark, output)


@query("stream_retries", _MATCHED_LINES)
def stream_retries(spark, sf_dir):
    # Files that cannot be read in one call are mended before the next, in which other files arrive.
    root, output, state = fx.dump(spark, sf_dir), shared_folder(spark, "retried"), shared_folder(spark, "retry-state")
    damaged = _cut(spark, root, "_en")
    files = list_input_files(spark, root)
    (fs, folder), late = open_fs(damaged), files.where("file_name LIKE 'RC_user%'").select("file", "path").collect()
    for row in late:
        fs.delete_file(f"{folder}/{row.file}")
    stream_filter(spark, damaged, output, SPEC, state).awaitTermination()
    for row in [*late, *files.where("file_name LIKE 'RS_en%' OR file LIKE '%RS_en.zst/%'").select("file", "path").collect()]:
        source, name = open_fs(row.path)
        fs.create_dir(f"{folder}/{row.file}".rsplit("/", 1)[0], recursive=True)
        with source.open_input_file(name) as read, fs.open_output_stream(f"{folder}/{row.file}", compression=None) as write:
            write.write(read.read())
    stream_filter(spark, damaged, output, SPEC, state).awaitTermination()
    return _output_lines(spark, output)


@query("no_new_files", f"SELECT *, CAST(0 AS BIGINT) AS again FROM ({_MATCHED_FILES})")
def no_new_files(spark, sf_dir):
    output = shared_folder(spark, "again")
    run_filter(spark, fx.dump(spark, sf_dir), output, SPEC)
    again = run_filter(spark, fx.dump(spark, sf_dir), output, SPEC).new_files
    return _by_name(read_manifest(spark, output)).withColumn("again", F.lit(again).cast("bigint"))


@query("no_input_error", f"SELECT count(*) AS lines, true AS refused FROM {_ALL_LINES}")
def no_input_error(spark, sf_dir):
    # The dump holds lines, but no file whose name the pattern meets.
    root, refused = fx.dump(spark, sf_dir), False
    try:
        run_filter(spark, root, shared_folder(spark, "none"), FilterSpec("author", "x", file_filter="^nothing"))
    except NoInputError:
        refused = True
    return only_lines(scan_dump_lines(spark, root)).agg(F.count("*").alias("lines")).withColumn("refused", F.lit(refused))


@query("file_failure_policy", _both("source = 'src7' AND lang <> 'es'", "role = 'user'"))
def file_failure_policy(spark, sf_dir):
    # The files of one language end in the middle: nothing of them is published.
    output = shared_folder(spark, "published")
    run_filter(spark, _cut(spark, fx.dump(spark, sf_dir), "RS_es"), output, SPEC)
    return _output_lines(spark, output)
