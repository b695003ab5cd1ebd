"""Dump-shaped JSON lines built from the benchmark tables, over all their rows.

Which records miss a key, or hold a value of another type, follows from the data
(language, role), so that the same rule can be written in SQL over the plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpsieve.plans.filter_run import write_lines
from dumpsieve.sources.scan import shared_folder

START = 1_700_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def variant(x: Column) -> Column:
    return x.cast("variant")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, value``: one submission line per document."""
    lang, source, doc = F.col("lang"), F.col("source"), F.col("doc_id").cast("string")
    created = F.lit(START) + F.col("doc_id") * 3600
    line = F.to_json(F.struct(
        F.concat(F.lit("d"), doc).alias("id"),
        F.when(lang == "en", source).otherwise(F.upper(source)).alias("subreddit"),
        F.when(lang == "de", variant(F.col("n_chars")))
        .when(lang != "es", variant(F.concat_ws("_", lang, source))).alias("author"),
        F.concat(F.lit('"'), source, F.lit('", '), F.col("n_chars").cast("string")).alias("title"),
        F.col("text").alias("selftext"),
        F.concat(source, F.lit(".example.com")).alias("domain"),
        F.col("n_chars").alias("score"),
        F.when(lang == "fr", variant(created.cast("string")))
        .when(lang != "es", variant(created)).alias("created_utc"),
        F.when(lang != "en", F.concat(F.lit("/r/"), source, F.lit("/comments/"), doc, F.lit("/x/"))).alias("permalink"),
        F.concat(F.lit("https://"), source, F.lit(".example.com/"), doc).alias("url"),
    ))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", line.alias("value"))


# The same lines in SQL, from the same columns.
SUBMISSION_LINE_SQL = f"""
  '{{"id":"d' || doc_id
  || '","subreddit":"' || CASE WHEN lang = 'en' THEN source ELSE upper(source) END || '"'
  || CASE lang WHEN 'de' THEN ',"author":' || n_chars WHEN 'es' THEN '' ELSE ',"author":"' || lang || '_' || source || '"' END
  || ',"title":' || to_json('"' || source || '", ' || n_chars)::VARCHAR
  || ',"selftext":' || to_json(text)::VARCHAR
  || ',"domain":"' || source || '.example.com","score":' || n_chars
  || CASE lang WHEN 'es' THEN '' WHEN 'fr' THEN ',"created_utc":"' || ({START} + 3600 * doc_id) || '"'
     ELSE ',"created_utc":' || ({START} + 3600 * doc_id) END
  || CASE WHEN lang = 'en' THEN '' ELSE ',"permalink":"/r/' || source || '/comments/' || doc_id || '/x/"' END
  || ',"url":"https://' || source || '.example.com/' || doc_id || '"}}'"""


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, role, value``: one comment line per conversation turn."""
    conv, turn, role = F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("role")
    line = F.to_json(F.struct(
        F.concat(F.lit("c"), conv, F.lit("_"), turn).alias("id"),
        F.when(role == "system", conv).otherwise(F.concat(F.lit("t3_"), conv)).alias("link_id"),
        role.alias("subreddit"),
        F.concat(role, conv).alias("author"),
        F.col("text").alias("body"),
        F.col("turn").alias("score"),
        (F.lit(START) - F.col("conv_id") * 86_400 * 365 + F.col("turn") * 60).alias("created_utc"),
        F.when(role == "assistant", F.concat(F.lit("/r/x/"), conv)).alias("permalink"),
    ))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", line.alias("value"))


COMMENT_LINE_SQL = f"""
  '{{"id":"c' || conv_id || '_' || turn || '","link_id":"' || CASE WHEN role = 'system' THEN '' ELSE 't3_' END || conv_id
  || '","subreddit":' || to_json(role)::VARCHAR || ',"author":' || to_json(role || conv_id)::VARCHAR
  || ',"body":' || to_json(text)::VARCHAR || ',"score":' || turn
  || ',"created_utc":' || ({START} - conv_id * 31536000 + turn * 60)
  || CASE WHEN role = 'assistant' THEN ',"permalink":"/r/x/' || conv_id || '"' ELSE '' END || '}}'"""


def damaged(lines: DataFrame) -> DataFrame:
    """Submission lines, damaged in a way that depends on their language."""
    v, lang = F.col("value"), F.col("lang")
    broken = (
        F.when(lang == "fr", F.concat(v, F.lit(" junk}")))  # text behind the object
        .when(lang == "de", F.concat(v, F.lit(","), v))  # two objects
        .when(lang == "es", F.replace(v, F.lit('"score":'), F.lit('"score":0')))  # leading zero
        .otherwise(v)
    )
    return lines.withColumn("value", broken)


_written: dict[tuple, str] = {}


def dump(spark: SparkSession, sf_dir: str, window_log: int | None = None) -> str:
    """Folder with these lines as dump files by language and role, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, window_log)
    if key not in _written:
        root = shared_folder(spark, "dump")
        docs = submissions(spark, sf_dir).select(F.concat(F.lit("RS_"), "lang", F.lit(".zst")).alias("out"), "value")
        talk = comments(spark, sf_dir).select(F.concat(F.lit("talk/RC_"), "role", F.lit(".zst")).alias("out"), "value")
        write_lines(docs.union(talk), root, window_log)
        _written[key] = root
    return _written[key]


def label_of(file: Column) -> Column:
    """Language or role in the name of a file of the dump."""
    return F.regexp_extract(file, r"R[SC]_([a-z]+)", 1)


def name_of(file: Column) -> Column:
    """The same with the prefix of the kind."""
    return F.regexp_extract(file, r"R[SC]_[a-z]+", 0)
