"""From raw documents to packed sequences: five stages, each one operator of the library.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, the table that the stage
before has written. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpsieve.llm.exact import drop_exact_copies
from dumpsieve.llm.minhash import MinHash, drop_near_copies
from dumpsieve.llm.packing import pack_documents
from dumpsieve.llm.quality import keep_good
from dumpsieve.llm.secrets import redact_secrets
from dumpsieve.llm.shared import stored

#: SQL cannot express a trained classifier; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays."""
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 on five-word shingles, the one of the smallest id stays."""
    return drop_near_copies(docs, MinHash(shingle=5, percent=80))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, also encoded ones, are replaced by a mark; n_chars follows the text."""
    return redact_secrets(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return pack_documents(docs, file.read())


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
