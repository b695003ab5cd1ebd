"""Exact duplicates: a two-pass Bloom filter lets rows without a copy pass without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpsieve.llm.shared import WHITE, bitmap_of, bloom_bits, bloom_position, passes_bloom, stored

_SEEDS = (11, 12)


def text_key(text: Column) -> Column:
    """SHA-256 of the text without ASCII white space; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, ""), 256)


def _maybe_repeated(rows: DataFrame, keys: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``maybe``: false only for keys that occur once.

    First pass: positions that two or more rows of ``keys`` hit, counted with partial
    sums, become a bitmap of at most ``bits / 8`` bytes. Second pass: a row with an unset
    bit has no copy.
    """
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), bloom_position(F.col("key"), s, bits).alias("position")) for s in _SEEDS]))
    hits = keys.select(each.alias("hit")).select("hit.position", "hit.s").groupBy("position", "s").count()
    bitmap = stored(bitmap_of(hits.filter("count > 1").select("position")), "bloom")
    return passes_bloom(rows, F.col("key"), bitmap, _SEEDS, bits)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same without ASCII white space; null is the empty
    text, and empty texts are copies of each other. The longest original stays, then the
    smallest id, null ids last; of rows that repeat with their id exactly one is kept.
    An empty table gives an empty result; other columns are not read.
    """
    text = F.col(text_col)
    keys = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_key(text).alias("key"),
        F.coalesce(F.char_length(text), F.lit(0)).alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = stored(keys, "exact-keys")
    bits = bloom_bits(keys.count())
    flagged = _maybe_repeated(keys, keys, bits)
    alone = flagged.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("key").alias("text_sha256"),
    )
    again = flagged.filter("maybe")
    # A struct's fields compare in turn: longest, then an id, the smallest, and one row.
    order = F.struct(-F.col("size"), F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "row")
    groups = again.groupBy("key").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
    groups = groups.select(
        F.col("key").alias("text_sha256"), "group_size", F.col("best.row").alias("best_row"),
        F.when(~F.col("best.col2"), F.col("best.col3")).alias("keep_id"),
    )
    joined = again.join(groups, F.col("key") == F.col("text_sha256")).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("best_row")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(joined)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; rules as in :func:`exact_groups`."""
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_key(F.col(text_col)).alias("key")
    )
    keys = stored(whole.select("key"), "exact-keys")
    flagged = _maybe_repeated(whole, keys, bloom_bits(keys.count()))
    doc = F.col("doc")
    order = F.struct(
        -F.coalesce(F.char_length(doc[text_col]), F.lit(0)), doc[id_col].isNull(), F.coalesce(doc[id_col], F.lit(0))
    )
    again = flagged.filter("maybe").groupBy("key").agg(F.min_by("doc", order).alias("doc"))
    return flagged.filter(~F.col("maybe")).select("doc").unionByName(again.select("doc")).select("doc.*")
