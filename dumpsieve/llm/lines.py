"""Lines that repeat across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpsieve.llm.scan import join_counted
from dumpsieve.llm.shared import LOWER, UPPER, WHITE, stored


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10
) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept (the text that stays), n_lines, n_dropped.

    A line's key has no white space around it and A-Z lower-cased. Keys of ``min_chars``
    code points or more in at least ``min_docs`` documents keep their lines only in the
    document of the smallest id (there all of them). Null is the empty text, one empty
    line. Rows with the same id are one document; each row with a null id is a document of
    its own, and all of these come last, in the order of the table. Lines and texts of any
    length are taken whole. An empty table gives an empty result; other columns are not read.

    Texts are split into lines once, of which hash, row and position are written; these
    narrow rows are counted, and joined to what was found to repeat. Only texts that lose a
    line meet their positions and are put together again. ``docs`` should be a written
    table: it is read again, and rows must come in the same order.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    lines = rows.select("doc", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("line")).filter(F.char_length("line") >= min_chars)
    keys = stored(lines.select("doc", "row", "pos", F.unhex(F.md5(F.col("line").cast("binary"))).alias("key")), "line-keys")

    # Ids, and rows without one, of the first and last document of a key.
    nameless = F.when(F.col("doc").isNull(), F.col("row"))
    found = keys.groupBy("key").agg(
        F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high"),
        F.min(nameless).alias("low_row"), F.max(nameless).alias("high_row"),
        *([] if min_docs <= 2 else [F.count_distinct(F.struct("doc", nameless)).alias("docs")]),
    )
    if min_docs <= 2:
        several = (F.col("low") < F.col("high")) | (F.col("low_row") < F.col("high_row")) | (F.col("low").isNotNull() & F.col("low_row").isNotNull())
    else:
        several = F.col("docs") >= min_docs
    repeated = stored(found.filter(F.coalesce(several, F.lit(False))).select("key", "n", "low", "low_row"), "repeated-lines")
    lost = F.when(F.col("low").isNull(), F.col("row") != F.col("low_row")).otherwise(~F.col("doc").eqNullSafe(F.col("low")))
    losses = join_counted(keys, repeated, ["key"], "n", keys.count()).filter(lost)
    # As many positions as the text has lines at most.
    losses = losses.groupBy("row").agg(F.collect_list("pos").alias("drop"))
    met = rows.join(losses, "row", "left")
    parts = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    return met.select(
        F.col("doc").alias("doc_id"), kept.alias("kept"), F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
