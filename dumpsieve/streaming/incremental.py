"""The filter as an available-now stream.

The stream is one of file listings, not of lines: Spark's file source remembers in
its checkpoint which dump files it has handed out, the content column is never
read, and each micro-batch goes through the same plan as a batch run.  So files with
long windows and files of many frames are read alike in both.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dumpsieve.functions.regex import re2_search
from dumpsieve.functions.text import base_name
from dumpsieve.operators.manifest import failed_files, read_manifest
from dumpsieve.plans.filter_run import config_hash, filter_files
from dumpsieve.sources.listing import list_input_files
from dumpsieve.sources.scan import SPLIT_BYTES
from dumpsieve.sources.zst import EXTENSION
from dumpsieve.specs import FilterSpec

_LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(
    spark: SparkSession, path: str, file_filter: str = ".*", max_files: int | None = None
) -> DataFrame:
    """New dump files below the directory ``path``, in the columns of a file listing."""
    reader = (
        spark.readStream.format("binaryFile").schema(_LISTING)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*" + EXTENSION)
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    root = (path if "://" in path else os.path.abspath(path)).rstrip("/").split("://", 1)[-1] + "/"
    below = F.substring(F.col("path"), F.instr("path", root) + len(root), F.char_length("path"))
    listed = reader.load(path).select(
        below.alias("file"), F.regexp_replace("path", "^file:/+", "/").alias("path"),
        base_name(F.col("path")).alias("file_name"), "length", F.col("modificationTime").alias("modified"),
    )
    return listed.where(re2_search(F.col("file_name"), file_filter))


def stream_filter(
    spark: SparkSession, path: str, output: str, spec: FilterSpec, checkpoint: str,
    max_files: int | None = None, split_bytes: int = SPLIT_BYTES,
) -> StreamingQuery:
    """Filter what has arrived since the last call; one checkpoint per settings.

    A micro-batch also has the files that the latest run could not read, as far as they
    are still there: the source hands out a file once, so a mended one would not come again.
    They go with every call in which something new arrives.
    """
    hashed = config_hash(spark, spec)

    def filter_batch(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        manifest = read_manifest(session, output)
        if manifest is not None:
            failed = failed_files(manifest, hashed)
            if not failed.isEmpty():
                again = list_input_files(session, path, spec.file_filter).join(F.broadcast(failed), "file")
                batch = batch.unionByName(again.join(batch.select("file"), "file", "left_anti").select(*batch.columns))
        filter_files(session, batch, output, spec, split_bytes)

    return (
        stream_files(spark, path, spec.file_filter, max_files)
        .writeStream.foreachBatch(filter_batch)
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/{hashed}")
        .trigger(availableNow=True)
        .start()
    )
