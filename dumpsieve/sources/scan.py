"""Dump files as a DataFrame of lines, directly or staged as Parquet."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dumpsieve.sources.listing import DumpFile, NoInputError, collect_files, list_input_files
from dumpsieve.sources.zst import END, LINE_SCHEMA, PLACED_SCHEMA, find_frames, open_fs, read_placed_splits, read_splits

SPLIT_BYTES = 128 << 20  # compressed
TASK_BYTES = 8 << 20  # compressed; shorter splits of a large dump share a task
_UNEVEN = 8
_STAGE_ROWS_PER_FILE = 20_000_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the cluster shares; a local one where all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "dumpsieve")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A fresh shared folder that goes away with the run that uses it."""
    folder = shared_folder(spark, "run")
    try:
        yield folder
    finally:
        fs, name = open_fs(folder)
        if fs.get_file_info(name).type == pafs.FileType.Directory:
            fs.delete_dir(name)


@dataclass(frozen=True)
class ScanPlan:
    """Where reading is cut: rows of ``SPLIT_SCHEMA`` and what is known of them."""

    splits: DataFrame
    n_tasks: int
    cut: bool  # some file is read by several tasks
    uneven: DataFrame | None = None  # file, first: splits with so much to decode that their lines should be spread before use


def plan_scan(
    spark: SparkSession, files: list[DumpFile], split_bytes: int = SPLIT_BYTES, folder: str | None = None
) -> ScanPlan:
    """Cut the files for reading into ranges of ``split_bytes``, by their lengths alone.

    Files are laid end to end and cut into bins, one task each; a task reads the
    splits whose middle lies in its bin, so small files share a task and files larger
    than ``split_bytes`` get many.  Splits below ``TASK_BYTES`` share a task where there is enough for
    all cores: tasks are as many as the bytes ask for, not the splits.  What is moved here describes
    splits: a short row for every ``split_bytes``, never a line.

    With a ``folder`` for staging, splits are also looked at that may be uneven: those of files
    longer than ``_UNEVEN`` of them.  Tasks as many find where the first frame in each begins;
    where the next one is too far away, the split is ``uneven``.
    """
    if not files:
        raise NoInputError("there is no dump file to read")
    total = sum(f.length for f in files)
    bin_bytes = max(1, min(max(split_bytes, TASK_BYTES), total // spark.sparkContext.defaultParallelism))
    rows, base = [], 0
    for f in files:
        rows.append((f.file, f.path, f.length, base))
        base += f.length
    listed = spark.createDataFrame(rows, "file string, path string, length bigint, base bigint")
    begins = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))
    cut = listed.select("file", "path", "length", "base", F.explode(begins).alias("first"))
    last = F.least(F.col("first") + split_bytes, F.col("length"))
    middle = F.col("base") + F.shiftright(F.col("first") + last, 1)
    splits = cut.select(
        "file", "path", "first", last.alias("last"), F.floor(middle / bin_bytes).cast("int").alias("bin"),
        (F.col("base") + F.col("first")).alias("place"), "length",
    )
    n_tasks = total // bin_bytes + 1
    plan = ScanPlan(splits.drop("length"), n_tasks, any(f.length > split_bytes for f in files))
    long = [f.length for f in files if f.length > _UNEVEN * split_bytes]
    if folder is None or not long:
        return plan
    maybe = splits.where(F.col("length") > _UNEVEN * split_bytes)
    dealt = maybe.repartition(max(1, min(sum(long) // bin_bytes + 1, 100_000)), "file", "first")
    found = stage(dealt.select("file", "path", "first", "last", "bin").mapInArrow(find_frames, "file string, first bigint, begin bigint"), folder + "/frames")
    # One short row per split of a long file.
    ahead = Window.partitionBy("file").orderBy("begin")
    frames = found.where("begin IS NOT NULL").join(listed.select("file", "length"), "file")
    reach = F.coalesce(F.lead("begin").over(ahead), F.col("length")) - F.col("begin")
    uneven = frames.select("file", "first", reach.alias("reach")).where(F.col("reach") > _UNEVEN * split_bytes).select("file", "first")
    uneven = stage(uneven, folder + "/uneven")
    return plan if uneven.isEmpty() else replace(plan, uneven=uneven)


def scan_splits(plan: ScanPlan) -> DataFrame:
    """Lines of the planned files: ``file, split, line, value, status``.

    ``status`` is NULL on lines.  Each split adds one closing row without value,
    whose status is ``end`` or the reason why reading failed, and whose ``line`` is
    the number of its lines.  Within a split, rows keep the order of the file.
    """
    return _read(plan.splits, plan.n_tasks)


def _read(splits: DataFrame, n_tasks: int, placed: bool = False) -> DataFrame:
    read, schema = (read_placed_splits, PLACED_SCHEMA) if placed else (read_splits, LINE_SCHEMA)
    lines = splits.repartitionById(n_tasks, "bin").mapInArrow(read, schema)
    return lines.withColumn("value", F.col("value").cast("string"))


def scan_in_pieces(plan: ScanPlan, folder: str, placed: bool = False) -> DataFrame:
    """As ``scan_splits``, with ``piece``: names the run of consecutive lines that one task gets of a split.
    ``placed`` adds the columns of ``read_placed_splits``.

    The lines of uneven splits, and no others, are staged below ``folder`` first and read from there by
    many tasks; all other splits are read directly.
    """
    whole = F.lit("").alias("piece")
    if plan.uneven is None:
        return _read(plan.splits, plan.n_tasks, placed).select("*", whole)
    marks = F.broadcast(plan.uneven)  # one short row per uneven split; the driver holds the list of all files
    direct = _read(plan.splits.join(marks, ["file", "first"], "left_anti"), plan.n_tasks, placed)
    staged = stage(_read(plan.splits.join(marks, ["file", "first"], "left_semi"), plan.n_tasks, placed), folder + "/lines")
    return direct.select("*", whole).unionByName(staged.select("*", piece_of_staged().alias("piece")))


def scan_dump_lines(
    spark: SparkSession, path: str, file_filter: str = ".*", split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Lines of all dump files below ``path`` (see ``scan_splits``)."""
    files = collect_files(list_input_files(spark, path, file_filter))
    return scan_splits(plan_scan(spark, files, split_bytes))


def only_lines(scanned: DataFrame) -> DataFrame:
    """Without the closing rows."""
    return scanned.where(F.col("status").isNull()).drop("status")


def stage(scanned: DataFrame, dest: str) -> DataFrame:
    """Write scanned lines (or what is known of splits) once as Parquet and read them back.

    Decoding then happens once, failures are known before the lines are used, and
    even a dump of a single frame is read by many tasks from here on.
    """
    (
        scanned.write.mode("overwrite")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", _STAGE_ROWS_PER_FILE)
        .parquet(dest)
    )
    return scanned.sparkSession.read.schema(scanned.schema).parquet(dest)


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    schema = LINE_SCHEMA.replace("value binary", "value string")
    return spark.read.schema(schema).parquet(path)


def piece_of_staged() -> Column:
    """Names the run of consecutive staged rows that a row is read in."""
    return F.concat_ws(":", "_metadata.file_path", "_metadata.file_block_start")


def ingest(
    spark: SparkSession, path: str, dest: str, file_filter: str = ".*", split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Stage the dump files below ``path`` for repeated use."""
    return stage(scan_dump_lines(spark, path, file_filter, split_bytes), dest)


def first_failures(scanned: DataFrame) -> DataFrame:
    """Per failed file, the position at which reading stopped."""
    failed = scanned.where(F.col("status").isNotNull() & (F.col("status") != END))
    return failed.groupBy("file").agg(F.min(F.struct("split", "line")).alias("stop"))


def _without(staged: DataFrame, lost) -> DataFrame:
    lines = only_lines(staged)
    failures = first_failures(staged)
    if failures.isEmpty():  # the usual case: no join at all
        return lines
    # One short row per failed input file, and the driver holds the list of all files.
    return lines.alias("l").join(F.broadcast(failures).alias("s"), lost, "left_anti")


def drop_failed_files(staged: DataFrame) -> DataFrame:
    """Lines of the files that were read to their end."""
    return _without(staged, F.col("l.file") == F.col("s.file"))


def keep_until_failure(staged: DataFrame) -> DataFrame:
    """Lines in front of the place where their file failed, if it did."""
    behind = F.struct("l.split", "l.line") >= F.col("s.stop")
    return _without(staged, (F.col("l.file") == F.col("s.file")) & behind)
