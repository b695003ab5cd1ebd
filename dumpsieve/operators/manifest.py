"""The record of finished runs, and which of their outputs are live.

A run has written a row per input file.  Of the rows of one file under one label (the
part of output names that stands for the value), the latest decides: its parts are the
live output, also if it has none because nothing matched or the file could not be read.
Nothing else has to be removed for that, so readers that have resolved the live parts
keep reading them until :func:`collect_superseded` is asked to clean up.
"""

from __future__ import annotations

import sys
import uuid
from datetime import datetime, timedelta, timezone

import pandas as pd
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpsieve.sources.dump_sink import MANIFEST_DIR, MANIFEST_SCHEMA, RUNS_DIR
from dumpsieve.sources.listing import FILE_SCHEMA, collect_files
from dumpsieve.sources.scan import SPLIT_BYTES, only_lines, plan_scan, scan_splits
from dumpsieve.sources.zst import LINE_SCHEMA, open_fs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PARTS_SCHEMA = "file string, label string, run_id string, out string, part string, path string"


def manifest_path(output: str) -> str:
    return f"{output.rstrip('/')}/{MANIFEST_DIR}"


def read_manifest(spark: SparkSession, output: str) -> DataFrame | None:
    """Rows of all runs into ``output``; ``None`` if there was no run."""
    path = manifest_path(output)
    fs, name = open_fs(path)
    if fs.get_file_info(name).type != pafs.FileType.Directory:
        return None
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def latest_rows(manifest: DataFrame) -> DataFrame:
    """The row that decides for each file and label."""
    order = F.struct("processed_at", "run_id")
    whole = F.max_by(F.struct(*manifest.columns), order).alias("row")
    return manifest.groupBy("file", "label").agg(whole).select("row.*")


def skip_processed(files: DataFrame, manifest: DataFrame, config_hash: str, label: str | None = None) -> DataFrame:
    """The files that the latest run under the label has not finished under these settings.

    Without a ``label`` the runs of all labels count, so any later run makes a file new again.
    """
    rows = manifest.withColumn("label", F.lit("")) if label is None else manifest.where(F.col("label") == label)
    done = latest_rows(rows).where(F.col("failure").isNull() & (F.col("hashed_config") == config_hash))
    return files.join(done.select("file"), "file", "left_anti")


def failed_files(manifest: DataFrame, config_hash: str) -> DataFrame:
    """``file`` of those that the latest run under these settings could not read."""
    rows = manifest.where(F.col("hashed_config") == config_hash).withColumn("label", F.lit(""))
    return latest_rows(rows).where(F.col("failure").isNotNull()).select("file")


def live_parts(spark: SparkSession, output: str, config_hash: str | None = None) -> DataFrame:
    """``file, label, run_id, out, part, path`` of the live parts, of some settings or of all.

    ``part`` is the place below ``output``; parts of one ``out`` are in the order of their names.
    """
    manifest = read_manifest(spark, output)
    if manifest is None:
        return spark.createDataFrame([], _PARTS_SCHEMA)
    rows = latest_rows(manifest)
    if config_hash is not None:
        rows = rows.where(F.col("hashed_config") == config_hash)
    outs = rows.select("file", "label", "run_id", F.explode("outs").alias("o"))
    parts = outs.select("file", "label", "run_id", F.col("o.out").alias("out"), F.explode("o.parts").alias("part"))
    return parts.withColumn("path", F.concat(F.lit(output.rstrip("/") + "/"), "part"))


def _with_length(rows):
    """Task function: adds the length in bytes that each part has on its file system."""
    for batch in rows:
        sizes = [fs.get_file_info(name).size for fs, name in map(open_fs, batch["path"])]
        yield batch.assign(length=sizes)


def live_files(spark: SparkSession, output: str, config_hash: str | None = None) -> DataFrame:
    """The live parts as a listing, to be read or filtered like any other dump files."""
    parts = live_parts(spark, output, config_hash)
    named = parts.select(
        F.concat_ws("/", "out", F.element_at(F.split("part", "/"), -1)).alias("file"), "path",
        F.element_at(F.split("out", "/"), -1).alias("file_name"), F.lit(0).cast("bigint").alias("length"),
        F.lit(None).cast("timestamp").alias("modified"),
    )
    return named.mapInPandas(_with_length, FILE_SCHEMA)


def read_output(spark: SparkSession, output: str, config_hash: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The live lines: ``file`` (output and part), ``split``, ``line``, ``value``."""
    files = collect_files(live_files(spark, output, config_hash))
    if not files:
        return spark.createDataFrame([], LINE_SCHEMA.replace("value binary", "value string")).drop("status")
    return only_lines(scan_splits(plan_scan(spark, files, split_bytes)))


# ---------------------------------------------------------------- cleaning up


def _removing(output: str):
    def remove(rows) -> None:
        fs, target = open_fs(output.rstrip("/"))
        for row in rows:
            name = f"{target}/{row.path}"
            kind = fs.get_file_info(name).type
            if kind == pafs.FileType.Directory:
                fs.delete_dir(name)
            elif kind == pafs.FileType.File:
                fs.delete_file(name)

    return remove


def compact_manifest(spark: SparkSession, output: str) -> int:
    """Put the deciding rows of all runs into one file in place of one per run; how many files went.

    The new file is written first, then the old ones go: at any moment the rows that
    decide are there, some of them twice for a while, which changes nothing.
    """
    fs, name = open_fs(manifest_path(output))
    if fs.get_file_info(name).type != pafs.FileType.Directory:
        return 0
    earlier = [i.path for i in fs.get_file_info(pafs.FileSelector(name)) if i.base_name.endswith(".parquet")]
    if len(earlier) < 2:
        return 0
    base = f"{output.rstrip('/')}/{RUNS_DIR}/compact-{uuid.uuid4().hex}"
    scheme_free = open_fs(base)[1]
    latest_rows(spark.read.schema(MANIFEST_SCHEMA).parquet(manifest_path(output))).coalesce(1).write.parquet(base)
    (made,) = [i.path for i in fs.get_file_info(pafs.FileSelector(scheme_free)) if i.base_name.endswith(".parquet")]
    fs.move(made, f"{name}/{uuid.uuid4().hex}.parquet")
    for path in earlier:
        fs.delete_file(path)
    fs.delete_dir(scheme_free)
    return len(earlier)


def collect_superseded(spark: SparkSession, output: str, unfinished_after: timedelta = timedelta(days=7)) -> int:
    """Remove what is not live: parts of runs that later ones replaced, parts of lost attempts,
    and runs that never finished and are older than ``unfinished_after``; how many paths went.

    Folders are listed and removed by tasks.  A part goes only if a manifest row says that
    another run has decided for its file, or if its run is finished and does not name it.
    """
    manifest = read_manifest(spark, output)
    if manifest is None:
        return 0
    fs, target = open_fs(output.rstrip("/"))
    root = f"{target}/{RUNS_DIR}"
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        return 0
    limit = datetime.now(timezone.utc) - unfinished_after
    folders = [(i.base_name, i.mtime) for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.Directory]
    listed = spark.createDataFrame(folders, "run_id string, modified timestamp")
    finished = manifest.select("run_id").distinct().withColumn("finished", F.lit(True))
    runs = listed.join(finished, "run_id", "left").withColumn("finished", F.col("finished").isNotNull())
    live = live_parts(spark, output).select("run_id", "part")

    def parts_of(rows):
        store, at = open_fs(output.rstrip("/"))
        for batch in rows:
            for run in batch["run_id"]:
                found = store.get_file_info(pafs.FileSelector(f"{at}/{RUNS_DIR}/{run}", recursive=True))
                names = [i.path[len(at) + 1 :] for i in found if i.type == pafs.FileType.File]
                yield pd.DataFrame({"run_id": [run] * len(names), "path": names})

    kept_runs = live.select("run_id").distinct()
    dead = runs.where("finished").join(kept_runs, "run_id", "left_anti").unionByName(
        runs.where(~F.col("finished") & (F.col("modified") < F.lit(limit)))
    ).select(F.concat(F.lit(RUNS_DIR + "/"), "run_id").alias("path"))
    partly = runs.where("finished").join(kept_runs, "run_id", "left_semi").select("run_id")
    partly = partly.repartition(max(1, min(len(folders), 1000)), "run_id").mapInPandas(parts_of, "run_id string, path string")
    orphans = partly.join(live.withColumnRenamed("part", "path"), ["run_id", "path"], "left_anti").select("path")
    going = dead.unionByName(orphans)
    count = going.count()
    going.foreachPartition(_removing(output))
    compact_manifest(spark, output)
    return count


# ---------------------------------------------------------------- plain copies


def export_live(spark: SparkSession, output: str, dest: str, whole: bool = True) -> DataFrame:
    """Copy the live outputs to ``dest`` under their own names: ``name, parts, bytes``.

    ``whole`` makes each output one file, its parts one behind the other; else an output
    is a folder of its parts, so that tasks share a long one. Tasks do the copying.
    """
    name = F.col("out") if whole else F.concat_ws("/", "out", F.element_at(F.split("part", "/"), -1))
    outs = live_parts(spark, output).groupBy(name.alias("name")).agg(F.array_sort(F.collect_list("path")).alias("paths"))

    def copied(batches):
        for batch in batches:
            sizes = []
            to, folder = open_fs(dest.rstrip("/"))
            for out, paths in zip(batch["name"], batch["paths"]):
                to.create_dir(f"{folder}/{out}".rsplit("/", 1)[0], recursive=True)
                attempt, size = f"{folder}/{out}.{uuid.uuid4().hex[:12]}.tmp", 0
                with to.open_output_stream(attempt, compression=None) as write:
                    for path in paths:
                        store, source = open_fs(path)
                        with store.open_input_stream(source, compression=None) as read:
                            while data := read.read(4 << 20):
                                write.write(data)
                                size += len(data)
                to.move(attempt, f"{folder}/{out}")
                sizes.append(size)
            yield pd.DataFrame({"name": batch["name"], "parts": batch["paths"].map(len), "bytes": sizes})

    schema = "name string, parts bigint, bytes bigint"
    return spark.createDataFrame(outs.mapInPandas(copied, schema).collect(), schema)  # a short row per output
