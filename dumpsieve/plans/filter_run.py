"""The filter: matching lines of each dump file, byte for byte, as a file of its own."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpsieve.functions.text import output_name
from dumpsieve.operators.manifest import manifest_path, read_manifest, skip_processed
from dumpsieve.operators.predicates import tag_matches
from dumpsieve.operators.value_list import ValueList, moves_lines, value_list_source
from dumpsieve.sources.dump_sink import (
    BAD, CLOSE, FORMAT, LINE, MANIFEST_SCHEMA, RATE_EXCEEDED, DumpSink,
)
from dumpsieve.sources.listing import DumpFile, NoInputError, collect_files, list_input_files
from dumpsieve.sources.scan import (
    SPLIT_BYTES, drop_failed_files, plan_scan, scan_in_pieces, scratch_folder, shared_folder, stage,
)
from dumpsieve.specs import FilterSpec


class ErrorRateExceeded(RuntimeError):
    """Too many bad lines; nothing was published."""


@dataclass(frozen=True)
class FilterReport:
    """Totals of a run; ``files`` has them per file and is empty if nothing was new."""

    run_id: str
    new_files: int
    skipped_files: int
    processed: int
    matched: int
    errors: int
    files: DataFrame


def _values(spark: SparkSession, spec: FilterSpec) -> ValueList | None:
    return None if spec.value_list is None else value_list_source(spark, spec.value_list)


def config_hash(spark: SparkSession, spec: FilterSpec) -> str:
    values = _values(spark, spec)
    return spec.config_hash("" if values is None else values.digest())


def output_label(spec: FilterSpec, values: ValueList | None = None) -> str:
    """What stands for the value in the names of outputs."""
    return spec.value if values is None else "list-" + spec.config_hash(values.digest())[:12]


def filter_dump(spark: SparkSession, path: str, spec: FilterSpec, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Matching lines of the dump files below ``path`` as a DataFrame.

    A file that cannot be read to its end gives no lines, which is known only once it
    was read: the matching lines are staged in the shared folder first.
    """
    folder = shared_folder(spark, "filter")
    files = collect_files(list_input_files(spark, path, spec.file_filter))
    scanned = scan_in_pieces(plan_scan(spark, files, split_bytes, folder), folder)
    tagged = tag_matches(scanned, spec, _values(spark, spec), folder=folder)
    found = tagged.where(F.col("matched") | F.col("status").isNotNull())
    found = found.select("file", "split", "line", "value", "status")
    return drop_failed_files(stage(found, folder + "/found"))


def check_output(output: str) -> None:
    """The root of a file system is refused."""
    if not re.sub(r"^[a-z0-9+.-]+:(//[^/]*)?", "", output).strip("/"):
        raise ValueError(f"the output must be a folder below the root, not {output!r}")


def run_filter(
    spark: SparkSession, path: str, output: str, spec: FilterSpec, split_bytes: int = SPLIT_BYTES
) -> FilterReport:
    """Filter the dump files below ``path`` that are new under these settings."""
    files = list_input_files(spark, path, spec.file_filter)
    report = filter_files(spark, files, output, spec, split_bytes)
    if not report.new_files + report.skipped_files:
        raise NoInputError("there is no dump file to filter")
    return report


def filter_files(
    spark: SparkSession, files: DataFrame, output: str, spec: FilterSpec, split_bytes: int = SPLIT_BYTES
) -> FilterReport:
    """Filter listed files in one pass.

    Lines are decoded, tested, counted and encoded in the task that reads them,
    without an exchange.  Only the lines of a huge frame, which one task has to
    decode, are staged for many tasks to test, and all lines for a long list.
    """
    check_output(output)
    values = _values(spark, spec)
    hashed = spec.config_hash("" if values is None else values.digest())
    listed = todo = collect_files(files)
    done = read_manifest(spark, output)
    if listed and done is not None:
        todo = collect_files(skip_processed(files, done, hashed, output_label(spec, values)))
    run_id = uuid.uuid4().hex
    if not todo:
        return FilterReport(run_id, 0, len(listed), 0, 0, 0, spark.createDataFrame([], MANIFEST_SCHEMA))

    with scratch_folder(spark) as folder:
        scanned = scan_in_pieces(plan_scan(spark, todo, split_bytes, folder), folder)
        rows = sink_rows(scanned, spec, values, folder)
        write_dump(rows, output, run_id, hashed, spec.error_rate, output_label(spec, values))

    run = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{manifest_path(output)}/{run_id}.parquet")
    totals = run.agg(
        F.sum("total_lines"), F.sum("match_count"), F.sum("bad_lines") + F.count("failure")
    ).first()
    return FilterReport(run_id, len(todo), len(listed) - len(todo), *totals, run)


def sink_rows(
    scanned: DataFrame, spec: FilterSpec, values: ValueList | None = None, folder: str | None = None
) -> DataFrame:
    """Scanned lines as rows for the sink: matches, bad lines to count, closing rows."""
    if "piece" not in scanned.columns:
        scanned = scanned.withColumn("piece", F.lit(""))
    tagged = tag_matches(scanned, spec, values, folder=folder)
    kind = F.when(F.col("matched"), LINE).when(F.col("is_bad"), BAD)
    kind = kind.when(F.col("status").isNotNull(), CLOSE)
    rows = tagged.withColumn("kind", kind).where(F.col("kind").isNotNull())
    order = ["file", "split", "piece", "line"]
    if moves_lines(values, spec):
        rows = rows.repartition(*order[:3]).sortWithinPartitions(*order)
    out = output_name(F.col("file"), F.lit(output_label(spec, values)))
    if spec.split_by_letter:
        out = F.concat(F.coalesce(F.concat("letter", F.lit("/")), F.lit("")), out)
        rows = rows.sortWithinPartitions(*order[:3], F.asc_nulls_last("letter"), "line")
    value = F.when(F.col("kind") == LINE, F.col("value").cast("binary")).alias("value")
    return rows.select(out.alias("out"), *order, "kind", value, "status")


def write_dump(
    rows: DataFrame, output: str, run_id: str | None = None, config_hash: str = "",
    error_rate: float | None = None, label: str = "", versions: bool = True, window_log: int | None = None,
) -> None:
    """Write rows of ``SINK_SCHEMA`` as zstd NDJSON files below ``output``.

    ``versions`` writes a run of which the manifest tells what is live; else the outputs
    are plain files, which must not be there before.
    ``window_log`` asks for long windows (27 is 128 MiB, 31 is 2 GiB).
    """
    rows.sparkSession.dataSource.register(DumpSink)
    writer = (
        rows.write.format(FORMAT).mode("append")
        .option("run_id", run_id or uuid.uuid4().hex)
        .option("config_hash", config_hash)
        .option("label", label)
        .option("versions", str(versions).lower())
    )
    if window_log is not None:
        writer = writer.option("window_log", window_log)
    if error_rate is not None:
        writer = writer.option("error_rate", str(error_rate))
    try:
        writer.save(output)
    except PySparkException as err:
        if RATE_EXCEEDED in str(err):
            raise ErrorRateExceeded(str(err)) from err
        raise


def write_lines(lines: DataFrame, output: str, window_log: int | None = None) -> None:
    """Write lines (``out``, ``value``) as new dump files named by ``out``; lines stay in their tasks."""
    none = F.lit(None).cast("string")
    rows = lines.sortWithinPartitions("out").select(
        "out", F.col("out").alias("file"), F.spark_partition_id().cast("bigint").alias("split"),
        F.lit("").alias("piece"), F.lit(0).cast("bigint").alias("line"), F.lit(LINE).alias("kind"),
        F.col("value").cast("binary").alias("value"), none.alias("status"),
    )
    write_dump(rows, output, versions=False, window_log=window_log)
