"""The table: all records of all dump files as CSV."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dumpsieve.functions.json_lines import parse_ndjson
from dumpsieve.functions.text import first_letter
from dumpsieve.functions.values import csv_line
from dumpsieve.operators import counters
from dumpsieve.operators.projections import COLUMNS, column, keys_for, project
from dumpsieve.sources.csv_sink import FORMAT as CSV_FORMAT
from dumpsieve.sources.csv_sink import CsvSink, read_report
from dumpsieve.sources.listing import DumpFile, collect_files, kind_of, list_input_files
from dumpsieve.sources.scan import (
    SPLIT_BYTES, first_failures, keep_until_failure, only_lines, plan_scan, scan_in_pieces, scan_splits,
    scratch_folder, shared_folder, stage,
)
from dumpsieve.sources.zst import FAILED, open_fs
from dumpsieve.specs import CsvSpec

OUTPUT_NAME = "output.csv"


@dataclass(frozen=True)
class CsvReport:
    """``processed`` rows, ``errors``: bad lines and failed files."""

    kind: str
    processed: int
    bad_lines: int
    errors: int
    path: str


def csv_projection(
    spark: SparkSession, path: str, spec: CsvSpec = CsvSpec(), split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """The table of the dump files below ``path``, with the columns of the first file's kind."""
    files = collect_files(list_input_files(spark, path, spec.file_filter))
    lines, _ = _usable_lines(spark, files, split_bytes, shared_folder(spark, "csv"))
    return project(only_lines(lines), kind_of(files[0].file), spec.number_style)


def run_csv(
    spark: SparkSession, path: str, output: str, spec: CsvSpec = CsvSpec(), split_bytes: int = SPLIT_BYTES
) -> list[CsvReport]:
    """Write ``output.csv`` below ``output``: one table, or one per kind."""
    files = collect_files(list_input_files(spark, path, spec.file_filter))
    root = output.rstrip("/")
    if not spec.per_kind:
        kind = kind_of(files[0].file) if files else "submission"
        return [_write(spark, files, kind, f"{root}/{OUTPUT_NAME}", spec, split_bytes)]
    groups: dict[str, list[DumpFile]] = {}
    for f in files:
        groups.setdefault(kind_of(f.file), []).append(f)
    return [
        _write(spark, group, kind, f"{root}/{kind}/{OUTPUT_NAME}", spec, split_bytes)
        for kind, group in groups.items()
    ]


def _usable_lines(
    spark: SparkSession, files: list[DumpFile], split_bytes: int, folder: str
) -> tuple[DataFrame, int]:
    """Lines in front of a failure, and how many files are known to have failed.

    Where each file is read by one task, none stand behind a failure, and lines are
    used as they are read, closing rows among them.  Else they are staged, so that
    failures are known beforehand; a huge frame is then decoded once and its lines
    used by many tasks.
    """
    plan = plan_scan(spark, files, split_bytes, folder)
    scanned = scan_splits(plan)
    if not plan.cut:
        return scanned, 0
    staged = stage(scanned, folder + "/lines")
    lines = keep_until_failure(staged).withColumn("status", F.lit(None).cast("string"))
    return lines, first_failures(staged).count()


def _write(
    spark: SparkSession, files: list[DumpFile], kind: str, path: str, spec: CsvSpec, split_bytes: int
) -> CsvReport:
    if spec.exact:
        return _write_exact(spark, files, kind, path, spec, split_bytes)
    columns = COLUMNS[kind]
    seen = Observation()
    with scratch_folder(spark) as folder:
        lines, failed = _usable_lines(spark, files, split_bytes, folder)
        parsed = parse_ndjson(lines, keys_for(columns))
        made = [column(c, spec.number_style) for c in columns]
        # Counting sits above the projection: below it, all columns would be carried along.
        counted = parsed.select(*made, "is_bad", "status").observe(
            seen,
            counters.emitted().alias("processed"),
            counters.errors().alias("bad_lines"),
            F.count_if(F.startswith("status", F.lit(FAILED))).alias("failed"),
        )
        table = counted.where(~F.col("is_bad")).select(*columns)
        write_csv(table, path, exact=False)
    got = seen.get
    return CsvReport(kind, got["processed"], got["bad_lines"], got["bad_lines"] + got["failed"] + failed, path)


def _write_exact(
    spark: SparkSession, files: list[DumpFile], kind: str, path: str, spec: CsvSpec, split_bytes: int
) -> CsvReport:
    """One pass: records are written as they are read, and what stands behind a failure is left out at the end."""
    columns = COLUMNS[kind]
    with scratch_folder(spark) as folder:
        lines = scan_in_pieces(plan_scan(spark, files, split_bytes, folder), folder, placed=True)
        parsed = parse_ndjson(lines, keys_for(columns))
        record = csv_line([column(c, spec.number_style) for c in columns])
        value = F.when(F.col("status").isNull() & ~F.col("is_bad"), record).alias("value")
        rows = parsed.select("file", "place", "piece", "whole", "line", value, "is_bad", "status")
        spark.dataSource.register(CsvSink)
        writer = rows.write.format(CSV_FORMAT).mode("append").option("run_id", uuid.uuid4().hex)
        writer.option("header", ",".join(columns)).save(path)
    got = read_report(path)
    return CsvReport(kind, got["processed"], got["bad_lines"], got["bad_lines"] + len(got["failed_files"]), path)


def read_csv_parts(spark: SparkSession, path: str) -> DataFrame:
    """The table that a run has written in the default form, as text columns."""
    fs, folder = open_fs(path)
    header = next(i for i in fs.get_file_info(pafs.FileSelector(folder)) if i.base_name.endswith("header"))
    with fs.open_input_stream(header.path, compression=None) as file:
        columns = file.read().decode().strip().split(",")
    reader = spark.read.schema(", ".join(f"{c} string" for c in columns))
    options = dict(multiLine=True, quote='"', escape='"', nullValue="\u0000", lineSep="\n", pathGlobFilter="*.csv")
    return reader.options(**options).csv(path).na.fill("")


def csv_lines(table: DataFrame) -> DataFrame:
    """Rows of text columns as CSV lines, quoted only where needed."""
    return table.select(csv_line([F.col(c) for c in table.columns]).alias("value"))


def write_csv(table: DataFrame, path: str, exact: bool = True) -> None:
    """Write part files: exact ones concatenate to one CSV file, the header being the first."""
    if not exact:
        (
            table.write.mode("overwrite")
            .options(header=True, quote='"', escape='"', emptyValue="", lineSep="\n")
            .options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
            .csv(path)
        )
        return
    header = table.sparkSession.range(0, 1, 1, 1).select(F.lit(",".join(table.columns)).alias("value"))
    header.union(csv_lines(table)).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_by_letter(table: DataFrame, field: str, path: str) -> None:
    """Write a table split by the first letter of a column, as Parquet."""
    by_letter = table.withColumn("letter", first_letter(F.col(field)))
    by_letter.write.mode("overwrite").partitionBy("letter").option("compression", "zstd").parquet(path)
