"""Counts of processed, matched and bad lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def processed() -> Column:
    """All lines, blank ones too."""
    return F.count(F.lit(1))


def emitted() -> Column:
    """Lines that become a row of a table: neither blank nor bad."""
    return F.count_if(~F.col("is_bad"))


def errors() -> Column:
    return F.count_if("is_bad")


def matched() -> Column:
    return F.count_if("matched")


def per_file_stats(tagged: DataFrame, file: str = "file", value: str = "value") -> DataFrame:
    """Per file: lines that are not blank, bad lines, bytes with one line end each."""
    return tagged.groupBy(file).agg(
        F.count_if(F.col("is_bad").isNotNull()).alias("lines_processed"),
        errors().alias("bad_lines"),
        F.sum(F.octet_length(value) + F.lit(1)).alias("bytes_processed"),
    )


def error_percentage(error_count: Column, line_count: Column) -> Column:
    return F.when(line_count == 0, 0.0).otherwise(error_count * F.lit(100.0) / line_count)


def error_rate_gate(tagged: DataFrame, limit: float) -> DataFrame:
    """One row: lines, errors, and whether their percentage is within the limit."""
    counts = tagged.agg(processed().alias("processed"), errors().alias("errors"))
    within = F.col("errors") * F.lit(100.0) <= F.col("processed") * F.lit(float(limit))
    return counts.withColumn("passed", within)
