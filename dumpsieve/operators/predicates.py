"""Which lines match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpsieve.functions.json_lines import parse_ndjson
from dumpsieve.functions.regex import re2_search
from dumpsieve.functions.text import contains_lower, equals_fold, first_letter
from dumpsieve.functions.values import string_or_null
from dumpsieve.operators.value_list import ValueList, flag_listed
from dumpsieve.specs import FilterSpec


def matches(x: Column, spec: FilterSpec) -> Column:
    """Whether the string ``x`` matches the value of the spec; NULL where ``x`` is."""
    if spec.regex:
        return re2_search(x, spec.value)
    if spec.partial:
        return contains_lower(x, spec.value)
    return equals_fold(x, spec.value)


def field_present(v: Column) -> Column:
    """The key is in the record, whatever its value."""
    return v.isNotNull()


def tag_matches(
    lines: DataFrame, spec: FilterSpec, values: ValueList | None = None, value: str = "value",
    folder: str | None = None,
) -> DataFrame:
    """Add ``is_bad`` and ``matched`` to lines; a blank line is neither.

    Absent keys and values that are not strings do not match.  With
    ``split_by_letter``, matched lines also get the ``letter`` their field starts with.
    What a long list needs staged goes below ``folder``.
    """
    field = string_or_null(F.col(spec.field))
    parsed = parse_ndjson(lines, [spec.field], value)
    if values is None:
        tagged = parsed.withColumn("matched", matches(field, spec))
    else:
        tagged = flag_listed(parsed, field, values, spec, folder)
    good = F.coalesce(~F.col("is_bad"), F.lit(False))
    tagged = tagged.withColumn("matched", F.coalesce("matched", F.lit(False)) & good)
    if spec.split_by_letter:
        tagged = tagged.withColumn("letter", F.when(F.col("matched"), first_letter(field)))
    return tagged.drop(spec.field)


def filter_lines(
    lines: DataFrame, spec: FilterSpec, values: ValueList | None = None, value: str = "value"
) -> DataFrame:
    """The lines that match, untouched."""
    return tag_matches(lines, spec, values, value).where("matched").drop("matched", "is_bad", "letter")


def file_name_filter(file_name: Column, pattern: str = ".*") -> Column:
    """Search of a pattern in a base name."""
    return re2_search(file_name, pattern)
