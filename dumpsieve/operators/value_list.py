"""Matching against a list of values."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpsieve.functions.regex import check_re2, re2_search
from dumpsieve.functions.text import contains_any_lower, fold
from dumpsieve.operators.contained import flag_contained
from dumpsieve.operators.patterns import flag_patterns
from dumpsieve.sources.zst import open_fs
from dumpsieve.specs import FilterSpec

BROADCAST_BYTES = 64 << 20  # a list file up to this size goes to every task
AUTOMATON_BYTES = 1 << 20  # a list file up to this size becomes one automaton in every task
PATTERN_BYTES = 32 << 10  # a list file up to this size becomes one regular expression
SALTS = 64


@dataclass
class ValueList:
    """Distinct non-empty values (column ``item``), a bound of their size in bytes, and the values as they are listed,
    some perhaps more than once."""

    items: DataFrame
    size_bytes: int
    listed: DataFrame | None = None

    def any_order(self) -> DataFrame:
        """All values, without an exchange if possible; a value may come again."""
        return self.items if self.listed is None else self.listed

    def digest(self) -> str:
        """Identifies the set of values, whatever their order."""
        row = self.items.agg(
            F.count("*"), F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64(F.sha2("item", 256)))
        ).first()
        return ":".join(map(str, row))


def value_list_source(spark: SparkSession, path: str) -> ValueList:
    """Newline-separated values of a text file, or of the files of a folder."""
    fs, name = open_fs(path)
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise ValueError(f"there is no value list at {path}")
    files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(name, recursive=True))
    size = sum(f.size for f in files if f.type == pafs.FileType.File)
    if size == 0:
        raise ValueError(f"the value list at {path} holds nothing")
    text = spark.read.option("lineSep", "\n").text(path)
    item = F.regexp_replace("value", r"\r\z", "")
    listed = text.select(item.alias("item")).where("item <> ''")
    return ValueList(listed.distinct(), size, listed)


def _texts(values: ValueList) -> list[str]:
    return sorted(r.item for r in values.items.toLocalIterator())


def moves_lines(values: ValueList | None, spec: FilterSpec) -> bool:
    """Whether lines are exchanged to be matched, and so come in another order."""
    if values is None:
        return False
    limit = PATTERN_BYTES if spec.regex else AUTOMATON_BYTES if spec.partial else BROADCAST_BYTES
    return values.size_bytes > limit


def flag_listed(
    parsed: DataFrame, x: Column, values: ValueList, spec: FilterSpec, folder: str | None = None
) -> DataFrame:
    """Add ``matched``: the string ``x`` matches some value of the list; an empty list matches nothing.

    Long lists for partial matching and of regular expressions are staged below ``folder``, with the lines.
    """
    if spec.regex and moves_lines(values, spec):
        return flag_patterns(parsed, x, values.any_order(), folder)
    if spec.partial and moves_lines(values, spec):
        return flag_contained(parsed, x, values.any_order(), folder)
    if spec.partial:
        return parsed.withColumn("matched", contains_any_lower(x, _texts(values)))
    if spec.regex:
        patterns = _texts(values)
        for pattern in patterns:
            check_re2(pattern)
        found = re2_search(x, "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
        return parsed.withColumn("matched", found)
    return _flag_equal(parsed, x, values)


def _flag_equal(parsed: DataFrame, x: Column, values: ValueList) -> DataFrame:
    """``matched`` by an outer join on the folded value; the keys of the list are distinct."""
    keys = values.items.select(fold(F.col("item")).alias("_key")).distinct().withColumn("matched", F.lit(True))
    rows = parsed.withColumn("_key", fold(x))
    if values.size_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keys), "_key", "left").drop("_key")
    # A long list is shuffled.  One value may hold much of the dump, so each row picks
    # one of several copies of the list.
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    copies = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, ["_key", "_salt"], "left").drop("_key", "_salt")
