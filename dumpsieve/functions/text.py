"""Case folding, substring search and name building as Column expressions.

Two Unicode notions are needed, and no built-in gives either of them:

* *simple folding* (equality ignoring case, one code point to one code point);
* *simple lower-casing* (one code point to one code point, no context).

Both are tables over code points, generated below from the interpreter's own
Unicode data and applied with one ``translate``.  Where the needle is ASCII the
tables are not needed: only a few non-ASCII characters fold or lower to ASCII,
so the JVM ``lower`` with those few replaced beforehand gives the same answer.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters outside ASCII that fold to an ASCII letter, and
# the one whose simple lower case is ASCII but whose full lower case is not.
LONG_S = "\u017f"
KELVIN = "\u212a"
DOTTED_CAPITAL_I = "\u0130"

_LAST_CASED = 0x1F000  # no cased letter lies above


@lru_cache(maxsize=None)
def fold_table() -> dict[int, str]:
    """Code point -> its simple case folding, for those that change."""
    table = {}
    for cp in range(_LAST_CASED):
        char = chr(cp)
        folded = char.casefold()
        if len(folded) > 1:  # only a full folding exists; fall back to its simple form
            folded = char.lower()
        if folded != char and len(folded) == 1:
            table[cp] = folded
    return table


@lru_cache(maxsize=None)
def lower_table() -> dict[int, str]:
    """Code point -> its simple lower case, for those that change."""
    table = {}
    for cp in range(_LAST_CASED):
        char = chr(cp)
        low = char.lower()
        if low != char and len(low) == 1:
            table[cp] = low
    table[ord(DOTTED_CAPITAL_I)] = "i"
    return table


def fold_literal(text: str) -> str:
    return text.translate(fold_table())


def lower_literal(text: str) -> str:
    return text.translate(lower_table())


def _translate(x: Column, table: dict[int, str]) -> Column:
    ascii_only = F.octet_length(x) == F.char_length(x)
    mapped = F.translate(x, "".join(map(chr, table)), "".join(table.values()))
    return F.when(ascii_only, F.lower(x)).otherwise(mapped)


def fold(x: Column) -> Column:
    """Simple case folding of ``x``."""
    return _translate(x, fold_table())


def lower_simple(x: Column) -> Column:
    """``x`` lower-cased one code point at a time."""
    return _translate(x, lower_table())


def _replaced(x: Column, old: str, new: str, needle: str) -> Column:
    """Replace only when the needle could meet the replacement."""
    return F.replace(x, F.lit(old), F.lit(new)) if new in needle else x


def equals_fold(x: Column, needle: str) -> Column:
    """``x`` equals ``needle`` under simple case folding."""
    folded = fold_literal(needle)
    same_length = F.char_length(x) == F.lit(len(needle))
    if folded.isascii():
        return same_length & (F.lower(_replaced(x, LONG_S, "s", folded)) == F.lit(folded))
    return same_length & (fold(x) == F.lit(folded))


def contains_lower(x: Column, needle: str) -> Column:
    """Lower-cased ``x`` contains lower-cased ``needle``."""
    low = lower_literal(needle)
    if low.isascii():
        return F.contains(F.lower(_replaced(x, DOTTED_CAPITAL_I, "i", low)), F.lit(low))
    return F.contains(lower_simple(x), F.lit(low))


def contains_any_lower(x: Column, needles: list[str]) -> Column:
    """Lower-cased ``x`` contains at least one of the lower-cased needles.

    ``x`` is lower-cased once; one automaton looks for all needles in one pass over the text.
    """
    lows = sorted({lower_literal(n) for n in needles})
    shared = SparkSession.getActiveSession().sparkContext.broadcast(lows)
    held: list[ahocorasick.Automaton] = []

    def search(texts: pd.Series) -> pd.Series:
        if not held:
            automaton = ahocorasick.Automaton()
            for low in shared.value:
                automaton.add_word(low, True)
            automaton.make_automaton()
            held.append(automaton)
        if not len(held[0]):
            return pd.Series([None if t is None else False for t in texts], dtype=object)
        return pd.Series([None if t is None else next(held[0].iter(t), None) is not None for t in texts], dtype=object)

    return F.pandas_udf(search, T.BooleanType())(lower_simple(x))


# ---------------------------------------------------------------- names

# Fixed value: the characters that may not stand in a file name.
UNSAFE_NAME_CHARS = r'[<>:"/\\|?*\x00-\x1F]'


def sanitize_filename(x: Column) -> Column:
    """Each character that may not stand in a file name becomes ``_``."""
    return F.regexp_replace(x, UNSAFE_NAME_CHARS, "_")


def first_letter(x: Column) -> Column:
    """Lower-cased first letter or digit; ``_`` if the text starts with anything else."""
    first = F.lower(F.left(x, F.lit(1)))
    return F.when(F.rlike(first, F.lit(r"^[\p{L}\p{N}]")), first).otherwise("_")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_ext(path: Column) -> Column:
    """From the last dot of the base name on, or empty."""
    return F.regexp_extract(base_name(path), r"\.[^.]*\z", 0)


def output_name(file: Column, value: Column) -> Column:
    """``a/RS_x.zst`` and ``v`` -> ``a/RS_x_v.zst``."""
    ext = file_ext(file)
    stem = F.left(file, F.char_length(file) - F.char_length(ext))
    return F.concat(stem, F.lit("_"), sanitize_filename(value), ext)


def config_hash(field: Column, value: Column, regex: Column, partial: Column, file_filter: Column) -> Column:
    """SHA-256, in hex, of the settings that decide which lines are kept."""
    parts = [field, value, regex.cast("string"), partial.cast("string"), file_filter]
    return F.sha2(F.concat_ws(":", *parts), 256)
