"""Strict decoding of one JSON object per line.

``from_json`` with VARIANT fields keeps the JSON type of each key that a query
reads, skips the others without building them, keeps the last of duplicate keys
and refuses single quotes, ``NaN``, leading zeros and raw control characters.
What it does not notice by itself is handled here, still in a single parse:

* *text after the object*: the line is decoded as the first of two elements of an
  array, the second being an end mark that holds a hash of the line.  Whatever the
  line lacks or has too much, the mark is then not found in its place;
* *a line* ``null``, which counts as an empty record;
* *numbers too large for a double*, which make the line bad;
* *lone surrogate escapes*, which become U+FFFD;
* *zeros with a sign*, which are doubles that keep it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END_MARK = "_end"

# Depth of JSON, with one more level for the array that frames a line; numbers as long as a line may be.
MAX_DEPTH = 10_000
_OPTIONS = {
    "allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
    "maxNestingDepth": str(MAX_DEPTH + 1), "maxNumLen": "20000000",
}
_NULL_RECORD = r"^[ \t\r\n]*+null[ \t\r\n]*+\z"
# Of every number that may overflow; one digit first, so that most characters are passed with one comparison.
_MAYBE_HUGE = r"[0-9](?:[eE]\+?[0-9]{3}|[0-9]{199})"
# A zero with a sign, which decoding as a whole number or a decimal would lose.
_SIGNED_ZERO = r"(?<![0-9.eE])-0(?:\.0++)?(?:[eE][+-]?[0-9]++)?(?![0-9.eE])"
_NUMBER = r"-?[0-9][0-9.]*+(?:[eE][+-]?[0-9]++)?"
_LONE_HIGH = r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F][0-9a-fA-F]{2})"
_LONE_LOW = r"(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}"


def _lit(text: str) -> Column:
    return F.lit(text)


def _without_lone_surrogates(line: Column) -> Column:
    """Lone surrogate escapes -> ``\\ufffd``; runs only on lines with such escapes."""
    # Once escaped backslashes are spelt out, every backslash starts an escape.
    plain = F.replace(line, _lit("\\\\"), _lit("\\u005c"))
    mended = F.regexp_replace(F.regexp_replace(plain, _LONE_HIGH, r"\\ufffd"), _LONE_LOW, r"\\ufffd")
    surrogates = F.contains(line, _lit("\\ud")) | F.contains(line, _lit("\\uD"))
    return F.when(F.contains(line, _lit("\\u")) & surrogates, mended).otherwise(line)


def _with_signed_zeros(line: Column) -> Column:
    """``-0`` outside strings -> ``-0e0``, which is decoded as a double; runs only on lines that hold one somewhere."""
    # Without escaped backslashes and quotes, every quote begins or ends a string.
    plain = F.replace(F.replace(line, _lit("\\\\"), _lit("\\u005c")), _lit('\\"'), _lit("\\u0022"))
    parts = F.regexp_extract_all(plain, _lit('"[^"]*+"?|[^"]++'), _lit(0))
    mended = F.transform(
        parts, lambda p: F.when(F.startswith(p, _lit('"')), p).otherwise(F.regexp_replace(p, _SIGNED_ZERO, "-0e0"))
    )
    there = F.contains(line, _lit("-0")) & F.rlike(line, _lit(_SIGNED_ZERO))
    return F.when(there, F.array_join(mended, "")).otherwise(line)


def has_overflowing_number(line: Column) -> Column:
    """True if a number anywhere in the JSON line does not fit a double."""
    no_escapes = F.replace(F.replace(line, _lit("\\\\"), _lit("")), _lit('\\"'), _lit(""))
    outside_strings = F.regexp_replace(no_escapes, '"[^"]*+"', "")
    numbers = F.regexp_extract_all(outside_strings, _lit(_NUMBER), _lit(0))
    overflows = F.exists(numbers, lambda n: F.abs(n.try_cast("double")) == F.lit(float("inf")))
    return F.when(F.rlike(line, _lit(_MAYBE_HUGE)), overflows).otherwise(F.lit(False))


def _overflows(v: Column) -> Column:
    return (F.schema_of_variant(v) == "DOUBLE") & (F.abs(v.cast("double")) == F.lit(float("inf")))


def parse_ndjson(
    lines: DataFrame, keys: list[str], value: str = "value", all_numbers: bool = True
) -> DataFrame:
    """Add one VARIANT column per key and the flag ``is_bad``.

    An absent key is SQL NULL, a JSON null is a variant of type VOID.  Blank lines
    (empty ``value``) and null values are neither good nor bad: ``is_bad`` is NULL.

    Numbers too large for a double make a line bad wherever they stand; without
    ``all_numbers`` they are looked for in the keys that are read only.
    """
    line = F.col(value)
    mark = F.xxhash64(line).cast("string")
    present = line.isNotNull() & (line != "")
    schema = ", ".join([f"`{k}` VARIANT" for k in keys] + [f"{END_MARK} STRING"])
    framed = F.concat(
        _lit("["), _with_signed_zeros(_without_lone_surrogates(line)), _lit(f',{{"{END_MARK}":"'), mark, _lit('"}]')
    )
    both = F.from_json(F.when(present, framed), f"array<struct<{schema}>>", _OPTIONS)
    # inline() computes the parse once and keeps the optimizer from copying it into
    # every place that reads a key.
    decoded = lines.select("*", F.inline(F.array(F.struct(both.alias("_both")))))
    record, end = F.get("_both", F.lit(0)), F.get("_both", F.lit(1))
    whole = (F.size("_both") == 2) & end[END_MARK].eqNullSafe(mark)
    no_object = record.isNull() & ~F.rlike(line, _lit(_NULL_RECORD))
    bad = ~F.coalesce(whole, F.lit(False)) | no_object
    if all_numbers:
        bad = bad | has_overflowing_number(line)
    else:
        for k in keys:
            bad = bad | F.coalesce(_overflows(record[k]), F.lit(False))
    return decoded.select(
        *lines.columns, *[record[k].alias(k) for k in keys], F.when(present, bad).alias("is_bad")
    )
