"""Text of record values: typed access, default formatting, times, links, CSV."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the output format.
SITE = "https://www.reddit.com"
MISSING_TIME = "None"
NULL_TEXT = "<nil>"
LINK_ID_PREFIX = "t3_"

_DAYS_IN_400_YEARS = 146_097
_FOUR_DIGIT_YEARS = (-62_135_596_800, 253_402_300_799)  # years 1 to 9999
_MIN_BIGINT = -(2**63)


def json_type(v: Column) -> Column:
    """BIGINT, DECIMAL(p,s), DOUBLE, STRING, BOOLEAN, VOID, ARRAY<..> or OBJECT<..>; NULL if absent."""
    return F.schema_of_variant(v)


def is_string(v: Column) -> Column:
    return json_type(v) == "STRING"


def string_or_null(v: Column) -> Column:
    """The string held by a variant; NULL for an absent key or any other type."""
    return F.when(is_string(v), v.cast("string"))


def string_or_empty(v: Column) -> Column:
    return F.coalesce(string_or_null(v), F.lit(""))


# ---------------------------------------------------------------- default text


def _let(x: Column, body) -> Column:
    """``body(x)`` with ``x`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _shortest_general(number: Column) -> Column:
    """Decimal text -> shortest ``%g`` text: an exponent below 1e-4 and from 1e6 up."""
    # sign, digits before the point, digits behind it, exponent
    parts = F.split(
        F.regexp_replace(F.upper(number), r"^(-?)([0-9]*)\.?([0-9]*)(?:E([-+]?[0-9]+))?\z", "$1,$2,$3,$4"), ","
    )

    def layout(p: Column) -> Column:
        written = F.concat(p[1], p[2])
        digits = F.trim(written, F.lit("0"))
        shift = F.coalesce(p[3].try_cast("int"), F.lit(0))
        leading = F.length(written) - F.length(F.ltrim(written, F.lit("0")))
        point = F.length(p[1]) + shift - leading  # digits in front of the decimal point
        return F.struct(p[0].alias("sign"), digits.alias("digits"), point.alias("point"))

    def text(n: Column) -> Column:
        digits, point = n["digits"], n["point"]
        count = F.length(digits)
        scientific = F.concat(
            F.left(digits, F.lit(1)),
            F.when(count > 1, F.lit(".")).otherwise(""),
            F.substring(digits, F.lit(2), count),
            F.when(point < 1, "e-").otherwise("e+"),
            F.when(F.abs(point - 1) < 10, "0").otherwise(""),
            F.abs(point - 1).cast("string"),
        )
        return (
            F.when((point < -3) | (point > 6), scientific)
            .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= count, F.rpad(digits, point, F.lit("0")))
            .otherwise(F.concat(F.left(digits, point), F.lit("."), F.substring(digits, point + 1, count)))
        )

    def signed(n: Column) -> Column:
        return F.concat(n["sign"], F.when(F.length(n["digits"]) == 0, "0").otherwise(text(n)))

    return _let(_let(parts, layout), signed)


def _number_text(written: Column, number_style: str) -> Column:
    """Text of a number from its JSON form."""
    if number_style == "plain":
        return F.when(written == "-0.0", "-0").otherwise(written)
    # Up to 15 digits a decimal is its own shortest form; past that the double decides.
    few_digits = F.length(F.regexp_replace(written, r"[eE].*|^-?0*|\.", "")) <= 15
    shortest = F.when(few_digits, written).otherwise(written.cast("double").cast("string"))
    return _shortest_general(shortest)


# Below 1e6, at least 1e-4 or 0, and at most 15 digits.
_PLAIN_NUMBER = r"^-?(?:[1-9][0-9]{0,5}(?:\.[0-9]{1,9})?|0(?:\.(?!0000)[0-9]{1,15})?)\z"

# A JSON string, a number or word, or one mark of structure.
_JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^",:\[\]{}]++|[,:\[\]{}]'


def default_text(v: Column, number_style: str = "g") -> Column:
    """Text of a value of any type; empty for an absent key.

    Numbers are doubles in shortest ``%g`` form (``number_style='plain'`` keeps
    their digits), null is ``<nil>``, arrays are ``[a b]`` and objects ``map[k:v]``
    in the order of their keys.
    """
    kind = json_type(v)
    # Most numbers need no exponent and few digits: their plain text is the shortest.
    exact = (kind == "BIGINT") | F.startswith(kind, F.lit("DECIMAL"))
    plain = exact & F.rlike(v.cast("string"), F.lit(_PLAIN_NUMBER))

    def token_text(token: Column) -> Column:
        return (
            F.when(F.startswith(token, F.lit('"')), F.parse_json(token).cast("string"))
            .when(F.rlike(token, F.lit("^[-0-9]")), _number_text(token, number_style))
            .when(token == "{", "map[").when(token == "}", "]")
            .when(token == ",", " ").when(token == "null", NULL_TEXT)
            .otherwise(token)
        )

    tokens = F.regexp_extract_all(F.to_json(v), F.lit(_JSON_TOKEN), F.lit(0))
    return (
        F.when(v.isNull(), "")
        .when(kind == "STRING", v.cast("string"))
        .when(plain, v.cast("string"))
        .otherwise(F.array_join(F.transform(tokens, token_text), ""))
    )


# ---------------------------------------------------------------- creation time


def parse_created(v: Column) -> Column:
    """Seconds held by a variant: numbers lose their fraction, digit strings are read, all else is 0."""
    kind = json_type(v)
    number = F.coalesce(v.try_cast("double").try_cast("bigint"), F.lit(_MIN_BIGINT))
    text = v.cast("string")
    digits = F.when(F.rlike(text, F.lit(r"^[+-]?[0-9]+\z")), text.try_cast("bigint"))
    return (
        F.when((kind == "BIGINT") | (kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")), number)
        .when(kind == "STRING", F.coalesce(digits, F.lit(0)))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def format_created(seconds: Column) -> Column:
    """Unix seconds -> ``YYYY-MM-DD HH:MM`` in UTC, whatever the session zone."""
    return _let(
        seconds,
        lambda s: F.when(s.between(*_FOUR_DIGIT_YEARS), _plain_time(s)).otherwise(_any_time(s)),
    )


def _plain_time(seconds: Column) -> Column:
    moment = F.lit("1970-01-01").cast("timestamp_ntz") + F.lit(timedelta(seconds=1)) * seconds
    return F.left(moment.cast("string"), F.lit(16))


def _any_time(seconds: Column) -> Column:
    """Days are reduced by whole 400-year cycles, so any BIGINT stays in date range."""
    in_day = F.pmod(seconds, F.lit(86_400))
    # Dividing before subtracting keeps the smallest BIGINT in range.
    days = F.call_function("div", seconds, F.lit(86_400)) - F.when(
        (seconds < 0) & (in_day != 0), 1
    ).otherwise(0)
    in_cycle = F.pmod(days, F.lit(_DAYS_IN_400_YEARS))
    cycles = F.call_function("div", days - in_cycle, F.lit(_DAYS_IN_400_YEARS))
    same_day = _plain_time(in_cycle * 86_400 + in_day)  # of a year from 1970 on
    year = F.left(same_day, F.lit(4)).cast("bigint") + cycles * 400
    digits = F.abs(year).cast("string")
    year_text = F.concat(
        F.when(year < 0, "-").otherwise(""), F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))
    )
    return F.concat(year_text, F.substring(same_day, 5, 12))


# ---------------------------------------------------------------- links


def trim_prefix(x: Column, prefix: str = LINK_ID_PREFIX) -> Column:
    """Drop the prefix once, if it is there."""
    return F.when(
        F.startswith(x, F.lit(prefix)), F.substring(x, F.lit(len(prefix) + 1), F.char_length(x))
    ).otherwise(x)


def link_from_parts(subreddit: Column, link_id: Column, id_: Column) -> Column:
    return F.concat(
        F.lit(SITE + "/r/"),
        string_or_empty(subreddit),
        F.lit("/comments/"),
        trim_prefix(string_or_empty(link_id)),
        F.lit("/_/"),
        string_or_empty(id_),
        F.lit("/"),
    )


# ---------------------------------------------------------------- CSV

# A field with one of these, or starting with one of the spaces, is quoted.
_QUOTED_CHARS = ('"', ",", "\n", "\r")
_LEADING_SPACE = r"^[\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def csv_quote(x: Column) -> Column:
    """One CSV field: quoted only where needed, quotes doubled, empty left empty."""
    needed = F.rlike(F.left(x, F.lit(1)), F.lit(_LEADING_SPACE)) | (x == "\\.")
    for char in _QUOTED_CHARS:
        needed = needed | F.contains(x, F.lit(char))
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(needed, quoted).otherwise(x)


def csv_line(columns: list[Column]) -> Column:
    return F.concat_ws(",", *[csv_quote(c) for c in columns])
