"""Regular-expression search with RE2 meaning.

Java's engine differs from RE2 in what ``.``, ``$``, ``\\s``, ``\\b`` and ``(?i)``
mean and, above all, backtracks: a pattern that RE2 answers in linear time can
take a task down.  Patterns built only from literals and a few harmless
constructs mean the same in both and run in the JVM as ``rlike``.  All others go,
batch by batch, to the RE2 kernel that ships with Arrow.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# One token of a pattern that both engines read alike, without repetition.
_SAFE_TOKEN = re.compile(
    r"""[A-Za-z0-9 _\-,:;@#%&=!~<>/"'|.)]     # literals, alternation, any character
      | \\[.\-+*?()\[\]|^$/{}\\]              # escaped punctuation
      | \\d
      | \((?!\?)                              # plain group
      | \[\^?(?:[A-Za-z0-9_](?:-[A-Za-z0-9_])?|[ ,:;@#%=!~<>/.])+\]
    """,
    re.VERBOSE,
)


def check_re2(pattern: str) -> None:
    """Raise ``ValueError`` if RE2 does not accept the pattern."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid as err:
        raise ValueError(f"{pattern!r} is no RE2 pattern: {err}") from err
    if re.search(r"(?<!\\)(?:\\\\)*\\C", pattern):
        raise ValueError(f"{pattern!r} asks for \\C, which is left out")


def java_equivalent(pattern: str) -> str | None:
    """The pattern for ``rlike`` if it is safe and means the same there."""
    body, head, tail = pattern, "(?d)", ""
    if body.startswith("^") and "|" not in body:
        head, body = "(?d)^", body[1:]
    if body.endswith(".*") and not body.endswith("\\.*"):
        body = body[:-2]  # a search that got here has already succeeded
    elif body.endswith("$") and not body.endswith("\\$") and "|" not in body:
        body, tail = body[:-1], r"\z"
    at = 0
    while at < len(body):
        token = _SAFE_TOKEN.match(body, at)
        if token is None:
            return None
        at = token.end()
    return head + body + tail


def re2_search(x: Column, pattern: str) -> Column:
    """True where ``pattern`` matches somewhere in ``x``."""
    check_re2(pattern)
    same = java_equivalent(pattern)
    if same is not None:
        return F.rlike(x, F.lit(same))

    @F.arrow_udf("boolean")
    def search(values: pa.Array) -> pa.Array:
        return pc.match_substring_regex(values, pattern)

    return search(x)
