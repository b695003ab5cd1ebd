"""Records as flat tables of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpsieve.functions import values as v
from dumpsieve.functions.json_lines import parse_ndjson
from dumpsieve.specs import COMMENT_COLUMNS, SUBMISSION_COLUMNS

COLUMNS = {"submission": SUBMISSION_COLUMNS, "comment": COMMENT_COLUMNS}

# The keys each column reads.
_LINK_KEYS = ("permalink", "subreddit", "link_id", "id")
_KEYS = {"created": ("created_utc",), "link": _LINK_KEYS, "text": ("selftext",)}


def keys_for(columns: tuple[str, ...]) -> list[str]:
    """The JSON keys that the columns need; no others are decoded."""
    return list(dict.fromkeys(k for c in columns for k in _KEYS.get(c, (c,))))


def col_author(author: Column) -> Column:
    return F.when(v.is_string(author), F.concat(F.lit("u/"), author.cast("string"))).otherwise("")


def col_created(created_utc: Column) -> Column:
    return F.when(created_utc.isNull(), v.MISSING_TIME).otherwise(
        v.format_created(v.parse_created(created_utc))
    )


def col_link(permalink: Column, subreddit: Column, link_id: Column, id_: Column) -> Column:
    own = F.concat(F.lit(v.SITE), permalink.cast("string"))
    return F.when(v.is_string(permalink), own).otherwise(v.link_from_parts(subreddit, link_id, id_))


def col_text(selftext: Column) -> Column:
    return v.string_or_empty(selftext)


def col_url(url: Column) -> Column:
    return v.string_or_empty(url)


def col_default(x: Column, number_style: str = "g") -> Column:
    return v.default_text(x, number_style)


def column(name: str, number_style: str = "g") -> Column:
    """One output column over the decoded keys; never NULL."""
    if name == "author":
        made = col_author(F.col("author"))
    elif name == "created":
        made = col_created(F.col("created_utc"))
    elif name == "link":
        made = col_link(*[F.col(k) for k in _LINK_KEYS])
    elif name == "text":
        made = col_text(F.col("selftext"))
    elif name == "url":
        made = col_url(F.col("url"))
    else:
        made = col_default(F.col(name), number_style)
    return made.alias(name)


def project(
    lines: DataFrame, kind: str, number_style: str = "g", keep: tuple[str, ...] = (), value: str = "value"
) -> DataFrame:
    """The records of the good lines as the table of a kind, after the columns to ``keep``."""
    columns = COLUMNS[kind]
    parsed = parse_ndjson(lines, keys_for(columns), value)
    return parsed.where(~F.col("is_bad")).select(*keep, *[column(c, number_style) for c in columns])


def project_submission(lines: DataFrame, **options) -> DataFrame:
    return project(lines, "submission", **options)


def project_comment(lines: DataFrame, **options) -> DataFrame:
    return project(lines, "comment", **options)
