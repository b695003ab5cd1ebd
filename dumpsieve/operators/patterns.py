"""Long lists of regular expressions, by the literals they require.

Every match of most patterns holds some fixed text. Case-folded and with single spaces, this text is looked for with
the index of ``contained``; only pairs of a row and a pattern whose text was found are searched, with RE2. Patterns that are
nothing but text, up to the lengths of runs of spaces, are decided by the index: RE2 takes a thousand times longer to compile
such a line than the line takes to be compared. So the plan is the same for any number of patterns, and no task holds them. Patterns that require nothing (or very little) have to
be tried on every row: those go, joined, to all tasks.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpsieve.functions.regex import check_re2
from dumpsieve.functions.text import fold
from dumpsieve.operators.contained import MATCH, MATCH_AS_IS, PATTERN, fingerprint, flag_rows, marked, occurrences
from dumpsieve.sources.scan import shared_folder, stage

SHORTEST = 3  # characters of a required text that is worth looking for
JOINED_BYTES = 32 << 10  # of the patterns without such a text that are searched as one
PLAIN_BYTES = 512 << 10  # of a pattern of text alone that RE2 accepts for sure; it takes 698,880

_REPEAT = re.compile(r"(?:[*?+]|\{(\d+)(?:,\d*)?\})\??")
_CLASS = re.compile(r"\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\]", re.DOTALL)
_ESCAPE = re.compile(r"\\(?:x\{[^}]*\}|x..|[pP]\{[^}]*\}|[pP].|[0-7]{1,3}|.)", re.DOTALL)
_OPENING = re.compile(r"\((?:\?P?<\w+>|\?[A-Za-z-]*:)?")
_FLAGS = re.compile(r"\(\?[A-Za-z-]+\)")

# Patterns that are text alone: all their spaces take any number, or each stands for itself.
_TEXT = r"""[^\\\[\](){}.*+?^$| ]++|\\[!-/:-@\[-^`{-~]"""
_ANY_SPACES = re.compile(rf"(?:{_TEXT}| \+(?! ))*+")
_OWN_SPACES = re.compile(rf"(?:{_TEXT}| (?! ))*+")
_ESCAPED = re.compile(r"\\(.)")

# The functions below run inside tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def required_texts(pattern: str, spaced: bool = False) -> list[str]:
    """Texts of which every match of the RE2 pattern holds one, up to case; none if nothing is known.

    ``spaced``: up to the lengths of runs of spaces too, so that `` +`` does not end a text.
    """
    if r"\Q" in pattern:
        return []
    found, end = _alternatives(pattern, 0, spaced)
    return found if end == len(pattern) and found and min(map(len, found)) >= SHORTEST else []


def _alternatives(pattern: str, at: int, spaced: bool) -> tuple[list[str], int]:
    """What is required up to the end of the group that begins at ``at``: one text for each alternative."""
    known, all_known = [], True
    while True:
        texts, at = _sequence(pattern, at, spaced)
        known += texts
        all_known &= bool(texts)
        if at >= len(pattern) or pattern[at] == ")":
            return (sorted(set(known)) if all_known else []), at
        at += 1  # a bar


def _sequence(pattern: str, at: int, spaced: bool) -> tuple[list[str], int]:
    """The part of one alternative that is best to look for, and where the alternative ends."""
    best, run = [], ""

    def offer(texts: list[str]) -> None:
        nonlocal best
        if texts and (not best or min(map(len, texts)) > min(map(len, best))):
            best = texts

    while at < len(pattern) and pattern[at] not in "|)":
        literal, inner, char = "", [], pattern[at]
        if flags := _FLAGS.match(pattern, at):
            at = flags.end()
        elif char == "(":
            inner, at = _alternatives(pattern, _OPENING.match(pattern, at).end(), spaced)
            at += 1
        elif char == "[":
            bracket = _CLASS.match(pattern, at)
            at = bracket.end() if bracket else len(pattern) + 1  # not understood: nothing is known
        elif char == "\\":
            escape = _ESCAPE.match(pattern, at)
            literal = escape[0][1] if len(escape[0]) == 2 and not escape[0][1].isalnum() else ""
            at = escape.end()
        else:
            literal = "" if char in ".^$" else char
            at += 1
        repeat = _REPEAT.match(pattern, at)
        if repeat:
            at = repeat.end()
            if repeat[0][0] in "*?" or repeat[1] is not None and int(repeat[1]) == 0:
                literal, inner = "", []
            run += literal
            literal = literal if spaced and literal == " " else ""
        else:
            run += literal
        if not literal:
            offer([run] if run else [])
            offer(inner)
            run = ""
    offer([run] if run else [])
    return best, at


def plain_text(pattern: str) -> tuple[str, int] | None:
    """Text such that the RE2 pattern is found where the text is, by what its kind says; None if the pattern says more than that.

    ``MATCH``: found in texts of which the form with single spaces holds the text. ``MATCH_AS_IS``: in those that hold it.
    """
    if len(pattern) > PLAIN_BYTES // 4:
        return None
    if _ANY_SPACES.fullmatch(pattern):
        text, kind = _ESCAPED.sub(r"\1", pattern.replace(" +", " ")), MATCH
    elif _OWN_SPACES.fullmatch(pattern):
        text, kind = _ESCAPED.sub(r"\1", pattern), MATCH_AS_IS
    else:
        return None
    return (text, kind) if len(text) >= SHORTEST else None


def _file_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per plain text, and per pattern and text that it may require; ``wrong`` says why RE2 refuses it."""
    for batch in batches:
        rows = []
        for pattern in batch.column("item").to_pylist():
            if plain := plain_text(pattern):
                rows.append((plain[0], None, None, plain[1]))
                continue
            try:
                check_re2(pattern)
            except ValueError as err:
                rows.append((pattern, None, str(err), PATTERN))
                continue
            rows += [(pattern, text, None, PATTERN) for text in required_texts(pattern, spaced=True) or [None]]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string()] * 3 + [pa.int32()])]
        yield pa.RecordBatch.from_arrays(columns, names=["pattern", "low", "wrong", "kind"])


def _search_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in which their pattern is found."""
    for batch in batches:
        groups = pa.table({"pattern": batch.column("pattern"), "at": pa.array(range(batch.num_rows), pa.int64())})
        for pattern, places in zip(*groups.group_by("pattern").aggregate([("at", "list")]).select(["pattern", "at_list"]).columns):
            part = batch.take(places.values)
            hit = pc.match_substring_regex(part.column("text"), pattern.as_py())
            yield pa.RecordBatch.from_arrays([part.column("row").filter(hit)], names=["row"])


def _joined(patterns: list[str]) -> list[str]:
    """Alternatives of bounded length that match what any of the patterns does."""
    out, size = [[]], 0
    for pattern in patterns:
        if out[-1] and size + len(pattern) > JOINED_BYTES:
            out.append([])
            size = 0
        out[-1].append(f"(?:{pattern})")
        size += len(pattern)
    return ["|".join(group) for group in out if group]


def _any_of(rows: DataFrame, x: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found in ``x``: one function, however many there are."""
    if not patterns:
        return F.lit(False)
    held = rows.sparkSession.sparkContext.broadcast(_joined(patterns))

    @F.arrow_udf("boolean")
    def search(values: pa.Array) -> pa.Array:
        found = pc.match_substring_regex(values, held.value[0])
        for joined in held.value[1:]:
            found = pc.or_(found, pc.match_substring_regex(values, joined))
        return found

    return search(x)


def _plain(x: Column) -> Column:
    """Case-folded, with single spaces."""
    return F.regexp_replace(fold(x), " {2,}", " ")


def flag_patterns(rows: DataFrame, x: Column, items: DataFrame, folder: str | None = None) -> DataFrame:
    """Add ``matched`` to the rows: some RE2 pattern ``item`` is found in ``x``; NULL or false where none is.

    Empty and null patterns match nothing, and nothing matches a null ``x``. A pattern that RE2 refuses raises
    ``ValueError``. The rows are staged below ``folder`` (a fresh shared one if there is none) and change their
    order. Patterns without a required text of ``SHORTEST`` characters pass the driver.
    """
    folder = folder or shared_folder(rows.sparkSession, "patterns")
    items = items.select("item").where("item <> ''")
    filed = stage(
        items.mapInArrow(_file_patterns, "pattern string, low string, wrong string, kind int").withColumn("low", _plain(F.col("low"))),
        folder + "/patterns",
    )
    for row in filed.where("wrong is not null").limit(1).collect():
        raise ValueError(row.wrong)
    no_text = filed.where(f"kind = {PATTERN} and low is null")
    free = sorted(r.pattern for r in no_text.select("pattern").distinct().toLocalIterator())
    held = stage(
        rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_free", _any_of(rows, x, free)),
        folder + "/tested",
    )
    # Rows that a pattern tried on all of them has matched need no other.
    open_rows = held.where("not _free").select(F.col("_row").alias("row"), x.alias("text")).where("text <> ''")
    with_text = filed.where(f"kind <> {PATTERN} or low is not null")
    lows = with_text.select(F.coalesce("low", "pattern").alias("low"), "kind")
    said = stage(occurrences(open_rows, lows, folder), folder + "/said")
    sure, pairs = said.where("print is null").select("row"), said.where("print is not null")
    if not pairs.isEmpty():
        searched = filed.where(f"kind = {PATTERN} and low is not null").withColumn("print", fingerprint(F.col("low")))
        asked = marked(open_rows, "row", pairs).where("marked").drop("marked")
        both = pairs.join(searched, "print").select("row", "pattern").distinct().join(asked, "row")
        sure = sure.union(stage(both.mapInArrow(_search_pairs, "row long"), folder + "/searched"))
    free_rows = held.where("_free").select(F.col("_row").alias("row"))
    return flag_rows(held.drop("_free"), sure.union(free_rows) if free else sure)
