"""How filters interact: what each removes behind the others, in every order."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpsieve.llm.scan import join_counted
from dumpsieve.llm.shared import stored, text_chunks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTERS = "ABCDE"
_SPECIAL = b"#$%&*|"
_RANGE_BITS = 16  # ids of one range of posting lists
_BLOCK = 256


# ---------------------------------------------------------------- what fails


def _failures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: texts -> ``mask`` of the filters A to D that they fail (bit 0 to 3)."""
    for batch in batches:
        for chunk in text_chunks(iter([batch])):
            texts = pc.fill_null(chunk.column("text"), "").cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]

            def count(of: np.ndarray) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(of)])
                return np.diff(total[offsets - offsets[0]])

            points = count(data & 0xC0 != 0x80)
            capitals = count((data >= 65) & (data <= 90))
            special = count(np.isin(data, np.frombuffer(_SPECIAL, np.uint8)))
            split = pc.ascii_split_whitespace(texts)
            rows, words = pc.list_parent_indices(split), pc.list_flatten(split)
            there = pc.not_equal(words, "")
            rows, words = rows.filter(there).to_numpy().astype(np.int64), pc.dictionary_encode(words.filter(there))
            n_words = np.bincount(rows, minlength=len(texts))
            pairs = np.unique(rows * max(1, len(words.dictionary)) + words.indices.to_numpy())
            distinct = np.bincount(pairs // max(1, len(words.dictionary)), minlength=len(texts))
            failed = [n_words < 100, 100 * distinct < 80 * n_words, 100 * capitals > 10 * points, special > 0]
            mask = sum(f.astype(np.int64) << i for i, f in enumerate(failed))
            names = [n for n in chunk.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[chunk.column(n) for n in names], pa.array(mask.astype(np.int32))], names=[*names, "mask"])


def failing_filters(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part, row, doc_id, mask`` per row of ``docs``; bit i of ``mask`` is set if it fails filter i of ABCDE.

    A: under 100 words; B: fewer than 80 % of the words distinct; C: more than 10 % of the
    code points in A-Z; D: holds one of #$%&*|; E: a smaller id has the same text. Null
    text and part are empty; a null id is not smaller than another, nor has it a smaller
    one. Rows that repeat an id are documents of their own, none of them the smaller.
    ``row`` is dense within each task that read the table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("same"), text.alias("text"),
    )
    rows = stored(rows.mapInArrow(_failures, "part string, row long, doc_id long, same binary, mask int"), "failures")
    # A null id takes no part: neither is it smaller nor has it a smaller one.
    first = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = stored(first, "same-texts")
    met = join_counted(rows, first, ["same"], "n", rows.count(), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return met.select("part", "row", "doc_id", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


# ---------------------------------------------------------------- posting lists


def gallop(probes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where each of the sorted ``probes`` stands, or would stand, in the sorted ``ids``.

    For a block of probes the step ahead doubles until it is past the block; the block is
    then searched in that window only, and the next one starts where it ended.
    """
    out, at = np.empty(len(probes), np.int64), 0
    for begin in range(0, len(probes), _BLOCK):
        block, step = probes[begin : begin + _BLOCK], _BLOCK
        while at + step < len(ids) and ids[at + step] < block[-1]:
            step *= 2
        found = at + np.searchsorted(ids[at : at + step + 1], block)
        out[begin : begin + len(block)], at = found, int(found[-1])
    return out


def _held(probes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the probes are among the ids."""
    if not len(ids):
        return np.zeros(len(probes), bool)
    at = gallop(probes, ids)
    return ids[np.minimum(at, len(ids) - 1)] == probes


def difference(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if len(left) <= len(right):
        return left[~_held(left, right)]
    at = gallop(right, left)
    inside = at < len(left)
    at = at[inside][left[at[inside]] == right[inside]]
    return np.delete(left, at)


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Of sorted lists without repeats: the shorter ones gallop through what is merged so far, the longest first."""
    merged = np.zeros(0, np.int64)
    for ids in sorted(lists, key=len, reverse=True):
        new = difference(ids, merged)
        merged = np.insert(merged, gallop(new, merged), new) if len(merged) else new
    return merged


def _sizes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """What each filter removes behind each set of others, for the lists of one part and range."""
    table = table.sort_by("row")
    ids, mask = table["row"].to_numpy(), table["mask"].to_numpy()
    good, toxic = ids[table["good"].to_numpy()], ids[table["toxic"].to_numpy()]
    failing = [ids[mask >> i & 1 == 1] for i in range(len(FILTERS))]
    unions = {s: union([failing[i] for i in s]) for k in range(len(FILTERS)) for s in combinations(range(len(FILTERS)), k)}
    out = []
    for i in range(len(FILTERS)):
        for earlier, gone in unions.items():
            if i not in earlier:
                removed = difference(failing[i], gone)
                out.append((
                    key[0].as_py(), i, sum(1 << j for j in earlier), len(removed), len(failing[i]) - len(removed),
                    len(gone) + len(removed), int(_held(removed, good).sum()), int(_held(removed, toxic).sum()),
                ))
    names = ["part", "filter", "earlier", "removed", "redundant", "gone", "good_lost", "toxic_lost"]
    return pa.table(dict(zip(names, zip(*out)))).cast(_SIZES)


_COUNTS = ("removed", "redundant", "gone", "good_lost", "toxic_lost")
_SIZES = pa.schema([("part", pa.string()), ("filter", pa.int32()), ("earlier", pa.int32()), *[(c, pa.int64()) for c in _COUNTS]])


def interaction_sizes(failing: DataFrame) -> DataFrame:
    """``part, filter, earlier`` and the counts of _COUNTS, for every filter and set of earlier ones that occur.

    ``failing``: part, row, mask, good, toxic. The rows that fail something are dealt by
    part and range of ids, so a list never holds more than a range; a part of any size is
    worked on by many tasks, and sizes add up over the ranges.
    """
    some = failing.filter("mask <> 0").withColumn("range", F.shiftright("row", _RANGE_BITS))
    parts = some.groupBy("part", "range").applyInArrow(
        _sizes, "part string, filter int, earlier int, " + ", ".join(f"{c} long" for c in _COUNTS)
    )
    return parts.groupBy("part", "filter", "earlier").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def audit_filters(
    docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per part, order of the five filters and step, with the counts of that step.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (see README). All 120 orders and 5 steps of every part are there,
    zeros too. A document is good (toxic) if any of its rows in ``labels`` says 1; labels
    without an id say nothing. For nulls and repeated ids see :func:`failing_filters`. An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    masks = stored(failing_filters(docs, part_col, id_col, text_col), "masks")
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    labelled = masks.filter("mask <> 0").join(said.filter("doc_id IS NOT NULL"), "doc_id", "left").select(
        "part", "row", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    )
    sizes = interaction_sizes(labelled)

    cases = [(i, s) for i in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s >> i & 1]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("filter"), F.lit(s).alias("earlier")) for i, s in cases])).alias("case")
    totals = masks.groupBy("part").agg(F.count("*").alias("total")).select("part", "total", each).select("part", "total", "case.*")
    full = totals.join(sizes, ["part", "filter", "earlier"], "left").na.fill(0, list(_COUNTS))
    # Of 120 orders, so many have exactly these filters before this one.
    k = F.bit_count("earlier")
    times = F.element_at(F.array(*[F.lit(factorial(i) * factorial(len(FILTERS) - 1 - i)) for i in range(len(FILTERS))]), k + 1)
    others = F.element_at(F.array(*[F.lit((1 << len(FILTERS)) - 1 - (1 << i)) for i in range(len(FILTERS))]), F.col("filter") + 1)
    over = full.groupBy("part", "filter").agg(
        F.sum(times * F.col("removed")).alias("shapley"),
        F.max(F.when(F.col("earlier") == others, F.col("removed"))).alias("unique_fails"),
    )
    orders = []
    for order in permutations(range(len(FILTERS))):
        for step, i in enumerate(order):
            orders.append(("".join(FILTERS[j] for j in order), step + 1, i, sum(1 << j for j in order[:step])))
    orders = spark.createDataFrame(orders, "filter_order string, step int, filter int, earlier int")  # 600 rows
    found = full.join(over, ["part", "filter"]).join(F.broadcast(orders), ["filter", "earlier"])
    return found.select(
        "part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), "removed", "redundant",
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
