"""Which texts contain a value of a list that is too long for one automaton.

The list becomes an index: each value is filed under one run of ``GRAM`` of its characters (of ``SHORT`` in a shorter
value, all of a still shorter one), the one whose runs are rarest in the list, with its place, its length and a fingerprint
of 128 bits of SHA-256. The runs of every text that a bitmap of the index lets pass meet the index in a join, and what meets
is looked up in the text: the characters at that place must have the fingerprint. So no task and not the driver holds
the list: they hold counters and bitmaps of a fixed size, values themselves are not exchanged, texts once and only those
with a run that passed, and lines without a candidate cost one pass over their text.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpsieve.functions.text import fold_table, lower_table
from dumpsieve.sources.scan import shared_folder, stage

GRAM, SHORT = 16, 8  # characters of a run; values below the first are filed under one of the second at most
COUNTERS = 1 << 20  # of runs in the list; 8 MiB
BITS = 1 << 28  # at most, of the bitmap of the runs of one width; 32 MiB
PLACES = 4  # bits that a run sets
_WINDOW = 1 << 20  # characters of the list looked at together
_STRETCH = 1 << 17  # of texts
_BITMAP = 32768  # bits in one bitmap of Spark's bitmap functions
MARKS = 1 << 20  # words of 64 rows that are broadcast, about 60 MB; more are joined

# What a value at its place says: a pattern is to be searched, there is a match, there is one if the unchanged text holds it too.
PATTERN, MATCH, MATCH_AS_IS = 0, 1, 2
_INDEX_SCHEMA = "gram long, before int, size int, print binary, kind int"

_SPACES = re.compile(" {2,}")

# The functions below run inside tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _table(folds: dict[int, str]) -> np.ndarray:
    """For each character up to the last that changes, what it becomes."""
    table = np.arange(max(folds) + 1, dtype=np.uint32)
    table[list(folds)] = [ord(c) for c in folds.values()]
    return table


def _code_points(texts: list[str], folds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, folded, one text after the other, and where each begins."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if folds is not None and len(codes):
        far = codes >= len(folds)
        codes = np.where(far, codes, folds[np.where(far, 0, codes)]) if far.any() else folds[codes]
    return codes, np.concatenate([[0], np.cumsum(sizes)])


def _folded(texts: list[str], folds: np.ndarray) -> list[str]:
    codes, begin = _code_points(texts, folds)
    text = codes.tobytes().decode("utf-32-le")
    return [text[a:b] for a, b in zip(begin.tolist(), begin[1:].tolist())]


def _hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` characters from each place on, as far as there are so many.

    A polynomial of the characters, put together from those of 1, 2, 4, ... characters.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)

    def joined(left: np.ndarray, by: int, right: np.ndarray, size: int) -> np.ndarray:
        m = len(codes) - by - size + 1
        return left[:m] * np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64)) + right[by : by + m]

    part, by, out, size = codes.astype(np.uint64), 1, None, 0
    while by <= width:
        if width & by:
            out = part if out is None else joined(part, by, out, size)
            size += by
        if 2 * by <= width:
            part = joined(part, by, part, by)
        by *= 2
    out = out ^ np.uint64(width)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def _places(gram: np.ndarray, bits: int, which: int) -> np.ndarray:
    """One of the bits of a bitmap that a hash sets."""
    if which == 0:
        return gram & (bits - 1)
    return ((gram & (bits - 1)) + ((gram >> 32) & (bits - 1) | 1) * which) & (bits - 1)


def _places_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of several ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


def _runs(texts: list[str], folds: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of non-empty values of one width, where the runs of each begin, and the hashes of all these runs.

    Values of about ``_WINDOW`` characters are taken together; a longer one is not cut.
    """
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _WINDOW, "right")))
        codes, begin = _code_points(texts[first:last], folds)
        sizes = np.diff(begin)
        widths = np.where(sizes >= GRAM, GRAM, np.minimum(sizes, SHORT))
        for width in np.unique(widths[widths > 0]).tolist():
            which = np.flatnonzero(widths == width)
            n = sizes[which] - width + 1
            some = codes[_places_of(begin[which], sizes[which])]
            at = np.cumsum(sizes[which]) - sizes[which]
            yield which + first, np.cumsum(n) - n, _hashes(some, width)[_places_of(at, n)]
        first = last


def _count_runs(batches: Iterator[pa.RecordBatch], folds: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """How often the list has runs, by counters of their hashes: once for all rows of a task."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for _, _, hashes in _runs(batch.column("low").to_pylist(), folds):
            total += np.bincount(hashes & (COUNTERS - 1), minlength=COUNTERS)
    counter = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(counter), pa.array(total[counter])], names=["counter", "n"])


def _print(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()[:16]


def fingerprint(x: Column) -> Column:
    """``_print`` of a column."""
    return F.substring(F.unhex(F.sha2(x, 256)), 1, 16)


def _filer(counts, folds: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows = batch.column("low").to_pylist()
            # Values of a kind are compared as they are, others folded.
            as_it_is = "kind" in batch.schema.names
            kinds = batch.column("kind").to_numpy() if as_it_is else np.full(len(lows), MATCH, np.int32)
            said = lows if as_it_is or folds is None else _folded(lows, folds)
            for row, begin, hashes in _runs(lows, folds):
                often = counts.value[hashes & (COUNTERS - 1)]
                least = np.minimum.reduceat(often, begin)
                rarest = np.flatnonzero(often == np.repeat(least, np.diff(np.append(begin, len(hashes)))))
                at = rarest[np.searchsorted(rarest, begin)]  # the first one of each value
                sizes = np.fromiter((len(lows[i]) for i in row), np.int32, len(row))
                prints = pa.array([_print(said[i]) for i in row], pa.binary())
                columns = [pa.array(hashes[at]), pa.array((at - begin).astype(np.int32)), pa.array(sizes), prints, pa.array(kinds[row])]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "before", "size", "print", "kind"])

    return run


def _bit_setter(bits: dict[int, int]):
    """Task function: ``width`` and ``gram`` -> the bitmaps of all rows of a task, in pieces that hold some bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = {}
        for batch in batches:
            widths, grams = batch.column("width").to_numpy(), batch.column("gram").to_numpy()
            for width in np.unique(widths).tolist():
                held = maps.setdefault(width, np.zeros(bits[width] // 8, np.uint8))
                some = grams[widths == width]
                for which in range(PLACES):
                    place = _places(some, bits[width], which)
                    np.bitwise_or.at(held, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        for width, held in maps.items():
            pieces = held.reshape(-1, _BITMAP // 8)
            buckets = np.flatnonzero(pieces.any(axis=1))
            for first in range(0, len(buckets), 256):
                some = buckets[first : first + 256]
                columns = [pa.array(np.full(len(some), width, np.int32)), pa.array(some), pa.array([p.tobytes() for p in pieces[some]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["width", "bucket", "bits"])

    return run


def _finder(bitmap, widths: list[int], folds: np.ndarray | None = None, spaced: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value

        def known(gram: np.ndarray, width: int, which: int) -> np.ndarray:
            place = _places(gram, 8 * len(bits[width]), which)
            return ((bits[width][place >> 3] >> (place & 7).astype(np.uint8)) & 1).view(bool)

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids = part.column("row").to_numpy()
                lows = part.column("low").to_pylist()
                codes, begin = _code_points([_SPACES.sub(" ", low) for low in lows] if spaced else lows, folds)
                step, seen = min(_WINDOW, _STRETCH), []
                for a in range(0, len(codes), step):
                    for width in widths:
                        gram = _hashes(codes[a : a + step + width - 1], width)  # runs of a stretch reach into the next one
                        at = np.flatnonzero(known(gram, width, 0))
                        for which in range(1, PLACES):  # few are left for the other bits
                            at = at[known(gram[at], width, which)]
                        place = at + a
                        owner = np.searchsorted(begin, place, "right") - 1
                        inside = place + width <= begin[owner + 1]  # not across two texts
                        if inside.any():
                            owner = owner[inside]
                            seen.append((ids[owner], gram[at[inside]], place[inside] - begin[owner]))
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*seen)], names=["row", "gram", "at"])

    return run


def _counts(lows: DataFrame, folds: np.ndarray):
    """Counters of the runs in the list, to every task: ``COUNTERS`` numbers at most."""
    table = np.zeros(COUNTERS, np.int64)
    count = lambda batches: _count_runs(batches, folds)
    found = lows.mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    table[found["counter"].to_numpy()] = found["n"].to_numpy()
    return lows.sparkSession.sparkContext.broadcast(table)


def _width(size: Column) -> Column:
    return F.when(size >= GRAM, GRAM).otherwise(F.least(size, F.lit(SHORT)))


def _bitmap(index: DataFrame):
    """For each width, the bits of the runs that the index knows, to every task: about 32 for each of them, ``BITS`` at most.

    So texts pass by chance hardly more often where the list is long, and not because of runs of another width.
    """
    runs = index.select(_width(F.col("size")).alias("width"), "gram")
    bits = {r.width: min(BITS, max(_BITMAP, 1 << (32 * r.n - 1).bit_length())) for r in runs.groupBy("width").agg(F.count("*").alias("n")).collect()}
    pieces = runs.mapInArrow(_bit_setter(bits), "width int, bucket long, bits binary")
    found = pieces.groupBy("width", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).toArrow()
    maps = {width: np.zeros(n // 8, np.uint8) for width, n in bits.items()}
    for width, bucket, part in zip(*(found[c].to_pylist() for c in ("width", "bucket", "bits"))):
        maps[width][bucket * _BITMAP // 8 : (bucket + 1) * _BITMAP // 8] = np.frombuffer(part, np.uint8)
    return index.sparkSession.sparkContext.broadcast(maps)


def marked(rows: DataFrame, row: str, hits: DataFrame) -> DataFrame:
    """Add ``marked``: whether the number of a row is among the ``row`` of ``hits``, by a bit for each."""
    block = F.shiftright("row", 6).alias("_block")
    marks = hits.groupBy(block).agg(F.bit_or(F.expr("shiftleft(1L, cast(row & 63 AS int))")).alias("_bits"))
    if hits.select(block).distinct().count() <= MARKS:
        marks = F.broadcast(marks)
    bit = F.expr(f"shiftright(_bits, cast({row} & 63 AS int)) & 1") == 1
    joined = rows.join(marks, F.shiftright(row, 6) == F.col("_block"), "left")
    return joined.withColumn("marked", F.coalesce(bit, F.lit(False))).drop("_block", "_bits")


def _verifier(folds: np.ndarray, spaced: bool):
    """Task function: texts, each in front of its candidates -> the rows in which one stands, and what is to be searched.

    ``spaced``: values are compared with the text with single spaces, patterns with it folded; else all with the text folded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = plain = low = None
        sure, said = False, set()
        for batch in batches:
            rows, prints, texts = [], [], batch.column("text")
            columns = (batch.column(c).to_pylist() for c in ("row", "begin", "size", "print", "kind"))
            for i, (row, begin, size, want, kind) in enumerate(zip(*columns)):
                if begin < 0:
                    text, low, sure, said = texts[i].as_py(), None, False, set()
                    plain = _SPACES.sub(" ", text) if spaced else _folded([text], folds)[0]
                    continue
                if sure:
                    continue
                if kind == PATTERN and low is None:
                    low = _folded([plain], folds)[0]
                there = (low if kind == PATTERN else plain)[begin : begin + size]
                if len(there) < size or _print(there) != want or kind == MATCH_AS_IS and there not in text:
                    continue
                if kind == PATTERN:
                    if want in said:
                        continue
                    said.add(want)
                else:
                    sure, want = True, None
                rows.append(row)
                prints.append(want)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(prints, pa.binary())], names=["row", "print"])

    return run


def occurrences(texts: DataFrame, lows: DataFrame, folder: str) -> DataFrame:
    """``row`` of each text (``row``, ``text``) that, lower-cased, holds a non-empty value ``low`` of the list, lower-cased.

    Values may have a ``kind``. They are looked for in the texts with single spaces then, by runs of the folded characters.
    Those that are patterns come as ``row`` and ``print``, their fingerprint, where the folded text holds them; the others
    (``print`` is null) must be there as they are, and ``MATCH_AS_IS`` in the text with its own spaces too.

    Both inputs are read more than once. A run that many texts have is joined as a skewed key, which adaptive
    execution splits.
    """
    spaced = "kind" in lows.columns
    folds = _table(fold_table() if spaced else lower_table())
    index = stage(lows.mapInArrow(_filer(_counts(lows, folds), folds), _INDEX_SCHEMA).distinct(), folder + "/index")
    bitmap = _bitmap(index)
    found = _finder(bitmap, sorted(bitmap.value), folds, spaced)
    seen = texts.select("row", F.col("text").alias("low")).mapInArrow(found, "row long, gram long, at long")
    seen = stage(seen, folder + "/seen")
    place = (F.col("at") - F.col("before")).cast("int").alias("begin")
    none = F.lit(None).cast("string").alias("text")
    maybe = seen.join(index, "gram").select("row", place, "size", "print", "kind", none).where("begin >= 0")
    sent = marked(texts.select("row", "text"), "row", seen).where("marked")
    first = sent.select("row", F.lit(-1).alias("begin"), F.lit(0).alias("size"), F.lit(None).cast("binary"), F.lit(0), "text")
    both = maybe.union(first).repartition("row").sortWithinPartitions("row", "begin")
    return both.mapInArrow(_verifier(folds, spaced), "row long, print binary")


def flag_rows(held: DataFrame, found: DataFrame) -> DataFrame:
    """Rows numbered ``_row`` with ``matched`` for those among the ``row`` of ``found``, without the number."""
    return marked(held, "_row", found).withColumnRenamed("marked", "matched").drop("_row")


def flag_contained(rows: DataFrame, x: Column, items: DataFrame, folder: str | None = None) -> DataFrame:
    """Add ``matched`` to the rows: lower-cased, ``x`` contains some ``item``; NULL or false where it does not.

    An empty list or value matches nothing, and neither does a null ``x``. The rows are staged below ``folder``
    (a fresh shared one if there is none) and change their order.
    """
    folder = folder or shared_folder(rows.sparkSession, "contained")
    lows = items.select(F.col("item").alias("low")).where("low <> ''")
    held = stage(rows.withColumn("_row", F.monotonically_increasing_id()), folder + "/tested")
    texts = held.select(F.col("_row").alias("row"), x.alias("text")).where("text <> ''")
    return flag_rows(held, stage(occurrences(texts, lows, folder).select("row"), folder + "/found"))
