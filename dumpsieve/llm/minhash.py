"""Near duplicates by bottom-k sketches of word shingles.

One hash function; the k smallest hashes of a document's shingle set are its sketch.
Inverted lists of retained values give candidate pairs, an estimate over the union of
two sketches thins them out, and the full sets decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dumpsieve.llm.graph import connected_components
from dumpsieve.llm.shared import (
    bloom_bits, give_back, member_bitmap, passes_bloom, scratch_folder, spread, stored, text_chunks, words_of,
)

_CHUNK_CHARS = 1 << 20  # shingling needs some 40 bytes for each of text
_COUNTERS = 1 << 20  # of the table that orders values by how common they are: 4 MiB, fixed
_SEEDS = (31, 32)
_PARITIES = ("p0", "p1", "p2", "p3")


@dataclass(frozen=True)
class MinHash:
    """``k`` retained hashes; ``overlap`` of them a pair at the threshold shares at least.

    At similarity 0.8, two full sketches of 32 share 25.6 on average and 16 or more in all but about 1 of 100,000 cases for
    the worst sizes, far fewer for equal ones. Sets so small that no partner can be cut are indexed exactly.
    """

    shingle: int = 5
    percent: int = 80
    k: int = 32
    overlap: int = 16
    common: int = 6  # shared index values asked of two full sketches
    leaders: int = 4  # members of each list that all others are compared with first
    long_list: int = 16  # members; longer lists are not searched pair by pair, full sets are
    estimate: float = 0.45


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts in turn, and where each text's begin.

    Words are lower-cased in A-Z and split at ASCII white space. A text of fewer words is one shingle.
    """
    rows, codes, dictionary = words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in dictionary), np.uint64, len(dictionary))
    n_words = np.bincount(rows, minlength=len(texts))
    starts = np.cumsum(n_words) - n_words
    n = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    first = spread(starts, n)
    size = np.minimum(n_words, words)[owner]
    value = size.astype(np.uint64)
    for i in range(words):
        inside = i < size
        at = first[inside] + i
        value[inside] = _mix(value[inside] * np.uint64(0x9E3779B97F4A7C15) + hashes[codes[at]])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def _parities(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For sets one after the other, four numbers each: whether 256 buckets of hashes hold odd counts."""
    place = np.repeat(np.arange(len(sizes)) * 256, sizes) + ((values >> np.uint64(20)) & np.uint64(255)).astype(np.int64)
    odd = (np.bincount(place, minlength=256 * len(sizes)) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sizes), 256), axis=1).view(np.int64)


def _unlike() -> Column:
    """Buckets in which the parities of two sets differ: at most as many as values that only one of them has."""
    return sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in _PARITIES), F.lit(0))


def _sketcher(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, size=_CHUNK_CHARS):
            values, begin = shingle_sets(part.column("text"), words)
            n = np.diff(begin)
            kept = np.minimum(n, k)
            flat = values[spread(begin[:-1], kept)]
            parities = _parities(flat, kept)
            sets = [hashlib.md5(values[a:b].tobytes()).digest() for a, b in zip(begin[:-1], begin[1:])]
            offsets = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))]
                + [pa.array(np.ascontiguousarray(parities[:, i])) for i in range(4)],
                names=["doc_id", "row", "n", "set_key", "sketch", *_PARITIES],
            )
            give_back()

    return run


def sketches(docs: DataFrame, options: MinHash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, n (size of the shingle set), set_key (equal for equal sets), sketch and its parities."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = "doc_id long, row long, n long, set_key binary, sketch array<long>, " + ", ".join(f"{p} long" for p in _PARITIES)
    return rows.mapInArrow(_sketcher(options.shingle, options.k), schema)


# ---------------------------------------------------------------- candidates


def _counters(classes: DataFrame) -> np.ndarray:
    """How often the sketch values of each of a fixed number of buckets occur."""
    bucket = F.pmod("value", F.lit(_COUNTERS).cast("long")).cast("int")
    found = classes.select(F.explode("sketch").alias("value")).groupBy(bucket.alias("bucket")).agg(
        F.least(F.count("*"), F.lit((1 << 31) - 1)).cast("int").alias("n")
    ).toArrow()
    counts = np.zeros(_COUNTERS, np.int32)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def _indexer(options: MinHash, counts):
    k, overlap, common, percent = options.k, options.overlap, options.common, options.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_cid, out_value, out_n, out_all = [], [], [], []
            for cid, n, sketch in zip(*(batch.column(c).to_pylist() for c in ("cid", "n", "sketch"))):
                values = np.array(sketch, np.int64)
                if n * 100 <= k * percent:  # every partner's sketch is its whole set
                    must, need = -(-n * percent // 100), 1
                else:
                    must, need = overlap, common
                order = np.lexsort((values, counts.value[values % _COUNTERS]))
                values = values[order[: len(values) - must + need]]
                out_value.append(values)
                out_cid.append(np.full(len(values), cid, np.int64))
                out_n.append(np.full(len(values), n, np.int64))
                out_all.append(np.full(len(values), len(values), np.int64))
            if out_cid:
                columns = [pa.array(np.concatenate(x)) for x in (out_value, out_cid, out_n, out_all)]
                yield pa.RecordBatch.from_arrays(columns, names=["value", "cid", "n", "indexed"])

    return run


def _in_list(column: Column) -> Column:
    """An aggregate over each list, told to its rows where they lie: a join would move them again.

    The rows are dealt by value first, or else what the aggregates are made of would move with them.
    """
    return column.over(Window.partitionBy("value"))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of lists with more than one class."""
    many = _in_list(F.min("cid")) < _in_list(F.max("cid"))
    return rows.repartition("value").withColumn("many", many).filter("many").drop("many")


def _index(classes: DataFrame, options: MinHash, folder: str) -> DataFrame:
    """value, cid, n, leaders: the values of each class under which it can meet its partners.

    Two sets at the threshold share at least ``overlap`` retained values. In any order that
    all share, here rarest first, the values left after taking away ``overlap`` - ``common`` of
    the last ones hold ``common`` shared ones. So very common values are seldom indexed.
    Values that only one class has are dropped. Leaders are the members with the fewest of
    these, in a group of near copies those next to the text that it comes from; of equal
    members the first in orders that are the same for all lists, so lists of the same classes
    have the same leaders.
    """
    spark = classes.sparkSession
    counts = spark.sparkContext.broadcast(_counters(classes))
    rows = classes.select("cid", "n", "sketch").mapInArrow(
        _indexer(options, counts), "value long, cid long, n long, indexed long"
    )
    masks = [0] + [int.from_bytes(hashlib.md5(bytes([i])).digest()[:7], "big") for i in range(1, options.leaders)]
    leader = [
        _in_list(F.min(F.struct("alone", F.col("cid").bitwiseXOR(F.lit(m).cast("long")).alias("cid")))).getField("cid")
        .bitwiseXOR(F.lit(m).cast("long")) for m in masks
    ]
    with scratch_folder(spark) as aside:
        rows = _shared(stored(rows, "rows", aside))
        alone = F.col("indexed") - F.count("*").over(Window.partitionBy("cid"))
        rows = stored(rows.select("value", "cid", "n", alone.alias("alone")), "shared", aside).repartition("value")
        return stored(rows.select("value", "cid", "n", F.array_distinct(F.array(*leader)).alias("leaders")), "index", folder)


def _need(options: MinHash):
    return F.when(F.col("n") * 100 <= options.k * options.percent, 1).otherwise(options.common)


def _enough(pairs: DataFrame) -> DataFrame:
    return (
        pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need")).filter("n >= need").select("a", "b")
    )


def _leader_pairs(index: DataFrame, options: MinHash) -> DataFrame:
    """Every class with the leaders of each of its lists: a bounded number for each row of the lists."""
    rows = index.select("cid", "leaders", _need(options).alias("need"), F.explode("leaders").alias("leader"))
    rows = rows.filter((F.col("cid") < F.col("leader")) | ~F.array_contains("leaders", F.col("cid")))
    return _enough(rows.select(F.least("leader", "cid").alias("a"), F.greatest("leader", "cid").alias("b"), "need"))


def _unsettled(index: DataFrame, components: DataFrame, classes: DataFrame, options: MinHash, folder: str) -> DataFrame:
    """The classes that may have partners in other components: cid, doc, set_key, component.

    Those that meet a class of a like sketch in a list of at most ``long_list`` members, and those in enough longer lists:
    a pair that shares no short list shares enough long ones. Sets of at most ``k`` shingles may have a partner that
    is indexed by fewer values: one long list will do.
    """
    need = F.when(F.col("n") <= options.k, 1).otherwise(options.common)
    found = index.select("value", "cid", "n", need.alias("need")).join(
        components.select(F.col("node").alias("cid"), "component"), "cid", "left"
    ).withColumn("component", F.coalesce("component", "cid"))
    found = stored(found, "members", folder)
    lists = found.groupBy("value").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), (F.count("*") > options.long_list).alias("long")
    )
    lists = stored(lists.filter("low < high").select("value", "long"), "lists", folder)
    found = found.join(lists, "value")
    many = found.filter("long").groupBy("cid").agg(F.count("*").alias("shared"), F.min("need").alias("need"))
    few = found.filter("not long").join(classes.select("cid", *_PARITIES), "cid")
    few = stored(few.select("value", "cid", "component", "n", *_PARITIES), "few", folder)
    a, b = (few.select("value", *(F.col(c).alias(f"{c}_{side}") for c in few.columns if c != "value")) for side in "ab")
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    whole = (least + most - _unlike()) * (100 + options.percent) >= (least + most) * (2 * options.percent)
    met = a.join(b, "value").filter(
        (F.col("cid_a") < F.col("cid_b")) & (F.col("component_a") != F.col("component_b"))
        & (least * 100 >= most * options.percent)
        & F.when(most <= options.k, whole).otherwise(_unlike() <= 2 * (options.k - options.overlap))
    )
    some = many.filter("shared >= need").select("cid").union(met.select(F.explode(F.array("cid_a", "cid_b")))).distinct()
    some = some.join(classes, "cid").join(components.select(F.col("node").alias("cid"), "component"), "cid", "left")
    component = F.coalesce("component", "cid").alias("component")
    return stored(some.select("cid", F.col("doc_id").alias("doc"), "set_key", component), "asked")


def _bucket_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column("members").to_pylist()), np.uint64)
        bucket, n = np.unique(flat % np.uint64(_COUNTERS), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], names=["bucket", "n"]
        )


def _prefixer(percent: int, counts):
    """Rows of each set's rarest shingles, with their place and the parities of the set without those in front of it."""
    names = ["value", "cid", "component", "n", "place", *_PARITIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, component, members in zip(*(batch.column(c).to_pylist() for c in ("cid", "component", "members"))):
                values = np.frombuffer(members, np.uint64)
                n = len(values)
                common = counts.value[values % np.uint64(_COUNTERS)]
                order = np.lexsort((values, common))[: n + (-n * percent // 100) + 1]
                place = np.flatnonzero(common[order] > 1)  # a counter of 1: no other set has the value
                fixed = [cid, component, n]
                bucket = ((values[order] >> np.uint64(20)) & np.uint64(255)).astype(np.int64)
                rest = np.zeros((len(order) + 1, 32), np.uint8)
                rest[0] = _parities(values, np.array([n])).view(np.uint8)
                rest[np.arange(1, len(order) + 1), bucket >> 3] = (128 >> (bucket & 7)).astype(np.uint8)
                rest = np.bitwise_xor.accumulate(rest, axis=0)[place].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[order[place]].view(np.int64))]
                    + [pa.array(np.full(len(place), x, np.int64)) for x in fixed]
                    + [pa.array(place.astype(np.int64))]
                    + [pa.array(np.ascontiguousarray(rest[:, i])) for i in range(4)],
                    names=names,
                )

    return run


def _prefixes(sets: DataFrame, options: MinHash, folder: str) -> DataFrame:
    """value, cid, component, n, place, parities, alone: the rarest shingles of full sets that another set has too.

    Alone is how many of a set's rarest shingles no other set has: next to none in the text that a group of near copies
    comes from. A sketch often has none of a copy's own shingles, so there such a text is hard to tell.
    """
    spark = sets.sparkSession
    found = sets.mapInArrow(_bucket_counter, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_COUNTERS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    schema = "value long, cid long, component long, n long, place long, " + ", ".join(f"{p} long" for p in _PARITIES)
    rows = sets.mapInArrow(_prefixer(options.percent, spark.sparkContext.broadcast(counts)), schema)
    looked = F.col("n") - F.ceil(F.col("n") * options.percent / 100) + 1
    with scratch_folder(spark) as aside:
        rows = _shared(stored(rows, "prefixes", aside))
        return stored(rows.withColumn("alone", looked - F.count("*").over(Window.partitionBy("cid"))), "shared", folder)


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows in lists of several components, with ``main``, the list's largest component."""
    members = F.count("*").over(Window.partitionBy("value", "component"))
    parts = _in_list(F.min("component")) < _in_list(F.max("component"))
    rows = rows.repartition("value").withColumn("members", members)
    rows = rows.withColumns({"main": _in_list(F.max(F.struct("members", "component"))).getField("component"), "mixed": parts})
    return rows.filter("mixed").drop("mixed", "members")


def _reachable(options: MinHash) -> Column:
    """Whether two members of a list, of different components, can reach the threshold.

    Only where the common shingle stands early enough, and where what is in front of it in either set, with the buckets
    behind it whose parities differ (at most as many as shingles that one set lacks), allows the threshold. Both bounds are
    exact at the first common shingle, and at later ones, where common shingles count as different, they hardly ever let a
    pair pass again.
    """
    both = F.col("n_a") + F.col("n_b")
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    percent, whole = options.percent, 100 + options.percent
    return (
        (F.col("component_a") != F.col("component_b"))
        & (left * whole >= both * percent)
        & ((both - F.col("place_a") - F.col("place_b") - _unlike()) * whole >= both * (2 * percent))
    )


_IN_LIST = ("cid", "component", "n", "place", *_PARITIES)


def _hub_pairs(rows: DataFrame, options: MinHash) -> DataFrame:
    """Every set with a few hubs of its lists that lie in other components: a bounded number for each row of the lists.

    Hubs have the fewest shingles of their own: one of all members, more of those about as near to their text, and one
    outside of the list's largest component. Large components that are linked many times become one here, so that the
    search of pairs has only those left to which few links lead.
    """
    masks = [int.from_bytes(hashlib.md5(bytes([i])).digest()[:7], "big") for i in range(options.leaders)]
    member = F.struct(*_IN_LIST)

    def hub(i: int, *of: Column) -> Column:
        order = F.struct(F.shiftright("alone", i), F.col("cid").bitwiseXOR(F.lit(masks[i]).cast("long")))
        return _in_list(F.min_by(member, F.when(of[0], order) if of else order))

    hubs = [hub(i) for i in range(options.leaders)] + [hub(0, F.col("component") != F.col("main"))]
    found = _mixed(rows).select(*_IN_LIST, F.array_distinct(F.array(*hubs)).alias("hubs"))
    pairs = found.select(*(F.col(c).alias(f"{c}_a") for c in _IN_LIST), F.explode("hubs").alias("hub"))
    pairs = pairs.select("*", *(F.col(f"hub.{c}").alias(f"{c}_b") for c in _IN_LIST)).filter(_reachable(options))
    return pairs.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()


def _pairs_between(rows: DataFrame, options: MinHash) -> DataFrame:
    """Pairs of different components that can reach the threshold, by the rarest shingles of their full sets.

    Members of a group of near copies share most retained values, so their lists would give all pairs of the group. In
    an order that all sets share, rarest first, two sets at the threshold have their first common shingle so early that
    enough are left behind it in both. In each list only sets outside of its largest component look for partners.
    """
    with scratch_folder(rows.sparkSession) as aside:
        mixed = stored(_mixed(rows), "mixed", aside)
        few = mixed.filter("component != main").select("value", *(F.col(c).alias(f"{c}_a") for c in _IN_LIST))
        every = mixed.select("value", "main", *(F.col(c).alias(f"{c}_b") for c in _IN_LIST))
        pairs = few.join(every, "value").filter(
            _reachable(options) & ((F.col("component_b") == F.col("main")) | (F.col("cid_a") < F.col("cid_b")))
        )
        pairs = pairs.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()
        return stored(pairs, "pairs")


# ---------------------------------------------------------------- estimate and proof


def _estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Similarity by the k smallest values of the union of two sketches."""
    both = np.union1d(a, b)[:k]
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), both).sum()) / max(len(both), 1)


def _thin(pairs: DataFrame, classes: DataFrame, options: MinHash) -> DataFrame:
    """The pairs whose sketches, of ``classes`` (cid, n, sketch), are alike enough for a proof."""
    k, least = options.k, options.estimate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                _estimate(np.array(x, np.int64).view(np.uint64), np.array(y, np.int64).view(np.uint64), k) >= least
                for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = classes.select(F.col("cid").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = classes.select(F.col("cid").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.filter(100 * F.least("na", "nb") >= options.percent * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _set_maker(words: int, k: int = MinHash.k):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, size=_CHUNK_CHARS):
            values, begin = shingle_sets(part.column("text"), words)
            sets = [values[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])]
            same = [hashlib.md5(s).digest() == key for s, key in zip(sets, part.column("set_key").to_pylist())]
            n = np.diff(begin)
            offsets = np.concatenate([[0], np.cumsum(np.minimum(n, k))]).astype(np.int32)
            flat = pa.array(values[spread(begin[:-1], np.minimum(n, k))].view(np.int64))
            out = pa.RecordBatch.from_arrays(
                [part.column("cid"), part.column("component"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat),
                 pa.array(sets, pa.binary())],
                names=["cid", "component", "n", "sketch", "members"],
            )
            yield out.filter(pa.array(same, pa.bool_()))
            give_back()

    return run


def _sets(asked: DataFrame, texts: DataFrame, options: MinHash, folder: str) -> DataFrame:
    """cid, component, n, sketch and full sets of the documents in ``asked``.

    A bounded Bloom bitmap of the documents in question keeps other texts out of the exchange. The sets are moved once more
    only where some come twice, as they do if ids repeat.
    """
    bits = bloom_bits(asked.count())
    bitmap = stored(member_bitmap(asked, F.col("doc"), _SEEDS, bits), "bloom")
    some = passes_bloom(texts, F.col("doc_id"), bitmap, _SEEDS, bits).filter("maybe").drop("maybe")
    some = some.join(asked, some.doc_id.eqNullSafe(asked.doc)).select("cid", "component", "set_key", "text")
    schema = "cid long, component long, n long, sketch array<long>, members binary"
    made = stored(some.mapInArrow(_set_maker(options.shingle, options.k), schema), "sets", folder)
    twice = made.groupBy("cid").agg(F.count("*").alias("copies")).filter("copies > 1")
    return made if twice.isEmpty() else stored(made.dropDuplicates(["cid"]), "sets_once", folder)


def _prover(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _proven(pairs: DataFrame, sets: DataFrame, options: MinHash) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    left = sets.select(F.col("cid").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("cid").alias("b"), F.col("members").alias("mb"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", "ma", "mb").mapInArrow(_prover(options.percent), "a long, b long")
    return stored(found, "proven")


def _linked(docs: DataFrame, options: MinHash, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, n, component (a number, null without shingles), component_id (its smallest id) per row of ``docs``.

    First every class is compared with a few leaders of each of its inverted lists. Classes whose lists
    still hold other components then meet those by the rarest shingles of their full sets, first a few hubs of each
    list, then all that is left; so large groups of copies cost a few comparisons per member, and no pair of
    different components is left out.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    spark = docs.sparkSession
    with scratch_folder(spark) as aside:
        drawn = stored(sketches(texts, options), "sketches", aside)
        classes = drawn.filter("n > 0").groupBy("set_key").agg(
            F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"),
            *(F.first(p).alias(p) for p in _PARITIES),
        )
        classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        drawn = stored(drawn.select("doc_id", "row", "n", "set_key"), "drawn")
    with scratch_folder(spark) as aside:
        index = _index(classes, options, aside)
        first = stored(_thin(_leader_pairs(index, options), classes, options), "pairs")
        asked = first.select(F.col("a").alias("cid")).union(first.select(F.col("b").alias("cid"))).distinct().join(classes, "cid")
        asked = stored(asked.select("cid", F.col("doc_id").alias("doc"), "set_key", F.col("cid").alias("component")), "asked")
        with scratch_folder(spark) as beside:
            components = connected_components(_proven(first, _sets(asked, texts, options, beside), options))
        asked = _unsettled(index, components, classes, options, aside)
    with scratch_folder(spark) as aside:
        sets = _sets(asked, texts, options, aside)
        rows = _prefixes(sets, options, aside)
        for search in (_hub_pairs, _pairs_between):
            more = _proven(stored(_thin(search(rows, options), sets, options), "pairs"), sets, options)
            if not more.isEmpty():
                # What is known moves on as links to the components, not as all links.
                known = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
                components = connected_components(known.unionByName(more))
                now = components.select(F.col("node").alias("cid"), F.col("component").alias("now"))
                rows = rows.join(now, "cid", "left").withColumn("component", F.coalesce("now", "component")).drop("now")
    named = classes.select("cid", "set_key", "doc_id").join(
        components.select(F.col("node").alias("cid"), "component"), "cid", "left"
    ).withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "component").select("set_key", "component", "component_id")
    rows = drawn.select("doc_id", "row", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key"))
    return rows.join(named, "set_key", "left").drop("set_key")


def near_duplicates(
    docs: DataFrame, options: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have a similarity of ``percent`` or more are linked;
    component_id is the smallest id reachable, kept marks it. Null and empty texts have no
    shingles and are linked with nothing. Equal sets (also of repeated rows) are one class
    and are compared once. A null id is kept only where its component has no other id. Texts
    of any length are read whole. An empty table gives an empty result; other columns are not read.
    """
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return _linked(docs, options, id_col, text_col).select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_copies(
    docs: DataFrame, options: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each group of linked rows of ``docs``, all columns: the smallest id, null ids last, of equal ids the first row.

    Rows are told apart by their place in the table, so null and repeated ids are documents of
    their own. Rows without shingles (null, empty texts) all stay. ``docs`` should be a written
    table: it is read again, and rows must come in the same order.
    """
    found = stored(_linked(docs, options, id_col, text_col).filter("n > 0").select("row", "doc_id", "component"), "linked")
    order = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "row")
    stays = found.groupBy("component").agg(F.min(order).alias("best")).select(F.col("best.row").alias("row"))
    gone = stored(found.join(stays, "row", "left_anti").select(F.col("row").alias("_gone_row")), "gone")
    rows = docs.withColumn("_here_row", F.monotonically_increasing_id())
    return rows.join(gone, F.col("_here_row") == F.col("_gone_row"), "left_anti").drop("_here_row")
