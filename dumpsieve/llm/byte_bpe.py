"""Byte-level BPE by a rank file: encoding and decoding as higher-order functions.

A partition's texts are cut into pieces, and only words that the partition has not
met before go through the merges; texts are then put together from what their words
became. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpsieve.llm.shared import spread, text_chunks

#: All white space of Unicode, as in the classes of the piece pattern.
_SPACE = r"[\t-\r\x20\x85\xa0  -     　]"
#: With white space on both sides, or in front and nothing behind, a space is not the start of a piece.
_UNEVEN = regex.compile(rf"{_SPACE}\x20(?:{_SPACE}|\Z)")
_ID_BITS = 17  # of a pair's parts in the rank map
_PLACE_AT, _RANK_AT = 20, 40  # bits of a token in the fold's state: id, place, rank
NEVER = 1 << 20
_LONG_WORD = 256  # bytes, beyond which merges use a heap instead of a fold
_WORDS_HELD = 200_000
_BLOCK_CHARS = 1 << 20


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the content of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


# ---------------------------------------------------------------- the rank map


def rank_map(ranks: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Rank of every pair of tokens that merges, as one array of longs, and its number of buckets.

    A perfect hash by displacement: the front holds a shift per bucket, the back an entry
    (pair, rank) per place, so one probe decides.
    """
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << _ID_BITS | right] = rank
    buckets, size = len(pairs) // 3 | 1, len(pairs) * 3 // 2 + 101 | 1
    while True:
        found = _displaced(pairs, buckets, size)
        if found is not None:
            return found, buckets
        size += 2


def _displaced(pairs: dict[int, int], buckets: int, size: int) -> np.ndarray | None:
    members: list[list[int]] = [[] for _ in range(buckets)]
    for key in pairs:
        members[key % buckets].append(key)
    out = np.zeros(buckets + size, np.int64)
    out[buckets:] = -1
    free = np.ones(size, bool)
    shift = 0
    for bucket in sorted(range(buckets), key=lambda i: -len(members[i])):
        keys = np.array(members[bucket], np.int64)
        for _ in range(size):
            shift = (shift + 7919) % size
            places = (keys % size + shift) % size
            if free[places].all() and len(set(places.tolist())) == len(keys):
                break
        else:
            return None
        free[places] = False
        out[bucket] = shift
        for key, place in zip(members[bucket], places):
            out[buckets + place] = key << _ID_BITS | pairs[key]
    return out


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rank_of(table: Column, shape: tuple[int, int], left: Column, right: Column) -> Column:
    """Rank of a pair of ids as :func:`rank_map` has it; ``NEVER`` if it does not merge."""
    buckets, size = (F.lit(x).cast("long") for x in shape)

    def probe(key: Column) -> Column:
        entry = F.get(table, (key % size + F.get(table, key % buckets)) % size + buckets)
        return _let(entry, lambda e: F.when(F.shiftright(e, _ID_BITS) == key, e.bitwiseAND((1 << _ID_BITS) - 1)).otherwise(NEVER))

    return F.coalesce(_let(F.shiftleft(left, _ID_BITS) + right, probe), F.lit(NEVER))


def encode_word(word: Column, table: Column, shape: tuple[int, int]) -> Column:
    """Ids of one word, given its bytes as packed by :func:`packed_bytes`.

    An element of the fold's state is a token: rank of the pair with its right neighbour, then
    its place in the word, then its id. So the least element is the leftmost pair of the lowest
    rank. A step merges it, looks up its two new pairs and takes its neighbour out.
    """
    id_of = (1 << _PLACE_AT) - 1

    def merge(state: Column, _: Column) -> Column:
        def found(least: Column) -> Column:
            new = F.shiftright(least, _RANK_AT)

            def at(place: Column) -> Column:
                after = F.get(state, place + 1).bitwiseAND(id_of)

                def token(x: Column, i: Column) -> Column:
                    before = F.shiftleft(_rank_of(table, shape, x.bitwiseAND(id_of), new), _RANK_AT)
                    rest = before + x.bitwiseAND((1 << _RANK_AT) - 1)
                    own = F.shiftleft(_rank_of(table, shape, new, after), _RANK_AT)
                    own = own + x.bitwiseAND(((1 << _RANK_AT) - 1) ^ id_of) + new
                    moved = F.when(i == place, F.lit(-1).cast("long")).when(i == place - 1, own).otherwise(rest)
                    return F.when((i > place) | (i < place - 2), x).otherwise(moved)

                return F.array_remove(F.transform(state, token), F.lit(-1).cast("long"))

            return F.when(least < (NEVER << _RANK_AT), _let(F.array_position(state, least), at)).otherwise(state)

        return _let(F.array_min(state), found)

    return F.aggregate(
        F.sequence(F.lit(2), F.size(word)), word, merge, lambda s: F.transform(s, lambda x: x.bitwiseAND(id_of).cast("int"))
    )


def decode_ids(ids: Column, pieces: Column) -> Column:
    """Bytes of ids; ``pieces`` has the bytes of each id as hexadecimal digits."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


# ---------------------------------------------------------------- words in batches


@dataclass(frozen=True)
class RankFile:
    """What tasks need of a rank file; a few MB whatever the corpus."""

    ranks: dict[bytes, int]
    pattern: str
    table: np.ndarray
    buckets: int

    @classmethod
    def read(cls, content: bytes, pattern: str) -> RankFile:
        ranks = read_ranks(content)
        return cls(ranks, pattern, *rank_map(ranks))

    @property
    def shape(self) -> tuple[int, int]:
        return self.buckets, len(self.table) - self.buckets

    def byte_ids(self) -> np.ndarray:
        return np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, ``NEVER`` where they do not merge or one is negative."""
        buckets, size = self.shape
        key = np.where((left < 0) | (right < 0), 0, left << _ID_BITS | right)
        entry = self.table[(key % size + self.table[key % buckets]) % size + buckets]
        hit = (entry >> _ID_BITS == key) & (left >= 0) & (right >= 0)
        return np.where(hit, entry & ((1 << _ID_BITS) - 1), NEVER)


def packed_bytes(word: bytes, file: RankFile, byte_ids: np.ndarray) -> np.ndarray:
    """Start of the fold of :func:`encode_word`: an element per byte."""
    ids = byte_ids[np.frombuffer(word, np.uint8)]
    ranks = np.append(file.pair_ranks(ids[:-1], ids[1:]), NEVER)
    return ranks << _RANK_AT | np.arange(len(ids)) << _PLACE_AT | ids


def merge_long(word: bytes, file: RankFile) -> list[int]:
    """Ids of one long word; pairs wait in a heap."""
    ids = file.byte_ids()[np.frombuffer(word, np.uint8)]
    waiting = [(int(r), i) for i, r in enumerate(file.pair_ranks(ids[:-1], ids[1:])) if r < NEVER]
    heapq.heapify(waiting)
    ends, before = np.arange(1, len(ids) + 1).tolist(), np.arange(-1, len(ids) - 1).tolist()
    token = ids.tolist()  # -1 once it is part of another
    while waiting:
        rank, i = heapq.heappop(waiting)
        j = ends[i]
        if token[i] < 0 or j >= len(token) or file.ranks.get(word[i : ends[j]]) != rank:
            continue
        token[i], token[j], ends[i] = rank, -1, ends[j]
        if ends[i] < len(token):
            before[ends[i]] = i
        for x in (before[i], i):
            if x >= 0 and ends[x] < len(token):
                new = file.ranks.get(word[x : ends[ends[x]]])
                if new is not None:
                    heapq.heappush(waiting, (new, x))
    return [t for t in token if t >= 0]


def merge_batch(words: list[bytes], file: RankFile) -> list[list[int]]:
    """Ids of many words: the fold of :func:`encode_word`, a step for all words at once."""
    out: list[list[int]] = [[]] * len(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    byte_ids = file.byte_ids()
    width = 8
    while width // 2 < sizes.max(initial=0):
        some = np.flatnonzero((sizes <= width) & ((sizes > width // 2) | (width == 8)))
        if len(some):
            raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in some), np.uint8).reshape(-1, width)
            ids = np.where(np.arange(width) < sizes[some, None], byte_ids[raw], -1)
            ranks = file.pair_ranks(ids[:, :-1], ids[:, 1:])
            for row, found in zip(some, _merged(ids, ranks, file).tolist()):
                out[row] = [i for i in found if i >= 0]
        width *= 2
    return out


def _merged(ids: np.ndarray, ranks: np.ndarray, file: RankFile) -> np.ndarray:
    result, open_ = ids.copy(), np.arange(len(ids))
    places = np.arange(ids.shape[1])
    while len(open_):
        rows = np.arange(len(ids))
        at = ranks.argmin(1)
        least = ranks[rows, at]
        go = least < NEVER
        result[open_[~go]] = ids[~go]
        open_, ids, ranks, at, least = open_[go], ids[go], ranks[go], at[go], least[go]
        if not len(open_):
            break
        rows = np.arange(len(ids))
        ids[rows, at] = least
        after = np.minimum(places + (places > at[:, None]), len(places) - 1)
        ids = np.take_along_axis(ids, after, 1)
        ids[:, -1] = -1
        ranks = np.take_along_axis(ranks, np.minimum(after[:, :-1], len(places) - 2), 1)
        ranks[:, -1] = NEVER
        following = np.minimum(at + 1, len(places) - 1)
        own = np.minimum(at, len(places) - 2)
        ranks[rows, own] = np.where(at < len(places) - 1, file.pair_ranks(ids[rows, at], ids[rows, following]), ranks[rows, own])
        front = np.maximum(at - 1, 0)
        ranks[rows, front] = np.where(at > 0, file.pair_ranks(ids[rows, front], ids[rows, at]), ranks[rows, front])
    return result


# ---------------------------------------------------------------- texts


def _pieces(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Number of pieces of each text, and the pieces: cut in front of single spaces, which they keep.

    Where a run of white space makes the place of the cut matter, the text is one piece.
    """
    even = [not _UNEVEN.search(t) for t in texts]
    split = pc.split_pattern(pa.array([t if e else "" for t, e in zip(texts, even)], pa.string()), " ")
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(split)
    first = np.zeros(len(flat), bool)
    first[np.cumsum(counts) - counts] = True
    spaced = pc.binary_join_element_wise(pa.array(np.where(first, "", " ")).cast(pa.string()), flat, "")
    if not all(even):
        whole = {int(at): t for at, t, e in zip(np.cumsum(counts) - counts, texts, even) if not e}
        mask = np.zeros(len(flat), bool)
        mask[list(whole)] = True
        spaced = pc.replace_with_mask(spaced, pa.array(mask), pa.array([whole[i] for i in sorted(whole)], pa.string()))
    return counts, spaced


_BLOCK = (
    "doc_id array<long>, counts array<long>, codes array<int>, fresh boolean, "
    "piece_sizes array<int>, piece_words array<int>, words array<array<long>>, known array<array<int>>"
)


def _blocker(shared, native: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file: RankFile = shared.value
        cut = regex.compile(file.pattern)
        byte_ids = file.byte_ids()
        piece_codes: dict[str, int] = {}
        word_codes: dict[str, int] = {}
        fresh = True
        for part in text_chunks(batches, size=_BLOCK_CHARS):
            if len(piece_codes) > _WORDS_HELD:
                piece_codes, word_codes, fresh = {}, {}, True
            counts, flat = _pieces([t or "" for t in part.column("text").to_pylist()])
            coded = pc.dictionary_encode(flat)
            sizes, inside, new_words = [], [], []
            for piece in (dictionary := coded.dictionary.to_pylist()):
                if piece in piece_codes:
                    continue
                piece_codes[piece] = len(piece_codes)
                words = cut.findall(piece)
                sizes.append(len(words))
                for word in words:
                    code = word_codes.get(word)
                    if code is None:
                        code = word_codes[word] = len(word_codes)
                        new_words.append(word.encode("utf-8", "replace"))
                    inside.append(code)
            local = np.fromiter(map(piece_codes.__getitem__, dictionary), np.int32, len(dictionary))
            codes = local[coded.indices.to_numpy()] if len(dictionary) else np.empty(0, np.int32)
            known = [[file.ranks[w]] if w in file.ranks else merge_long(w, file) if len(w) > _LONG_WORD else None for w in new_words]
            if native:
                packed = [packed_bytes(w, file, byte_ids) if k is None else [] for w, k in zip(new_words, known)]
                known = [k or [] for k in known]
            else:
                packed = [[]] * len(known)
                open_ = [i for i, k in enumerate(known) if k is None]
                for i, ids in zip(open_, merge_batch([new_words[i] for i in open_], file)):
                    known[i] = ids
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                    pa.array([codes], pa.list_(pa.int32())), pa.array([fresh]), pa.array([sizes], pa.list_(pa.int32())),
                    pa.array([inside], pa.list_(pa.int32())), pa.array([packed], pa.list_(pa.list_(pa.int64()))),
                    pa.array([known], pa.list_(pa.list_(pa.int32()))),
                ],
                names=["doc_id", "counts", "codes", "fresh", "piece_sizes", "piece_words", "words", "known"],
            )
            fresh = False

    return run


class _Held:
    """Variable-length values of numbered items in one array."""

    def __init__(self, kind):
        self.flat, self.starts, self.sizes = np.empty(0, kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])

    def of(self, codes: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.starts[codes], self.sizes[codes])]


def _sums(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of so many values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(groups)
    return total[ends] - total[ends - groups]


def _assembler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = texts = piece_ids = piece_texts = None
    for batch in batches:
        for i in range(batch.num_rows):
            at = {name: batch.column(name).slice(i, 1) for name in batch.schema.names}
            flat = {name: at[name].flatten() for name in at if name != "fresh"}
            if at["fresh"][0].as_py():
                ids, texts = _Held(np.int32), _Held(np.uint8)
                piece_ids, piece_texts = _Held(np.int32), _Held(np.uint8)
            ids.add(flat["ids"].flatten().to_numpy(), pc.list_value_length(flat["ids"]).to_numpy().astype(np.int64))
            blob = flat["decoded"]
            sizes = pc.binary_length(blob).to_numpy().astype(np.int64)
            texts.add(np.frombuffer(b"".join(blob.to_pylist()), np.uint8), sizes)
            inside, groups = flat["piece_words"].to_numpy(), flat["piece_sizes"].to_numpy().astype(np.int64)
            piece_ids.add(ids.of(inside), _sums(ids.sizes[inside], groups))
            piece_texts.add(texts.of(inside), _sums(texts.sizes[inside], groups))
            codes, counts = flat["codes"].to_numpy(), flat["counts"].to_numpy()
            n_ids, n_bytes = _sums(piece_ids.sizes[codes], counts), _sums(piece_texts.sizes[codes], counts)
            ends = np.concatenate([[0], np.cumsum(n_ids)]).astype(np.int32)
            raw, stops = piece_texts.of(codes).tobytes(), np.concatenate([[0], np.cumsum(n_bytes)])
            yield pa.RecordBatch.from_arrays(
                [flat["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(piece_ids.of(codes))),
                 pa.array([raw[a:b] for a, b in zip(stops[:-1], stops[1:])], pa.binary())],
                names=["doc_id", "ids", "decoded"],
            )


def encode_documents(
    docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", native: bool = False
) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, decoded (the bytes that the ids stand for).

    ``ranks`` is the content of a rank file, ``pattern`` what cuts texts into words. Null is
    the empty text, with no ids. Repeated rows give repeated results, a null id stays null; an
    empty table gives an empty result; other columns are not read. ``native`` folds merges
    with higher-order functions in the JVM, else the same steps are taken for a batch of words at once.
    Decoding is a higher-order function either way.
    """
    spark = docs.sparkSession
    file = RankFile.read(ranks, pattern)
    shared = spark.sparkContext.broadcast(file)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = rows.mapInArrow(_blocker(shared, native), _BLOCK)
    tables = _literal_row(spark, file)
    blocks = blocks.withColumn("pieces", tables.select("pieces").scalar())
    if native:
        blocks = blocks.withColumn("table", tables.select("table").scalar())
        ids = F.zip_with(
            "words", "known", lambda word, known: F.when(F.size(known) > 0, known).otherwise(encode_word(word, F.col("table"), file.shape))
        )
    else:
        ids = F.col("known")
    blocks = blocks.withColumn("ids", ids)
    blocks = blocks.withColumn("decoded", F.transform("ids", lambda word: decode_ids(word, F.col("pieces"))))
    columns = ["doc_id", "counts", "codes", "fresh", "piece_sizes", "piece_words", "ids", "decoded"]
    return blocks.select(*columns).mapInArrow(_assembler, "doc_id long, ids array<int>, decoded binary")


def _literal_row(spark: SparkSession, file: RankFile) -> DataFrame:
    """The rank map and the bytes of each id as one row; as scalars they are literals of the plan that uses them."""
    pieces = [""] * (max(file.ranks.values()) + 1)
    for token, rank in file.ranks.items():
        pieces[rank] = token.hex()
    return spark.createDataFrame([(file.table.tolist(), pieces)], "table array<long>, pieces array<string>")
