"""Token sequences of bounded length, packed by minimum bin slack."""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dumpsieve.llm.shared import coded_words, give_back, spread, stored, text_chunks

_CACHED = 250_000  # strings whose ids a worker keeps
_TOGETHER = 5_000
_CHUNK_CHARS = 2 << 20

# Steps of a vocabulary before its merges that Arrow does as well for words of Latin letters, digits and signs: NFC
# changes nothing there, lower case is one character for one, and RE2 splits as the tokenizer does.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_STEPS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, _BYTES],
    },
}
_LATIN = r"^[!-~\x{A1}-\x{12F}\x{131}-\x{17F}]+$"


@dataclass(frozen=True)
class Packing:
    length: int = 4096
    end_id: int = 1
    group: int = 2048  # pieces that one task packs together
    merge: int = 16  # groups whose open sequences are packed anew together


class _Words:
    """Ids of the strings seen so far, in one array; forgotten when there are too many.

    Strings are the parts that the tokenizer splits words into: there are fewer of them, and they need nothing but its
    merges. Words with other characters or the name of an added token are taken whole, and all words if the
    vocabulary has other steps before the merges.
    """

    def __init__(self, vocabulary: str):
        steps = json.loads(vocabulary)
        self.whole = Tokenizer.from_str(vocabulary)
        self.whole.no_truncation()
        self.names = [token["content"].lower() for token in steps["added_tokens"]]
        self.parts = None
        if all(steps[name] == step for name, step in _STEPS.items()):
            only = {"normalizer": None, "pre_tokenizer": _BYTES, "added_tokens": [], "truncation": None}
            self.parts = Tokenizer.from_str(json.dumps(steps | only))
        self.forget()

    def forget(self) -> None:
        self.number: dict[Tokenizer, dict[str, int]] = {self.whole: {}, self.parts: {}}
        self.ids = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)

    def _numbers(self, tokenizer: Tokenizer, strings: pa.Array) -> np.ndarray:
        number, strings = self.number[tokenizer], strings.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(number.get, strings, itertools.repeat(-1)), np.int64, len(strings))
        new = strings[numbers < 0].tolist()
        if new:
            ids, sizes = [self.ids], []
            for at in range(0, len(new), _TOGETHER):  # many strings in one result: a result for each costs more than its ids
                some = new[at : at + _TOGETHER]
                found = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
                ids.append(np.array(found.ids, np.int32))
                sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))
            sizes = np.concatenate(sizes)
            numbers[numbers < 0] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            number.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate(ids)
        return numbers

    def _splits(self, words: pa.Array, lower: pa.Array) -> np.ndarray:
        """Which words can be taken by their parts."""
        if self.parts is None:
            return np.zeros(len(words), bool)
        plain = pc.match_substring_regex(words, _LATIN)
        for name in self.names:
            plain = pc.and_not(plain, pc.match_substring(lower, name))
        return plain.to_numpy(zero_copy_only=False)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has."""
        if sum(map(len, self.number.values())) > _CACHED:
            self.forget()
        lower = pc.utf8_lower(words)
        splits = self._splits(words, lower)
        owner, codes, parts = coded_words(pc.replace_substring_regex(lower.filter(pa.array(splits)), _SPLIT, r"\0 "))
        n = np.ones(len(words), np.int64)
        n[splits] = np.bincount(owner, minlength=np.count_nonzero(splits))
        of_parts = np.repeat(splits, n)
        numbers = np.empty(len(of_parts), np.int64)
        numbers[of_parts] = self._numbers(self.parts, parts)[codes]
        numbers[~of_parts] = self._numbers(self.whole, words.filter(pa.array(~splits)))
        sizes = self.sizes[numbers]
        ids = self.ids[spread(self.starts[numbers], sizes)]
        return ids, np.bincount(np.repeat(np.arange(len(words)), n), weights=sizes, minlength=len(words)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def _words(vocabulary: str) -> _Words:
    return _Words(vocabulary)


def encode(texts: pa.Array, words: _Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with ``end_id`` behind, and where each text begins.

    The vocabulary splits at white space before all else, and the names of its special tokens, which become
    their ids, hold none: so words can be encoded one by one.
    """
    rows, codes, distinct = coded_words(texts)
    of_words, n = words.encode(distinct)
    sizes = n[codes]
    total = np.bincount(rows, weights=sizes, minlength=len(texts)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(total + 1)])
    ids = np.full(begin[-1], end_id, np.int32)
    if len(codes):
        inside = np.ones(len(ids), bool)
        inside[begin[1:] - 1] = False
        ids[inside] = of_words[spread((np.cumsum(n) - n)[codes], sizes)]
    return ids, begin


def _cutter(vocabulary, options: Packing, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(vocabulary.value)
        for part in text_chunks(batches, size=_CHUNK_CHARS):
            ids, begin = encode(part.column("text"), words, options.end_id)
            total = np.diff(begin)
            n = -(-total // options.length)
            owner = np.repeat(np.arange(len(total)), n)
            piece = spread(np.zeros(len(n), np.int64), n)
            start = piece * options.length
            size = np.minimum(total[owner] - start, options.length)
            first = begin[:-1][owner] + start
            plain = ids.astype("<u4")
            sums = [zlib.crc32(plain[a : a + s].tobytes()) for a, s in zip(first, size)]
            columns = [
                part.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start),
                pa.array(size), pa.array(sums, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
            give_back()

    return run


def cut_documents(
    docs: DataFrame, vocabulary: str, options: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Pieces of at most ``length`` ids: doc_id, piece, start, length, ids_crc32 and the ids.

    ``vocabulary`` is the content of a tokenizer file (a few MB, broadcast) whose first step drops white space.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(_cutter(shared, options, with_ids), schema)


def _fullest(lengths: np.ndarray, left: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, how many) of a choice of the available lengths with the largest sum up to ``room``.

    Bit s of ``sums`` says whether some choice adds up to s. The longest come first, and
    numbers of one length as powers of two, until the room is met or nothing is left.
    """
    sums, mask, goal = 1, (1 << (room + 1)) - 1, 1 << room
    steps: list[tuple[int, int, int]] = []
    for length in lengths[np.searchsorted(-lengths, -room) :].tolist():
        most, take = min(int(left[length]), room // length), 1
        while most > 0:
            take = min(take, most)
            more = (sums | (sums << (length * take))) & mask
            if more != sums:
                steps.append((length, take, sums))
                sums = more
            most -= take
            take *= 2
        if sums & goal:
            break
    at, chosen = sums.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen.append((length, take))
            at -= length * take
    return chosen


def fill(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece. Every sequence takes the longest piece left and its fullest completion."""
    by_length: dict[int, list[int]] = {}
    for i, size in enumerate(sizes.tolist()):
        by_length.setdefault(size, []).append(i)
    left = np.zeros(capacity + 1, np.int64)
    for size, found in by_length.items():
        left[size] = len(found)
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    lengths = np.array(sorted(by_length, reverse=True), np.int64)
    number = 0
    while len(lengths):
        longest = int(lengths[0])
        left[longest] -= 1
        chosen = [(longest, 1), *_fullest(lengths, left, capacity - longest)] if longest < capacity else [(longest, 1)]
        left[longest] += 1
        at = 0
        for length, take in chosen:
            for _ in range(take):
                i = by_length[length].pop()
                sequence[i], offset[i] = number, at
                at += length
            left[length] -= take
        if any(left[length] == 0 for length, _ in chosen):
            lengths = lengths[left[lengths] > 0]
        number += 1
    return sequence, offset


_MARK = "sequence_id long, offset long, open boolean"


def _packer(capacity: int, base: int, bits: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "ids_crc32"], kind="stable")
        sizes = group["length"].to_numpy()
        sequence, offset = fill(sizes, capacity)
        if "sequence_id" in group and group["sequence_id"].nunique() <= sequence.max() + 1:
            return group.assign(open=True)[[*_COLUMNS, "sequence_id", "offset", "open"]]  # nothing saved: all stay as they were
        out = group[_COLUMNS].copy()
        out["sequence_id"] = base + (group["team"].to_numpy() << bits) + sequence
        out["offset"] = offset
        out["open"] = np.bincount(sequence, weights=sizes)[sequence] < capacity
        return out

    return run


_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack(pieces: DataFrame, options: Packing = Packing()) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces of full length are sequences. The others are dealt at random into teams of about ``group``
    rows, packed in one task each. Sequences that stay open are dealt anew, whole, and their pieces packed
    anew: ``merge`` times fewer teams as long as none gets more than about ``group`` rows (or few sequences
    of more rows each), until one team is left, or teams are that large and a level saves no sequence.
    """
    full = pieces.filter(F.col("length") == options.length).select(
        *_COLUMNS, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.filter(F.col("length") < options.length).select(*_COLUMNS)
    rows, sequences, base, level = rest.count(), None, 0, 1
    teams = max(1, -(-rows // options.group))
    key = F.monotonically_increasing_id()  # rows may repeat, also with their ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + _MARK
    done = [full]
    while True:
        team = F.pmod(F.xxhash64(key, F.lit(level)), F.lit(teams).cast("long")).alias("team")
        bits = rows.bit_length()  # so many sequences fit whatever a team gets
        packer = _packer(options.length, base, bits)
        packed = stored(rest.select("*", team).groupBy("team").applyInPandas(packer, schema), "packed")
        begins = F.col("offset") == 0
        made, still, open_rows = packed.agg(
            F.count_if(begins), F.count_if(begins & F.col("open")), F.count_if(F.col("open"))
        ).first()
        fewest = max(1, -(-open_rows // options.group))
        last = teams == 1 or made == sequences and teams <= fewest
        done.append((packed if last else packed.filter(~F.col("open"))).select(*_COLUMNS, "sequence_id", "offset"))
        if last:
            break
        rest = packed.filter("open").select(*_COLUMNS, "sequence_id", "offset")
        base, level, rows, sequences, key = base + (teams << bits), level + 1, open_rows, still, F.col("sequence_id")
        teams = max(fewest, -(-teams // options.merge))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(
    docs: DataFrame, vocabulary: str, options: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text, or one of white space only, is its end id alone. Only documents longer than a
    sequence are cut. Repeated rows and null ids are documents like others; an empty table gives an
    empty result; other columns are not read.
    """
    return pack(stored(cut_documents(docs, vocabulary, options, id_col, text_col, with_ids=False), "pieces"), options)
