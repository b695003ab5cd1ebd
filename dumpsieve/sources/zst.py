"""Executor-side reading of zstd dumps, as Arrow batches of lines.

A zstd file is a sequence of independent frames, so a large dump made of several
frames (parallel compressors and appended files produce them) is read by several
tasks.  A split is a range of bytes, cut without a look at the file; it stands for
the frames that begin in it.  The task that reads a split finds the first of them: in
the seek table at the end of the file if there is one, else by the magic number and a
valid chain of block headers behind it.  As with any splittable text, a line belongs
to the split in which it starts: a split that does not open the file skips to its
first newline, and every split reads on past its end to finish its last line.  Of a
file of one frame all but the first split are empty.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import cloudpickle

# Fixed values of the zstd format.
_FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
_SKIPPABLE_MAGIC = b"\x2a\x4d\x18"  # after a byte 0x50..0x5f
_SEEK_TABLE_MAGIC = b"\x5e\x2a\x4d\x18"
_SEEK_FOOTER_MAGIC = b"\xb1\xea\x92\x8f"
_MAX_BLOCK = 128 << 10

# Fixed values of the reader.
MAX_WINDOW = 1 << 31
MAX_LINE_BYTES = 10 << 20
EXTENSION = ".zst"

_READ_BYTES = 64 << 10  # compressed bytes decoded at a time; bounds the output of one step
_BATCH_BYTES = 4 << 20
_BATCH_ROWS = 10_000  # of short batches that are sent as one
_HEADER_BYTES = 1 << 20
_CHAIN_BLOCKS = 64  # so many valid block headers in a row make a frame

SPLIT_SCHEMA = "file string, path string, first bigint, last bigint, bin int, place bigint"
LINE_SCHEMA = "file string, split bigint, line bigint, value binary, status string"
PLACED_SCHEMA = LINE_SCHEMA + ", place bigint, whole boolean"
END = "end"
FAILED = "failed: "

# The functions below run inside tasks; send them along instead of asking for
# this package to be installed on every executor.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


# ---------------------------------------------------------------- frames


class _Headers:
    """Random access to a file for reading small headers in rising order."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.start, self.data = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if at < self.start or at + n > self.start + len(self.data):
            want = min(max(n, _HEADER_BYTES), max(0, self.size - at))
            self.start, self.data = at, self.file.read_at(want, at) if want else b""
        return self.data[at - self.start : at - self.start + n]


def _skippable(head: bytes) -> int:
    """Length of the skippable frame that begins so, or 0."""
    if len(head) >= 8 and head[1:4] == _SKIPPABLE_MAGIC and head[0] & 0xF0 == 0x50:
        return 8 + int.from_bytes(head[4:8], "little")
    return 0


def _next_frame(headers: _Headers, at: int) -> int:
    """Behind the skippable frames at ``at``."""
    while at < headers.size and (skip := _skippable(headers.read(at, 8))):
        at += skip
    return at


def begins_frame(headers: _Headers, at: int) -> bool:
    """Whether a data frame begins here: its blocks follow each other by their headers, for many
    blocks or up to an end behind which there is another frame or nothing.

    By chance that happens about once in 2^68 bytes. It also holds for a frame that is stored
    as content inside another one, which text cannot have (its bytes are not UTF-8) and
    which the reader of the outer frame finds out.
    """
    head = headers.read(at, 18)
    if len(head) < 6 or head[:4] != _FRAME_MAGIC or head[4] & 8:
        return False
    flags = head[4]
    single_segment = flags >> 5 & 1
    size_bytes = (single_segment, 2, 4, 8)[flags >> 6]
    at += 5 + (1 - single_segment) + (0, 1, 2, 4)[flags & 3] + size_bytes
    for _ in range(_CHAIN_BLOCKS):
        block = headers.read(at, 3)
        if len(block) < 3:
            return False
        word = int.from_bytes(block, "little")
        kind, size = word >> 1 & 3, word >> 3
        if kind == 3 or size > _MAX_BLOCK:
            return False
        at += 3 + (1 if kind == 1 else size)
        if word & 1:
            at += 4 * (flags >> 2 & 1)
            head = headers.read(at, 8)
            return at == headers.size or head[:4] == _FRAME_MAGIC or _skippable(head) > 0
    return at <= headers.size


def seek_table(headers: _Headers) -> np.ndarray | None:
    """Offsets of the frames by the table in a skippable frame at the end, if there is one that fits the file."""
    size = headers.size
    foot = headers.read(size - 9, 9) if size >= 17 else b""
    if foot[5:] != _SEEK_FOOTER_MAGIC:
        return None
    count, width = int.from_bytes(foot[:4], "little"), 12 if foot[4] & 0x80 else 8
    length = count * width + 9
    at = size - length - 8
    if at < 0 or headers.read(at, 8) != _SEEK_TABLE_MAGIC + length.to_bytes(4, "little"):
        return None
    entries = np.frombuffer(headers.read(at + 8, count * width), "<u4").reshape(count, width // 4)
    ends = np.cumsum(entries[:, 0].astype(np.int64))
    if count and ends[-1] != at:
        return None
    return np.concatenate([[0], ends])[:-1] if count else np.zeros(0, np.int64)


def first_frame(file, first: int, last: int) -> int | None:
    """Where the first data frame begins in [first, last), or None."""
    if first == 0:
        return 0
    headers = _Headers(file)
    table = seek_table(headers)
    if table is not None:
        at = int(np.searchsorted(table, first))
        # The table may count skippable frames: they are no place to begin.
        while at < len(table) and table[at] < last:
            if headers.read(int(table[at]), 4) == _FRAME_MAGIC:
                return int(table[at])
            at += 1
        return None
    end, at = min(last, headers.size), first
    while at < end:
        data = file.read_at(min(_HEADER_BYTES, end + 3 - at), at)
        hit = data.find(_FRAME_MAGIC)
        while hit >= 0 and at + hit < end:
            if begins_frame(_Headers(file), at + hit):
                return at + hit
            hit = data.find(_FRAME_MAGIC, hit + 1)
        if len(data) < 4:
            break
        at += len(data) - 3
    return None


def find_frames(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: rows of ``SPLIT_SCHEMA`` -> file, first, begin (of the first frame in the split, or null)."""
    for batch in batches:
        begins = []
        for row in batch.to_pylist():
            try:
                fs, name = open_fs(row["path"])
                with fs.open_input_file(name) as file:
                    begins.append(first_frame(file, row["first"], row["last"]))
            except OSError:  # the reader of the file will report it
                begins.append(0 if row["first"] == 0 else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), batch.column("first"), pa.array(begins, pa.int64())], names=["file", "first", "begin"]
        )


# ---------------------------------------------------------------- bytes


def give_back() -> None:
    """Return what this Python worker holds unused, which else stays with it until its executor ends."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


class DumpError(Exception):
    """A file that cannot be read to its end."""


class _Decoded:
    """Decoded bytes of the frames from ``first`` on, up to the damage if there is any.

    Ends at the first frame that begins at ``limit`` or later, where the next split
    takes over; ``last`` is then the place of that frame, or the size of the file.
    """

    def __init__(self, file, first: int, limit: int):
        self.file, self.first, self.limit = file, first, limit
        self.headers, self.size, self.last = _Headers(file), file.size(), first

    def _ends(self, at: int) -> bool:
        """Whether the next split begins with the frame at ``at``. What is none stays with this one, which will report it."""
        if at < self.limit:
            return False
        at = _next_frame(self.headers, at)
        if at < self.size and not begins_frame(self.headers, at):
            return False
        self.last = min(at, self.size)
        return True

    def __iter__(self) -> Iterator[bytes]:
        codec = zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW)
        at, data = self.first, b""  # offset behind data, which is still to be decoded
        frame, frame_at, frame_out = None, self.first, 0
        seen, tail = [], b""  # places behind the limit that look like a frame
        while True:
            if not data:
                data = self.file.read_at(min(_READ_BYTES, self.size - at), at)
                if at + len(data) > self.limit:
                    both = tail + data
                    hit = both.find(_FRAME_MAGIC)
                    while hit >= 0:
                        seen.append(at - len(tail) + hit)
                        hit = both.find(_FRAME_MAGIC, hit + 1)
                tail = (tail + data)[-3:]
                at += len(data)
                if not data:
                    break
            if frame is None:
                if self._ends(at - len(data)):
                    break
                frame, frame_at, frame_out = codec.decompressobj(), at - len(data), 0
            try:
                out = frame.decompress(data)
            except zstandard.ZstdError:
                yield from _until_damage(self.file, frame_at, at - len(data), at, frame_out)
                raise
            frame_out += len(out)
            data = b""
            if frame.eof:
                data, frame = frame.unused_data, None
            if out:
                yield out
        if frame is not None:
            raise DumpError("unexpected end of file")
        if not data:
            self.last = self.size
        for place in seen:
            if self.limit <= place < self.last and begins_frame(self.headers, place) and seek_table(self.headers) is None:
                raise DumpError(f"a frame seems to begin at {place}, inside another: read this file in one split")


def _until_damage(file, frame_at: int, bad_from: int, bad_to: int, skip: int) -> Iterator[bytes]:
    """What the bytes in [bad_from, bad_to) of a damaged frame still decode to."""
    file.seek(frame_at)
    data = file.read(bad_to - frame_at)
    frame = zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW).decompressobj()
    step = bad_from - frame_at
    pieces = [data[i : i + _READ_BYTES] for i in range(0, step, _READ_BYTES)]
    pieces += [data[i : i + 1] for i in range(step, len(data))]
    for piece in pieces:
        try:
            out = frame.decompress(piece)
        except zstandard.ZstdError:
            return
        if out[skip:]:
            yield out[skip:]
        skip = max(0, skip - len(out))


def _split_bytes_with_last_line(file, first: int, limit: int) -> Iterator[bytes]:
    """The bytes of the lines that start in a split whose first frame is at ``first``."""
    own = _Decoded(file, first, limit)
    chunks = iter(own)
    if first > 0:
        for chunk in chunks:
            cut = chunk.find(b"\n") + 1
            if cut:
                yield chunk[cut:]
                break
        else:
            return  # no line starts here
    yield from chunks
    if own.last < own.size:
        for chunk in _Decoded(file, own.last, own.size):
            cut = chunk.find(b"\n") + 1
            if cut:
                yield chunk[:cut]
                return
            yield chunk


def _lines_of(data: bytes, complete: bool) -> tuple[pa.Array, pa.Array, bytes]:
    """Lines of ``data`` without their ends, their lengths as read, and the bytes left over.

    What follows the last newline is a line only if the data is ``complete``.
    """
    cut = data.rfind(b"\n") + 1
    rest, whole = data[cut:], memoryview(data)[: cut - 1] if cut else None
    if whole is None:
        lines = pa.array([], pa.binary())
    else:
        offsets = pa.py_buffer(np.array([0, len(whole)], np.int32))
        text = pa.Array.from_buffers(pa.binary(), 1, [None, offsets, pa.py_buffer(whole)])
        lines = pc.split_pattern(text, b"\n").values
    if complete and rest:
        lines, rest = pa.concat_arrays([lines, pa.array([rest], pa.binary())]), b""
    lengths = pc.binary_length(lines)
    if b"\r" in data:
        lines = pc.if_else(pc.ends_with(lines, b"\r"), pc.binary_slice(lines, 0, -1), lines)
    return lines, lengths, rest


def _line_arrays(chunks: Iterator[bytes]) -> Iterator[pa.Array]:
    """Arrays of lines; what stopped the reading is raised after the last of them.

    Bytes left in front of damage are the last line, as they are at the end of a file.
    """
    pending, gathered, held = b"", [], 0
    error = None
    done = False
    while not done:
        try:
            chunk = next(chunks, None)
        except (DumpError, zstandard.ZstdError, OSError) as err:
            chunk, error = None, err
        done = chunk is None
        if not done:
            gathered.append(chunk)
            held += len(chunk)
            if held < _BATCH_BYTES:
                continue
        data = b"".join([pending, *gathered])
        gathered, held = [], 0
        lines, lengths, pending = _lines_of(data, complete=done)
        if (pc.max(lengths).as_py() or 0) >= MAX_LINE_BYTES:
            too_long = pc.greater_equal(lengths, MAX_LINE_BYTES)
            yield lines[: pc.index(too_long, True).as_py()]
            raise DumpError("line too long")
        yield lines
        if len(pending) >= MAX_LINE_BYTES:
            raise DumpError("line too long")
    if error is not None:
        raise error


# ---------------------------------------------------------------- lines


def _batch(file: str, split: int, line: int, values: pa.Array, status: str | None) -> pa.RecordBatch:
    n = len(values)
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(pa.scalar(file), n),
            pa.repeat(pa.scalar(split, pa.int64()), n),
            pa.array(np.arange(line, line + n, dtype=np.int64)),
            values,
            pa.repeat(pa.scalar(status, pa.string()), n),
        ],
        names=["file", "split", "line", "value", "status"],
    )


def _rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, pa.RecordBatch]]:
    for batch in batches:
        for row in sorted(batch.to_pylist(), key=lambda r: (r["file"], r["first"])):
            file, first, line = row["file"], row["first"], 0
            status = END
            try:
                fs, name = open_fs(row["path"])
                with fs.open_input_file(name) as source:
                    row["whole"] = first == 0 and row["last"] >= source.size()
                    begin = first_frame(source, first, row["last"])
                    chunks = iter(()) if begin is None else _split_bytes_with_last_line(source, begin, row["last"])
                    for values in _line_arrays(chunks):
                        if len(values):
                            yield row, _batch(file, first, line, values, None)
                            line += len(values)
            except (DumpError, zstandard.ZstdError, OSError) as err:
                status = FAILED + str(err)
            yield row, _batch(file, first, line, pa.nulls(1, pa.binary()), status)
    values = chunks = None
    give_back()


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches: many splits have few lines, most of a large frame none but their closing row."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= _BATCH_ROWS or size >= _BATCH_BYTES:
            yield from _joined(held)
            held, rows, size = [], 0, 0
    yield from _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return batches if len(batches) < 2 else pa.Table.from_batches(batches).combine_chunks().to_batches()


def read_splits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: rows of ``SPLIT_SCHEMA`` -> rows of ``LINE_SCHEMA``.

    Each split closes with one row without value whose ``line`` is the number of
    lines and whose ``status`` is ``end`` or tells why reading stopped.
    """
    yield from _packed(batch for _, batch in _rows_of(batches))


def read_placed_splits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``read_splits``, with ``place``, where the split begins when all files are laid end to end,
    and ``whole``, whether it is all of its file."""

    def placed(row: dict, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        more = [pa.repeat(pa.scalar(row["place"], pa.int64()), n), pa.repeat(pa.scalar(row.get("whole", False)), n)]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "place", "whole"])

    yield from _packed(placed(row, batch) for row, batch in _rows_of(batches))
