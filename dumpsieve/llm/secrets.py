"""Secrets in texts, also below URL, Unicode, base64 and compressed layers.

A worklist holds layers of a text that are still to be read. Each is scanned, and every
encoded piece in it becomes a layer of its own, until nothing new appears. A layer knows
for each of its characters the range of the original text that it comes from.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpsieve.llm.shared import give_back, text_chunks

# Fixed patterns of the kinds of secrets, in the order in which spans at one place are listed.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run's first 16 belong to one run, so this finds whole runs
KINDS = ("assign", "access", "hex")

_TOKEN = re.compile(r"[^\x00-\x20\x7f]+")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_URL_PART = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{60,}(?:\r?\n[A-Za-z0-9+/_-]+)+={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
_BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_BASE64_CHARS = re.compile(r"[^ \t\r\n=]")
_PRINTED, _OTHER = re.compile(rb"[\x20-\x7e]{16,}"), re.compile(rb"[^\x20-\x7e]")
_BINARY_AS_TEXT = re.compile(r"[^\t\n\r\x20-\x7e\x80-\U0010ffff]")

# What follows the first line of base64: lines of the same width, also indented, and a last shorter one.
_NEXT_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+)(?=={0,2}(?:[ \t]*(?:\r?\n|\Z)|[^\sA-Za-z0-9+/_=-]))")

#: Bytes of what a compressed piece holds that are scanned at once, and that are read at once.
WINDOW, _READ = 4 << 20, 1 << 16
# Behind these bytes a window may end: no secret, run of base64 or URL token reaches over them.
_CUT = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|[,;!?(){}<>\[\]|][\x20\t\r\n]")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets in one layer, left to right, not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class _Layer:
    """``text`` with the range [begin[i], end[i]) of the original that its i-th character comes from."""

    text: str
    begin: np.ndarray
    end: np.ndarray


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if _BINARY_AS_TEXT.search(text) else text


def _char_starts(data: bytes) -> np.ndarray:
    """Position of the first byte of every character of UTF-8 ``data``, and its length at the end."""
    raw = np.frombuffer(data, np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def _codec(head: bytes):
    """A decompressor for what begins with these bytes; None if they begin nothing compressed."""
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj(wbits=47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd" or _skipped(head):
        return zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
    return None


def _skipped(head: bytes) -> bool:
    return head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5 and len(head) >= 8  # a frame that zstd skips


class _Bytes:
    """Bytes from an iterator, some of which can be looked at first or put back."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.damaged = chunks, b"", False

    def look(self, n: int) -> bytes:
        while len(self.held) < n and (chunk := next(self.chunks, None)) is not None:
            self.held += chunk
        return self.held[:n]

    def take(self, n: int = _READ) -> bytes:
        out = self.look(n) if len(self.held) < 1 else self.held[:n]
        self.held = self.held[len(out) :]
        return out

    def __iter__(self) -> Iterator[bytes]:
        while chunk := self.take():
            yield chunk


_OUT_BYTES = 1 << 20
_DAMAGE = (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError)


def _one_member(data: _Bytes, codec) -> Iterator[bytes]:
    """What the member in front of ``data`` holds, as far as it can be read, a bounded number of bytes at a time."""
    if _skipped(head := data.look(8)):
        left = 8 + int.from_bytes(head[4:8], "little")
        while left > 0 and (chunk := data.take(min(left, _READ))):
            left -= len(chunk)
        return
    zstd = head[:4] == b"\x28\xb5\x2f\xfd"
    size = 1 << 10 if zstd else _READ  # a KiB of zstd can hold some MiB
    chunk = rest = out = b""
    try:
        while not codec.eof:
            if not rest and len(out) < _OUT_BYTES and getattr(codec, "needs_input", True):
                if not (taken := data.take(size)):
                    data.damaged = True
                    data.held = chunk + data.held
                    return
                chunk = rest = taken
            out = codec.decompress(rest) if zstd else codec.decompress(rest, _OUT_BYTES)
            rest = b"" if zstd else getattr(codec, "unconsumed_tail", b"")
            for at in range(0, len(out), _READ):
                yield out[at : at + _READ]
            if zstd:
                out = b""
    except _DAMAGE:
        data.damaged, data.held = True, chunk + data.held  # its bytes may be something else
        return
    data.held = codec.unused_data + data.held


def _unfolded(data: _Bytes, above: frozenset[bytes] = frozenset(), behind: bool = True) -> Iterator[bytes] | None:
    """What the compressed members in front hold below all their layers, then what is ``behind`` them; None if there are none.

    A later member that is compressed twice is unfolded by itself; a first one together with those behind it.
    """
    head = data.look(_READ)
    if (codec := _codec(head)) is None or head in above:  # such as a file that unfolds to itself
        return None

    def members() -> Iterator[bytes]:
        first, found = True, codec
        while found is not None:
            inner = _Bytes(_one_member(data, found))
            deeper = None if first or _codec(inner.look(8)) is None else _unfolded(inner, above | {head})
            yield from inner if deeper is None else deeper
            first = False
            while not data.damaged and data.look(1) == b"\0":  # padding between members
                data.held = data.held.lstrip(b"\0")
            found = None if data.damaged else _codec(data.look(8))
        if behind and data.look(1):
            yield b"\0"
            yield from data

    whole = _Bytes(members())
    if not whole.look(1):
        return None
    return iter(whole) if (deeper := _again(whole, above | {head})) is None else deeper


def _again(whole: _Bytes, above: frozenset[bytes]) -> Iterator[bytes] | None:
    """What ``whole`` unfolds to; None leaves it as it was."""
    head = whole.look(_READ)
    if _codec(head) is None or head in above:
        return None
    # Its first bytes must hold something, else they only look like a compressed piece.
    if not any(_one_member(_Bytes(iter([head])), _codec(head))):
        return None
    return _unfolded(whole, above)


def _windows(chunks: Iterator[bytes]) -> Iterator[str]:
    """The bytes as texts of about ``WINDOW``, cut only where nothing reaches over."""
    held = bytearray()
    for chunk in chunks:
        at = max(0, len(held) - 1)
        held += chunk
        if len(held) < WINDOW:
            continue
        end = max((m.end() for m in _CUT.finditer(held, at if at >= WINDOW else 0)), default=0)
        if end:
            yield held[:end].decode("utf-8", "replace")
            del held[:end]
    if held:
        yield held.decode("utf-8", "replace")


def _escaped(layer: _Layer, escapes: list[re.Match], decode) -> _Layer | None:
    """The layer with escapes replaced; other characters stay, and all keep their places."""
    texts, begins, ends = [], [], []
    at = 0
    for m in escapes:
        pieces, starts, stops = decode(m)
        texts += [layer.text[at : m.start()], pieces]
        begins += [layer.begin[at : m.start()], layer.begin[m.start() + starts]]
        ends += [layer.end[at : m.start()], layer.end[m.start() + stops - 1]]
        at = m.end()
    if not escapes:
        return None
    texts.append(layer.text[at:])
    begins.append(layer.begin[at:])
    ends.append(layer.end[at:])
    return _Layer("".join(texts), np.concatenate(begins), np.concatenate(ends))


def _url_layer(layer: _Layer) -> _Layer | None:
    escapes: list[re.Match] = []
    for token in _TOKEN.finditer(layer.text):
        if "%" in token.group() and _PERCENT.search(token.group()):  # a plus is a space only there
            escapes += _URL_PART.finditer(layer.text, token.start(), token.end())
    return _escaped(layer, escapes, _url_part)


def _url_part(m: re.Match):
    if m.group() == "+":
        return " ", np.array([0]), np.array([1])
    data = bytes.fromhex(m.group().replace("%", ""))
    try:
        text, at = data.decode("utf-8"), _char_starts(data) * 3
    except UnicodeDecodeError:
        text, at = data.decode("latin-1"), np.arange(len(data) + 1) * 3
    return text, at[:-1], at[1:]


def _unicode_layer(layer: _Layer) -> _Layer | None:
    return _joined(_escaped(layer, list(_UNICODE.finditer(layer.text)), _unicode_part))


def _unicode_part(m: re.Match):
    code = int(next(g for g in m.groups() if g), 16)
    # Halves of a pair are joined afterwards.
    return chr(code) if code <= 0x10FFFF else "\ufffd", np.array([0]), np.array([len(m.group())])


def _joined(layer: _Layer | None) -> _Layer | None:
    """Surrogate pairs as one character; lone halves as a replacement."""
    if layer is None or not re.search("[\ud800-\udfff]", layer.text):
        return layer
    text, keep, ends = [], [], layer.end.copy()
    i = 0
    while i < len(layer.text):
        c, after = layer.text[i], layer.text[i + 1 : i + 2]
        keep.append(i)
        if "\ud800" <= c <= "\udbff" and "\udc00" <= after <= "\udfff":
            text.append(chr(0x10000 + ((ord(c) - 0xD800) << 10) + ord(after) - 0xDC00))
            ends[i] = layer.end[i + 1]
            i += 2
        else:
            text.append("\ufffd" if "\ud800" <= c <= "\udfff" else c)
            i += 1
    return _Layer("".join(text), layer.begin[keep], ends[keep])


def _printed_layer(layer: _Layer, data: bytes, places: np.ndarray, skip: int, begin: int = 0) -> _Layer | None:
    """The bytes of a run of base64 from ``begin`` on, with blanks for all that is not printed; None if no longer run is."""
    if not _PRINTED.search(data, begin):
        return None
    byte = np.arange(begin, len(data))
    first, last = places[skip + byte * 4 // 3], places[skip + (byte * 8 + 7) // 6]
    return _Layer(_OTHER.sub(b" ", data[begin:]).decode("ascii"), layer.begin[first], layer.end[last])


def _base64_layer(layer: _Layer, body: str, places: np.ndarray) -> Iterator[tuple[_Layer, bool]]:
    """A run of base64 as text, or as what compressed pieces in it unfold to, and whether that is all there is in it.

    Characters in front may belong to something else, so all four phases are tried.
    """
    body = body.replace("-", "+").replace("_", "/")
    for skip in range(4):
        piece = body[skip:]
        if len(piece) % 4 == 1:
            piece = piece[:-1]
        data = base64.b64decode(piece + "=" * (-len(piece) % 4))
        text = _readable(data)
        if text:
            byte = _char_starts(data)
            first = places[skip + byte[:-1] * 4 // 3]
            last = places[skip + ((byte[1:] - 1) * 8 + 7) // 6]
            yield _Layer(text, layer.begin[first], layer.end[last]), True
            return
        source = _Bytes(data[at : at + _READ] for at in range(0, len(data), _READ))
        if (contents := _unfolded(source, behind=False)) is not None:
            # Archives and mixed content: control characters stay, other bytes that are no UTF-8 become marks.
            for text in _windows(contents):
                n = len(text)  # no character of a compressed piece has a place of its own
                begin, end = layer.begin[places[skip]], layer.end[places[-1]]
                yield _Layer(text, np.broadcast_to(begin, n), np.broadcast_to(end, n)), False
            if not source.damaged:
                if printed := _printed_layer(layer, data, places, skip, len(data) - sum(map(len, source))):
                    yield printed, False
                return
        if printed := _printed_layer(layer, data, places, skip):  # text behind or between something else
            yield printed, False
            return


def _lines(text: str, first: re.Match) -> tuple[int, bool]:
    """Where the lines of base64 that begin with ``first`` end, and whether there are several."""
    end, width, several = first.end(), first.end() - first.start(), False
    while (line := _NEXT_LINE.match(text, end)) and len(line.group(1)) <= width:
        end, several = line.end(), True
        if len(line.group(1)) < width:
            break
    return end, several


def _base64_layers(layer: _Layer) -> Iterator[_Layer]:
    joined_to = 0
    for run in _BASE64.finditer(layer.text):
        body = run.group().rstrip("=")
        alone = True
        spans = [(run.start(), run.start() + len(body))] if "\n" in body else []
        if run.start() >= joined_to:
            end, several = _lines(layer.text, _BASE64_LINE.match(layer.text, run.start()))
            if several and (run.start(), end) not in spans:
                joined_to = end
                spans.append((run.start(), end))
        for start, end in spans:
            places = np.array([m.start() for m in _BASE64_CHARS.finditer(layer.text, start, end)])
            for joined, complete in _base64_layer(layer, re.sub(r"[ \t\r\n=]", "", layer.text[start:end]), places):
                yield joined
                alone = alone and not (complete and end >= run.start() + len(body))
        if not alone:
            continue
        for line in _BASE64_LINE.finditer(body):
            places = np.arange(run.start() + line.start(), run.start() + line.end())
            for single, _ in _base64_layer(layer, line.group(), places):
                yield single


def _inner_layers(layer: _Layer) -> Iterator[_Layer | None]:
    yield from _base64_layers(layer)
    if "%" in layer.text:
        yield _url_layer(layer)
    if "\\" in layer.text:
        yield _unicode_layer(layer)


_END = object()


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (start, kind, end) in the text itself, and all spans with those from its layers."""
    text = text or ""
    base = scan(text)
    if not ("%" in text and _PERCENT.search(text)) and "\\" not in text and not _BASE64.search(text):
        return base, base
    places = np.arange(len(text) + 1)
    work = [_inner_layers(_Layer(text, places[:-1], places[1:]))]
    seen: set[tuple[bytes, int, int]] = set()
    spans = set(base)
    while work:
        inner = next(work[-1], _END)
        if inner is _END:
            work.pop()
            continue
        if inner is None or not inner.text:
            continue
        # The same content from the same place is a cycle, such as a file that unfolds to itself.
        mark = hashlib.md5(inner.text.encode("utf-8", "replace")).digest(), int(inner.begin[0]), int(inner.end[-1])
        if mark in seen:
            continue
        seen.add(mark)
        work.append(_inner_layers(inner))
        for start, kind, end in scan(inner.text):
            spans.add((int(inner.begin[start:end].min()), kind, int(inner.end[start:end].max())))
    return base, sorted(spans)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with ``mark`` in place of the spans; touching or overlapping spans get one."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start > at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


def _scanner():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            counts, listed, base_listed = [], [], []
            for text in part.column("text").to_pylist():
                base, spans = find_secrets(text)
                counts.append([sum(kind == k for _, kind, _ in base) for k in range(3)])
                base_listed.append(_listed(base))
                listed.append(_listed(spans))
            n = np.array(counts, np.int64).reshape(-1, 3)
            rest = [i for i, name in enumerate(part.schema.names) if name != "text"]
            columns = [part.column(i) for i in rest]
            columns += [pa.array(n[:, k]) for k in range(3)] + [pa.array(base_listed, pa.string()), pa.array(listed, pa.string())]
            names = [part.schema.names[i] for i in rest] + ["n_assign", "n_access", "n_hex", "base_spans", "spans"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_OUT = "n_assign long, n_access long, n_hex long, base_spans string, spans string"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_spans, spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind; counts
    and base_spans are those of the text as it stands, spans has those from decoded layers
    as well, at the place of the piece that hides them. Null and empty texts have none;
    repeated rows give repeated results; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scanner(), f"doc_id {kind}, {_OUT}")


def _redactor(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, text_col):
            clean = []
            for text in part.column(text_col).to_pylist():
                _, spans = find_secrets(text)
                clean.append(redact(text, spans) if spans else text)
            columns = [pa.array(clean, f.type) if f.name == text_col else c for f, c in zip(part.schema, part.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)
        give_back()

    return run


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of all secrets in ``text_col`` replaced by a mark; null stays null.

    All rows and columns stay as they are otherwise; texts of any length are scanned whole.
    """
    return docs.mapInArrow(_redactor(text_col), docs.schema)
