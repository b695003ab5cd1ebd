"""Dump files made and read by hand."""

from __future__ import annotations

import zstandard


def frame(data: bytes, **options) -> bytes:
    return zstandard.ZstdCompressor(**options).compress(data)


def raw_frame(data: bytes, window_log: int) -> bytes:
    """A frame by hand: one raw block, and a header that asks for a window of 2**window_log."""
    header = b"\x28\xb5\x2f\xfd" + bytes([0, (window_log - 10) << 3])
    return header + (len(data) << 3 | 1).to_bytes(3, "little") + data


def read_zst(path) -> bytes:
    with open(path, "rb") as file:
        return zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
