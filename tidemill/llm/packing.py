"""Compact binary forms of many (key, position) pairs, for shuffles of a few bytes a pair."""

from __future__ import annotations

import numpy as np
import zstandard


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the numbers, all lowest bytes first; zero planes cost nothing once compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""


def _numbers(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel() if data else np.zeros(0, dtype)


def pack_numbers(x: np.ndarray) -> bytes:
    """Compressed numbers; small ones take about a byte."""
    return zstandard.ZstdCompressor(level=1).compress(_planes(np.ascontiguousarray(x)))


def unpack_numbers(data: bytes, dtype) -> np.ndarray:
    return _numbers(zstandard.ZstdDecompressor().decompress(data), dtype)


def pack_places(keys: np.ndarray, positions: np.ndarray) -> bytes:
    """Pairs of an int64 key and a position, in an order where equal keys are together and positions rise in each."""
    fresh = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(fresh)
    steps = np.diff(positions.astype(np.int64), prepend=0)
    steps[starts] = positions[starts]
    own = keys[starts]
    parts = [
        pack_numbers(np.diff(own, prepend=np.int64(0)).astype(np.int64)),
        pack_numbers(np.diff(np.r_[starts, len(keys)]).astype(np.uint32)),
        pack_numbers(steps.astype(np.uint32)),
    ]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    parts, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        parts.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    own = np.cumsum(unpack_numbers(parts[0], np.int64))
    counts = unpack_numbers(parts[1], np.uint32).astype(np.int64)
    run = np.cumsum(unpack_numbers(parts[2], np.uint32).astype(np.int64))
    starts = np.cumsum(counts) - counts
    first = unpack_numbers(parts[2], np.uint32)[starts].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    return np.repeat(own, counts), run - np.repeat(run[starts] - first, counts)


def split_by(groups: np.ndarray, count: int):
    """(group, indices) of each group that occurs; indices keep their order."""
    order = np.argsort(groups.astype(np.uint16) if count <= 65536 else groups, kind="stable")
    ends = np.cumsum(np.bincount(groups, minlength=count))
    begin = 0
    for group, end in enumerate(ends):
        if end > begin:
            yield group, order[begin:end]
        begin = end
