"""Words of many texts at once, as hashes: the arrays that shingles and windows are made of."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from faultline.llm.common import mix64

#: bytes hashed at a time, and the base of the polynomial over them
BLOCK, BASE = 1 << 19, 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS:
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(BLOCK + 1, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[base] = (made[0], made[1])
    return _POWERS[base]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the bounds of each text (a null text has none)."""
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    bounds = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and for each text the number of its first word (one more at the end).

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D; none reaches from one text into the next.
    """
    ink = np.ones(len(data) + 2, bool)
    ink[0] = ink[-1] = False
    ink[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    begin = ink[1:-1] & ~ink[:-2]
    end = ink[1:-1] & ~ink[2:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begin[inner] = ink[1:-1][inner]
    end[inner - 1] = ink[1:-1][inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hashes of the words: a polynomial over the bytes, from differences of running sums, then mixed."""
    up, down = _powers(base)
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        at = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, at + BLOCK, side="right")))
        if ends[last - 1] - at > BLOCK:  # one word longer than a block
            h = 0
            for b in data[at : ends[first]].tolist():
                h = (h * base + b + 1) & 0xFFFFFFFFFFFFFFFF
            out[first] = h
        else:
            part = data[at : ends[last - 1]].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            s, e = starts[first:last] - at, ends[first:last] - at
            out[first:last] = (sums[e] - sums[s]) * down[s]
        first = last
    return mix64(out ^ (ends - starts).astype(np.uint64))


def runs(hashes: np.ndarray, firsts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words that lie within one text, and where (in words) each starts."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n - length + 1, np.uint64)
    for i in range(length):
        h = mix64(h * np.uint64(0x100000001B3) + hashes[i : n - length + 1 + i] + np.uint64(i))
    inside = np.zeros(n + 1, bool)
    counts = np.diff(firsts)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(n - length + 1) + length <= firsts[1:][owner[: n - length + 1]]
    at = np.flatnonzero(inside)
    return h[at], at
