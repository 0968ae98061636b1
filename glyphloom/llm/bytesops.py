"""Vectorised work on the UTF-8 bytes of Arrow string columns: words and their hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
MIX = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are looked at together: bounds memory, whatever the length of a text.
CHUNK = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1), modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        p = np.full(size, BASE, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8_rows(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each row, without copies; empty for null."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield view[offsets[i] : offsets[i + 1]] if valid[i] else memoryview(b"")


def _segments(data: np.ndarray) -> Iterator[np.ndarray]:
    """data in runs of about CHUNK bytes, cut at white space."""
    start, n = 0, len(data)
    while n - start > CHUNK:
        at = start + CHUNK
        while at < n:
            found = np.flatnonzero(IS_SPACE[data[at : at + 4096]])
            if len(found):
                at += int(found[0])
                break
            at += 4096
        at = min(at, n)
        yield data[start:at]
        start = at
    yield data[start:]


def word_hashes(view: memoryview) -> np.ndarray:
    """A 64-bit hash of every word, A-Z lower-cased, in order."""
    out = []
    for seg in _segments(np.frombuffer(view, np.uint8)):
        space = IS_SPACE[seg]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        size = ends - starts
        inside = np.flatnonzero(~space)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        pos = np.arange(len(inside)) - np.repeat(first, size)
        v = BYTE_TABLE[LOWER[seg[inside]]] * powers(int(size.max()))[pos]
        out.append(mix64(np.add.reduceat(v, first) + size.astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(view: memoryview, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of all runs of k words; of the whole sequence if it is shorter; empty without words."""
    w = word_hashes(view)
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        h = h + w[i : len(w) - k + 1 + i] * MIX[i]
    return np.unique(mix64(h))
