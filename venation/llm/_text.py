"""Words of UTF-8 text, found and hashed on byte arrays.

White space that separates words is one byte each, so words can be cut and hashed without decoding. A word's hash is a
polynomial in its bytes modulo 2**64, taken from prefix sums, so that cost is a few array operations a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at a time; bounds the scratch arrays to some 100 MB.
STEP = 2 << 20
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(None)
def _bytes(lower: bool) -> np.ndarray:
    values = np.arange(256, dtype=U)
    if lower:
        values[65:91] += U(32)
    return mix(values + U(0x1234567)) | U(1)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, U), np.full(n, pow(BASE, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(1)
def _space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[9, 10, 11, 12, 13, 32]] = True
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their n + 1 offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    if where is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most `most` bytes together; a longer row stands alone."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of every word, and for each text the number of its first word (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = np.empty(n + 1, bool)
    np.logical_not(_space()[data], out=solid[:n])
    solid[n] = False
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[offsets] = True
    starts = solid[:n].copy()
    starts[1:] &= ~solid[: n - 1] | cut[1:n]
    ends = solid[:n] & (~solid[1:] | cut[1:])
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of the spans, which must be in order and apart."""
    out, table, lo = np.empty(len(starts), U), _bytes(lower), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + STEP, "right")))
        first, last = int(starts[lo]), int(ends[hi - 1])
        size = STEP if last - first <= STEP else 1 << (last - first - 1).bit_length()
        up, down = _powers(size)
        total = np.empty(last - first + 1, U)
        total[0] = 0
        np.multiply(table[data[first:last]], up[: last - first], out=total[1:])
        np.cumsum(total, out=total)
        a, b = starts[lo:hi] - first, ends[lo:hi] - first
        out[lo:hi] = mix((total[b] - total[a]) * down[a] + (b - a).astype(U))
        lo = hi
    return out


def grams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that lie within one text, and for each text the number of its first run (n + 1 values)."""
    if len(words) < k:
        return np.zeros(0, U), np.zeros(len(first), np.int64)
    total = np.zeros(len(words) - k + 1, U)
    for i in range(k):
        total = total * U(0xD6E8FEB86659FD93) + words[i : len(words) - k + 1 + i]
    sizes = np.diff(first)
    counts = np.maximum(sizes - (k - 1), 0)
    inside = np.ones(len(total), bool)
    for i in range(1, k):  # runs that begin among a text's last k - 1 words would leave it
        late = first[1:][sizes >= i] - i
        inside[late[late < len(total)]] = False
    return mix(total[inside]), np.concatenate([[0], np.cumsum(counts)])


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as byte planes of their differences: what is compressed later shrinks to a few bytes each."""
    steps = np.diff(values, prepend=U(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(U), dtype=U)
