"""NumPy kernels over the UTF-8 bytes of Arrow string columns; no Python work for each word.

A chunk is (data, offsets): the bytes of its texts end to end, and where each begins. Hashes are 64 bits: polynomial
prefix sums modulo 2**64 give any substring's hash in O(1), and a finaliser spreads them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
GOLD = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x + U(GOLD)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODE = mix(np.arange(256, dtype=U))
PLACE = mix(np.arange(1000, 1064, dtype=U)) | U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, U(BASE)), np.full(n, U(INVERSE))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; sizes are rounded up so that few tables are made."""
    size = CHUNK_BYTES + 4096
    while size < n:
        size *= 2
    up, down = _powers(size) if size < 16 * CHUNK_BYTES else _powers.__wrapped__(n)
    return up[:n], down[:n]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offsets) of runs of rows of about limit bytes; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if not pa.types.is_binary(column.type) else pa.large_binary()).fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    _, offs, buf = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of code(data[t]) * BASE**t over i <= t < j."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each data[start:end], wherever it stands."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U) * U(GOLD))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and of each text the index of its first word (and one more at the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and of each text the index of its first word (and one more at the end)."""
    starts, ends, at = word_spans(data, offsets)
    out, i = np.zeros(len(starts), U), 0
    while i < len(starts):  # a very long text in parts, so that memory is bounded by its words
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")))
        part = data[starts[i] : ends[j - 1]]
        out[i:j] = span_hash(prefix_hash(LOWER[part] if lower else part), starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return out, at


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence."""
    n, out = len(hashes), []
    g = np.zeros(max(0, n - k + 1), U)
    for j in range(k):
        g += hashes[j : j + len(g)] * PLACE[j]
    g = mix(g)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.sum(hashes[a:b] * PLACE[: b - a], keepdims=True) + np.array([(b - a) * GOLD % (1 << 64)], U)))
        else:
            out.append(np.zeros(0, U))
    return out
