"""Vectorised word and window hashing over Arrow text buffers.

All functions work on the UTF-8 bytes of many texts at once. A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``
unless another separator table is given; bytes of multi-byte characters are never separators, so byte and character
views agree. Hashes are 64-bit polynomials with wrap-around, finished by a bijective mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BASE, BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Bytes of text hashed at a time; a longer single text is still handled whole.
CHUNK = 1 << 19

SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Separators for lexical models: every ASCII byte that is neither a letter nor a digit.
NON_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


@lru_cache(8)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(1 << bits, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i below n."""
    up, down = _powers(base, max(12, int(n).bit_length()))
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words(NamedTuple):
    start: np.ndarray  #: byte position of each word in ``data``
    end: np.ndarray  #: byte position after each word
    hash: np.ndarray  #: uint64 of each word
    first: np.ndarray  #: per text, the index of its first word; one more entry ends the last text
    data: np.ndarray  #: the texts' bytes
    at: np.ndarray  #: per text, its first byte in ``data``; one more entry ends the last text
    prefix: np.ndarray | None = None  #: uint64 of each word's first bytes, if asked for


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and byte offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back: a worker lives on between tasks, next to those of other cores."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim:
        trim(0)


def releasing(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``work`` on a partition's batches, which gives back at its end what it freed: a worker that waits holds little."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch], *args, **options) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches, *args, **options)
        finally:
            release()

    return run


@lru_cache(1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``size`` bytes of text, or one longer text."""
    _, at = texts(batch.column(column))
    i, n = 0, batch.num_rows
    if at[-1] > size:
        release()
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def words(column: pa.Array, separators: np.ndarray = SPACES, fold: np.ndarray = SAME, prefix: int = 0) -> Words:
    data, at = texts(column)
    n = len(data)
    gap = separators[data]
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    before = np.empty(n, bool)
    before[:1] = True
    before[1:] = gap[:-1]
    start = np.flatnonzero(~gap & (before | begins[:n]))
    after = np.empty(n, bool)
    after[-1:] = True
    after[:-1] = gap[1:]
    end = np.flatnonzero(~gap & (after | begins[1:])) + 1
    up, down = powers(BASE, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(BASE2))
    front = None
    if prefix:
        stop = np.minimum(end, start + prefix)
        front = mix((total[stop] - total[start]) * down[start] + np.uint64(BASE))
    return Words(start, end, h, np.searchsorted(start, at), data, at, front)


def grams(w: Words, k: int, base: int = BASE2) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether those k words lie in one text."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    up, down = powers(base, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * up[:n], out=total[1:])
    g = mix((total[k:] - total[:-k]) * down[: n - k + 1])
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    return g, text[: n - k + 1] == text[k - 1 :]


def sliding(x: np.ndarray, k: int, of: np.ufunc) -> np.ndarray:
    """``of`` over every k consecutive values, by doubling."""
    if len(x) < k:
        return x[:0]
    out, have = x, 1
    while have < k:
        step = min(have, k - have)
        out = of(out[: len(out) - step], out[step:])
        have += step
    return out
