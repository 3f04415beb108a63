"""Array helpers shared by the text operators: whole texts as UTF-8 byte
arrays, word boundaries, and polynomial hashes of byte ranges.

An Arrow batch is worked through in blocks of whole texts of about
``BLOCK_BYTES`` bytes, so the memory of a task follows the block (or the
longest single text), never the batch. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: What a worker process keeps between tasks of one operator; the next operator
#: that runs in the same process drops it.
CACHES: list[dict] = []


def release() -> None:
    for cache in CACHES:
        cache.clear()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def give_back() -> None:
    """Return the freed memory that Arrow and the C library keep to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(task):
    """A task's function over batches that gives freed memory back when it ends,
    so that a worker waiting for its next task doesn't hold the last one's."""
    @functools.wraps(task)
    def run(batches):
        yield from task(batches)
        give_back()
    return run


_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def utf8_blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) with offsets[0] = 0."""
    release()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if len(col) == 0:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, buf = col.buffers()
    offs = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    lo, n = 0, len(col)
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (new array)."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same on every machine."""
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(salt)) | _U(1)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, ``n`` at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = 1 << max(10, int(n - 1).bit_length())
        inv = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [_geometric(_BASE, m), _geometric(inv, m)]
    return _POWERS[0], _POWERS[1]


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=_U)
    size, step = 1, base
    while size < n:
        out[size:2 * size] = out[:size] * _U(step)
        step = step * step % (1 << 64)
        size *= 2
    return out


@functools.cache
def letter_values(lower: bool, salt: int = 7) -> np.ndarray:
    """A random 64-bit value for each byte; with ``lower``, A-Z count as a-z."""
    vals = mix64(np.arange(1, 257, dtype=_U) * _U(_BASE) + _U(salt))
    if lower:
        vals[65:91] = vals[97:123]
    return vals


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums P of value * base**position: a range's hash is
    (P[end] - P[start]) * base**-start."""
    return prefix_sums(values[data])


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """The same of given 64-bit values, one per position."""
    pw, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * pw[:len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of the byte ranges [start, end); equal ranges, equal hashes."""
    _, inv = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * inv[start])


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of word bytes inside a text."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = is_word[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def gram_hash(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (length - k + 1 values)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    mult = seeds(k, 1000 + k + salt)
    acc = words[:n] * mult[0]
    for j in range(1, k):
        acc += words[j:j + n] * mult[j]
    return mix64(acc)


def as_long(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed integers Spark stores."""
    return np.ascontiguousarray(x).view(np.int64)


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Start of each row's entries in a row-sorted entry list (n + 1 bounds)."""
    return np.searchsorted(rows, np.arange(n + 1))


@functools.cache
def space_words() -> np.ndarray:
    """Bytes of words that are separated by 0x20 and 0x09-0x0D."""
    ok = np.ones(256, dtype=bool)
    ok[[0x20, 9, 10, 11, 12, 13]] = False
    return ok


@functools.cache
def alnum_words() -> np.ndarray:
    """Bytes of words made of ASCII letters, digits and all non-ASCII bytes."""
    ok = np.zeros(256, dtype=bool)
    ok[0x30:0x3A] = ok[0x41:0x5B] = ok[0x61:0x7B] = ok[0x80:] = True
    return ok


def binary_column(buf: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of the ranges ``bounds[i]:bounds[i + 1]`` of ``buf`` (bytes)."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1,
                                 [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(buf.tobytes())])
