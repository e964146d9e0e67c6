"""Vectorised word, window and n-gram hashing over Arrow string batches.

Everything here works on one numpy byte buffer that holds the whole texts of a slice of rows, so that the cost is
a few nanoseconds a byte and memory is bounded by the slice, or by the longest text where that is longer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of the separators of words `[^\x20\x09-\x0D]+`.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACED = np.ones(256, bool)
SPACED[list(SPACES)] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and all that isn't ASCII, after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

SLICE_BYTES = 2 << 20
_LIBC = ctypes.CDLL(None)
_SEGMENT = 1 << 18
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SALTS = (0x2545F4914F6CDD1D, 0x94D049BB133111EB)
_MASK = (1 << 64) - 1
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n at least."""
    size = max(_SEGMENT * 2, 1 << (n - 1).bit_length() if n > 1 else 1)
    if (got := _powers.get((base, size))) is None:
        got = np.full(size, base, np.uint64)
        got[0] = 1
        _powers[base, size] = got = np.cumprod(got)
    return got


def mix(z: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64 bits that spreads every input bit."""
    z = z + np.uint64(salt)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, and an executor's memory is for all of them."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(_LIBC, "malloc_trim", None)) is not None:
        trim(0)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about `limit` bytes; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end
    release()


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every row, and the index of each row's first word (one more entry at the end)."""
    m = inside[buf]
    before = np.zeros(len(m), bool)
    before[1:] = m[:-1]
    edge = offs[(offs > 0) & (offs < len(buf))]
    before[edge] = False
    start = np.flatnonzero(m & ~before)
    after = np.zeros(len(m), bool)
    after[:-1] = m[1:]
    after[edge - 1] = False
    end = np.flatnonzero(m & ~after) + 1
    return start, end, np.searchsorted(start, offs)


def rows_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of every word's bytes; equal words have equal hashes wherever they stand."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    base = _BASES[lane]
    inverse = pow(base, -1, 1 << 64)
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(buf), _SEGMENT)), len(start)))
    for w0, w1 in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = int(start[w0]), int(end[w1 - 1])
        total = np.zeros(hi - lo + 1, np.uint64)
        x = buf[lo:hi].astype(np.uint64)
        x += np.uint64(1)
        x *= _power(base, hi - lo)[: hi - lo]
        np.cumsum(x, out=total[1:])
        s, e = start[w0:w1] - lo, end[w0:w1] - lo
        out[w0:w1] = (total[e] - total[s]) * _power(inverse, hi - lo)[s]
    return mix(out, _SALTS[lane])


def window_hashes(h: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """A hash for each run of n consecutive words, by the index of its first word; runs may cross rows."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    base = np.uint64(_BASES[1 - lane])
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= base
        out += h[j : len(h) - n + 1 + j]
    return mix(out, _SALTS[1 - lane] ^ n)


def whole_windows(first: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of the runs of n words lie within one row."""
    row = rows_of(first)
    return row[: words - n + 1] == row[n - 1 :] if words >= n else np.empty(0, bool)


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
