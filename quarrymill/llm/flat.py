"""Whole Arrow batches of texts as one byte buffer, worked on with numpy; no per-character Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of a 64-bit mixer (public-domain finalizer).
M1, M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def tidy() -> None:
    """Gives freed memory back to the system, so that workers that Spark keeps for later tasks stay small."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    if col.null_count:  # a null may span bytes in theory
        size = np.diff(offs)
        if size[np.asarray(col.is_null())].any():
            return flat(col.fill_null(b""))
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def runs_of_docs(offs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, last) document ranges of at most so many bytes, a longer document alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * M1
    x ^= x >> U64(33)
    x *= M2
    x ^= x >> U64(33)
    return x


def byte_table(seed: int) -> np.ndarray:
    """256 fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_ODD = 0x9E3779B97F4A7C15 | 1
_INV = pow(_ODD, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=U64)
    if n > 1:
        out[1:] = U64(base)
        np.multiply.accumulate(out, out=out)
    return out


class Rolling:
    """Hashes of any ranges of a buffer: prefix sums of table values times powers, modulo 2^64, brought to a common power."""

    _pow: np.ndarray = powers(_ODD, 1)
    _inv: np.ndarray = powers(_INV, 1)

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        if len(Rolling._pow) < n:
            size = -(-n // 500_000) * 500_000
            Rolling._pow, Rolling._inv = powers(_ODD, size), powers(_INV, size)
        self.prefix = np.zeros(n, dtype=U64)
        np.cumsum(values * Rolling._pow[: n - 1], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * Rolling._inv[start] + (end - start).astype(U64))
