"""Vectorised views of Arrow text columns: byte slices, words, shingles and rolling hashes.

Everything here works inside one Spark task on slices of a few megabytes, so the
memory of a task doesn't depend on the size of its partition. A text is one
document; hashes never cross documents. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = (1 << 20) - 64  # the tables of powers for a slice then have 2**20 entries
# odd multipliers of the two independent polynomial hashes, for bytes and for words
_BASES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    size = 1 << 16
    while size < n:
        size *= 2
    return _powers(base, size)


def poly_prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i; see span_hash."""
    up, _ = powers(base, len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Position-free hash of each span [start, end) of the values behind prefix."""
    _, down = powers(base, len(prefix) + 1)
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


_BYTE_VALUES = [mix(np.arange(1, 257, dtype=U64) * U64(k)) for k in (0x632BE59BD9B4E019, 0xE220A8397B1DCDAF)]


class Slice:
    """Some whole documents of a batch: their bytes and where each begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.rows = len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def byte_prefix(self, which: int = 0) -> np.ndarray:
        return poly_prefix(_BYTE_VALUES[which][self.data], _BASES[which][0])

    def byte_hash(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        return span_hash(prefix, start, end, _BASES[which][0])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the words: runs of bytes other than 0x20 and 0x09 to 0x0D."""
        d, n = self.data, len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none
        solid = ~((d == 32) | ((d >= 9) & (d <= 13)))
        opens = np.zeros(n + 1, bool)
        opens[self.offsets] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = solid[:-1]
        starts = np.flatnonzero(solid & (~before | opens[:-1]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = solid[1:]
        ends = np.flatnonzero(solid & (~after | opens[1:])) + 1
        return starts, ends, self.doc_of(starts)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's documents in slices of about limit bytes; one longer document is a slice alone."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, where, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Slice(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes unchanged."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_hashes(s: Slice, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return s.byte_hash(s.byte_prefix(which), starts, ends, which)


def window_hashes(words: np.ndarray, at: np.ndarray, size: int | np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the windows of size words that begin at the given word numbers."""
    base = _BASES[which][1]
    return span_hash(poly_prefix(words, base), at, at + size, base)


def full_windows(docs: np.ndarray, size: int) -> np.ndarray:
    """Word numbers at which a window of size words lies in one document."""
    if len(docs) < size:
        return np.zeros(0, np.int64)
    return np.flatnonzero(docs[: len(docs) - size + 1] == docs[size - 1 :])


def join_words(s: Slice, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The given words of each document joined by one space: the bytes, where each word begins in them, and where each document does."""
    last = np.ones(len(docs), bool)
    last[:-1] = docs[1:] != docs[:-1]
    size = ends - starts + ~last
    stop = np.cumsum(size)
    begin = stop - size
    out = np.append(s.data, np.uint8(32))[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(starts - begin, size)]
    out[stop[~last] - 1] = 32
    offsets = np.r_[0, stop][np.searchsorted(docs, np.arange(s.rows + 1))]
    return out, begin, offsets
