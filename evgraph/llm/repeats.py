"""Which hashes occur more than once in the whole corpus, as a filter of bounded size.

Every task sorts the hashes of its documents, drops its own repeats and sends each
bucket of hash space one delta-coded run of 40-bit values (about three bytes each).
A bucket counts what meets there and returns one page of a blocked Bloom filter, which
the driver joins to a filter of at most 2**max_bits bits, whatever the input's size. The filter
has no false negatives, so what it lets through holds every repeat; callers verify the rest exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evgraph.llm.shared import bucket_bits, firsts
from evgraph.llm.text import U64, Slice, slices

FLUSH = 1 << 21
MAX_BITS = 28
_KEPT = 40  # bits of a hash that are exchanged
_RUN = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("deltas", pa.binary()), ("multi", pa.binary()), ("flag", pa.binary())])
_PAGE = pa.schema([("bucket", pa.int32()), ("page", pa.binary()), ("hot", pa.binary())])
_SPREAD = (1, 0x9E3779B1, 0x85EBCA77)


class RepeatFilter:
    """Membership of 64-bit hashes; picklable, meant to be broadcast."""

    def __init__(self, bits: int, bucket: int, pages: bytes, hot: np.ndarray):
        self.bits, self.bucket, self.pages, self.hot = bits, bucket, pages, hot

    def holds(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(0, bool)
        page = (h >> U64(64 - self.bucket)).astype(np.int64)
        low = ((h >> U64(64 - _KEPT)) & U64(0xFFFFFFFF)).astype(np.uint32)
        data = np.frombuffer(self.pages, np.uint8)
        found = np.ones(len(h), bool)
        width = self.bits - self.bucket
        for at in _places(low, width):
            at = (page << width) + at
            found &= (data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found

    def is_hot(self, h: np.ndarray) -> np.ndarray:
        return np.isin(h >> U64(64 - _KEPT), self.hot)


def _places(low: np.ndarray, width: int) -> Iterator[np.ndarray]:
    for k in _SPREAD:
        yield ((low * np.uint32(k)) >> np.uint32(32 - width)).astype(np.int64)


def _runs(hashes: list[np.ndarray], flags: list[np.ndarray], bucket: int) -> Iterator[pa.RecordBatch]:
    key = (np.concatenate(hashes) >> U64(64 - _KEPT)) << U64(1)
    key |= np.concatenate(flags).astype(U64)
    key.sort()
    flag = (key & U64(1)).astype(bool)
    key >>= U64(1)
    at = np.flatnonzero(firsts(key))
    ends = np.r_[at[1:], len(key)]
    flag, multi, key = flag[ends - 1], ends - at > 1, key[at]  # within equal keys, flagged ones sort last
    shift = U64(_KEPT - bucket)
    edges = np.searchsorted(key >> shift, np.arange((1 << bucket) + 1).astype(U64))
    rows = []
    # a bucket fixes the top bits; 32 bits stay, or fewer buckets than 2**8 keep all 40
    low = key & U64((1 << (_KEPT - bucket)) - 1)
    for b in np.flatnonzero(np.diff(edges)):
        a, e = edges[b], edges[b + 1]
        deltas = np.diff(low[a:e], prepend=U64(0))
        planes = deltas.view(np.uint8).reshape(-1, 8).T[:5]
        rows.append((int(b), int(e - a), planes.tobytes(), np.packbits(multi[a:e]).tobytes(), np.packbits(flag[a:e]).tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RUN.types, strict=True)], schema=_RUN)


def _page(bucket: int, bits: int, flagged: bool, hot_from: int) -> Callable[[pa.Table], pa.Table]:
    width = bits - bucket

    def page(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        parts = []
        for n, deltas, multi, flag in zip(*(table[c].to_pylist() for c in _RUN.names[1:]), strict=True):
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :5] = np.frombuffer(deltas, np.uint8).reshape(5, n).T
            low = np.cumsum(wide.view(U64).ravel())
            code = np.unpackbits(np.frombuffer(multi, np.uint8), count=n).astype(U64)
            code |= np.unpackbits(np.frombuffer(flag, np.uint8), count=n).astype(U64) << U64(1)
            parts.append(low << U64(2) | code)
        key = np.concatenate(parts)
        key.sort()
        low, code = key >> U64(2), key & U64(3)
        at = np.flatnonzero(firsts(low))
        count = np.diff(np.r_[at, len(low)])
        code = np.bitwise_or.reduceat(code, at)
        keep = (count > 1) | (code & U64(1) == 1)
        if flagged:
            keep &= code >= 2
        full = (U64(b) << U64(_KEPT - bucket)) | low[at]
        kept = (full[keep] & U64(0xFFFFFFFF)).astype(np.uint32)
        out = np.zeros(1 << width, np.uint8)
        for place in _places(kept, width):
            out[place] = 1
        hot = full[keep & (count >= hot_from)] if hot_from else full[:0]
        return pa.table([[b], [np.packbits(out, bitorder="little").tobytes()], [hot.tobytes()]], schema=_PAGE)

    return page


def repeat_filter(
    docs: DataFrame,
    hashes: Callable[[Slice], tuple[np.ndarray, np.ndarray | None]],
    total_bytes: int,
    flagged: bool = False,
    max_bits: int = MAX_BITS,
    hot_from: int = 0,
) -> RepeatFilter:
    """Filter of the hashes that occur twice or more in all of docs (column text) together.

    hashes gives a slice's hashes and, with flagged, which of them may serve as the reference:
    then only hashes with such an occurrence count. hot_from: hashes that come from so many
    tasks' runs or more are listed exactly in hot; there are at most (all hashes / hot_from).
    """
    bits = int(min(max_bits, max(16, np.ceil(np.log2(max(2, total_bytes / 8))))))
    bucket = min(bucket_bits(total_bytes), bits - 8)

    def runs(batches):
        hs, fs, n = [], [], 0
        for batch in batches:
            for s in slices(batch.column("text")):
                h, f = hashes(s)
                if not len(h):
                    continue
                hs.append(h)
                fs.append(np.zeros(len(h), bool) if f is None else f)
                n += len(h)
                if n >= FLUSH:
                    yield from _runs(hs, fs, bucket)
                    hs, fs, n = [], [], 0
        if n:
            yield from _runs(hs, fs, bucket)

    found = (
        docs.select("text")
        .mapInArrow(runs, "bucket int, n int, deltas binary, multi binary, flag binary")
        .groupBy("bucket")
        .applyInArrow(_page(bucket, bits, flagged, hot_from), "bucket int, page binary, hot binary")
        .toArrow()
    )
    size = 1 << (bits - bucket - 3)
    pages = bytearray(size << bucket)
    for b, page in zip(found["bucket"].to_pylist(), found["page"], strict=True):
        pages[b * size : (b + 1) * size] = page.as_buffer()
    hot = np.frombuffer(b"".join(found["hot"].to_pylist()), U64)
    return RepeatFilter(bits, bucket, bytes(pages), np.sort(hot))
