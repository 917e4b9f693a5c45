"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

Each window of `length` bytes chooses one of its first `reach` positions as anchor by content (the smallest rolling hash of
eight bytes), so equal windows choose the same anchor. Suffixes begin at anchors and carry the bytes to their left
that their windows cover. Suffixes whose next bytes occur nowhere else are left out by a filter without false
negatives. Tasks sort the others, cut them at range borders, and send front-coded runs: the length of the prefix shared with
the suffix before, and the rest. A range merges its runs with a loser tree that carries common-prefix lengths, so that
prefixes known to be equal are never compared again; the merged lengths bound each group of suffixes that can share a window,
in which windows are compared from their anchor to both sides.

A suffix group that many tasks hold is dealt window by window, so that its equal windows
collapse before the exchange and no range grows with one passage.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.repeats import repeat_filter
from evgraph.llm.shared import batch_of, bucket_bits, doc_key, hashed_sample, text_bytes, text_tag
from evgraph.llm.text import U64, Slice, slices

GRAM = 8
FLUSH = 1 << 16  # suffixes of a run
HOT_RUNS = 256  # from so many runs on, a suffix group is dealt window by window
SAMPLE_DOCS = 400
_RUN = pa.schema([("bucket", pa.int32()), ("run", pa.binary())])


def anchors(s: Slice, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window): each window of the slice's documents lies in one such range."""
    n = len(s.data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    p = s.byte_prefix()
    at = np.arange(n - GRAM + 1)
    least = (s.byte_hash(p, at, at + GRAM) & ~U64(0xFFFFFFFF)) | at.astype(U64)
    span = 1
    while span < reach:
        step = min(span, reach - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    begin = np.flatnonzero(np.repeat(s.offsets[1:], np.diff(s.offsets)) >= np.arange(n) + length)
    if not len(begin):
        return none, none, none
    chosen = (least[begin] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(begin), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (begin[1:] != begin[:-1] + 1)
    cut = np.flatnonzero(new)
    return chosen[cut], begin[cut], begin[np.r_[cut[1:], len(begin)] - 1]


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, of which start bytes are known."""
    end = min(len(a), len(b))
    step = 16
    while start < end:
        if a[start : start + step] != b[start : start + step]:
            if step == 1:
                break
            step = max(1, step // 4)
        else:
            start += step
            if step < 16:
                continue
            step *= 2
    return min(start, end)


def pack_run(suffixes: list[tuple[bytes, bytes]], places: list[list[tuple[int, int, int, int]]]) -> bytes:
    """A sorted run of distinct (suffix, left bytes), front-coded, with the places (doc, text tag, first window, last window) of each."""
    shared, rests, before = [], [], b""
    for right, _ in suffixes:
        n = common(before, right)
        shared.append(n)
        rests.append(right[n:])
        before = right
    heads = np.array([shared, [len(x) for x in rests], [len(x) for _, x in suffixes], [len(x) for x in places]], np.int64)
    at = np.array([x for each in places for x in each], np.int64).reshape(-1, 4).T
    body = heads.astype(np.int32).tobytes() + np.ascontiguousarray(at).tobytes() + b"".join(rests) + b"".join(x for _, x in suffixes)
    return len(suffixes).to_bytes(4, "little") + at.shape[1].to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def unpack_run(run: bytes) -> tuple[list[int], list[bytes], list[bytes], list[int], np.ndarray]:
    n, m = int.from_bytes(run[:4], "little"), int.from_bytes(run[4:8], "little")
    body = zstandard.ZstdDecompressor().decompress(run[8:])
    shared, rest, left, count = (x.tolist() for x in np.frombuffer(body, np.int32, 4 * n).reshape(4, n))
    places = np.frombuffer(body, np.int64, 4 * m, 16 * n).reshape(4, m)
    at = 16 * n + 32 * m
    rights, lefts, before = [], [], b""
    for k, size in zip(shared, rest, strict=True):
        before = before[:k] + body[at : at + size]
        rights.append(before)
        at += size
    for size in left:
        lefts.append(body[at : at + size])
        at += size
    return shared, rights, lefts, count, places


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, prefix shared with the suffix before) in sorted order, by a loser tree.

    A loser keeps the length of its common prefix with the suffix that beat it. When a run's next suffix comes up, its own
    front-coding says what it shares with the one just given out; of two suffixes the one that shares more of that one
    is smaller, and only with equal lengths are bytes compared, from that length on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * k
    # a leaf: its run's suffix and what it shares with the last one given out
    head: list[bytes | None] = [r[1][0] if r[1] else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k
    tree = [0] * k  # losers of the inner nodes 1 to k - 1

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known length becomes that with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common(x, y, known[a])
        if x[n : n + 1] <= y[n : n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    winners = list(range(k))
    node = k
    while node > 1:
        nexts = []
        for i in range(0, len(winners), 2):
            w, loser = play(winners[i], winners[i + 1])
            tree[(node + i) // 2] = loser
            nexts.append(w)
        winners, node = nexts, node // 2
    winner, shared = winners[0], 0
    while head[winner] is not None:
        yield winner, at[winner], shared
        lengths, suffixes = runs[winner]
        at[winner] += 1
        i = at[winner]
        head[winner], known[winner] = (suffixes[i], lengths[i]) if i < len(suffixes) else (None, 0)
        node = (winner + k) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2
        shared = known[winner]


Group = list[tuple[bytes, bytes, list[tuple[int, int, int, int]]]]


def shared_windows(group: Group, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(doc, text tag, first, last window) of the windows that occur twice or more; group: suffixes with their left bytes and places.

    Window d of a place is its `d` left bytes before the anchor and length - d bytes from it on.
    """
    if len(group) == 1:
        if len(group[0][2]) > 1:
            yield from group[0][2]
        return
    if len(group) <= 6:
        for i, (right, left, places) in enumerate(group):
            if len(places) > 1:
                yield from places
                continue
            for j, (other, before, _) in enumerate(group):
                if i != j:
                    most, least = common(left, before), length - common(right, other)
                    yield from _cut(places, left, least, most)
        return
    alone = [g for g in group if len(g[2]) == 1]
    for g in group:
        if len(g[2]) > 1:
            yield from g[2]
    if not alone:
        return
    wide = max(len(g[1]) for g in group)
    if not wide and min(len(g[0]) for g in group) == length:
        return  # dealt window by window: distinct suffixes are distinct windows
    tall = max(len(g[0]) for g in group)
    most = np.array([len(g[1]) for g in group])
    least = np.array([length - len(g[0]) for g in group])
    twice = np.array([len(g[2]) > 1 for g in group])
    sums = np.zeros((len(group), wide + tall + 1), U64)
    for i, (right, left, _) in enumerate(group):
        row = np.zeros(wide + tall, np.uint8)
        row[wide - len(left) : wide] = np.frombuffer(left, np.uint8)[::-1]
        row[wide : wide + len(right)] = np.frombuffer(right, np.uint8)
        np.cumsum(_VALUES[row] * _UP[: len(row)], out=sums[i, 1:])
    again = np.zeros((len(group), wide + 1), bool)
    for d in range(wide + 1):
        has = np.flatnonzero((d <= most) & (d >= least))
        if len(has) > 1:
            a = wide - d
            h = (sums[has, a + length] - sums[has, a]) * _DOWN[a]
            _, where, count = np.unique(h, return_inverse=True, return_counts=True)
            again[has, d] = count[where] > 1
    for i in np.flatnonzero(again.any(axis=1) & ~twice):
        edge = np.flatnonzero(np.diff(np.r_[False, again[i], False].astype(np.int8)))
        for d0, d1 in zip(edge[::2], edge[1::2], strict=True):
            yield from _cut(group[i][2], group[i][1], int(d0), int(d1) - 1)


def _cut(places, left: bytes, least: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    for doc, tag, first, last in places:
        a, b = max(first, first + len(left) - most), min(last, first + len(left) - least)
        if a <= b:
            yield doc, tag, a, b


_RNG = np.random.default_rng(5)
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_UP = np.multiply.accumulate(np.r_[U64(1), np.full(2047, 0x9E3779B97F4A7C15, U64)])
_DOWN = np.multiply.accumulate(np.r_[U64(1), np.full(2047, pow(0x9E3779B97F4A7C15, -1, 1 << 64), U64)])


def _suffixes(s: Slice, length: int, reach: int, found: Callable, hot: Callable) -> Iterator[tuple[bytes, bytes, int, int, int]]:
    """(suffix, left bytes reversed, row of the slice, first window, last window) of the candidates."""
    near = length - reach + 1
    anchor, first, last = anchors(s, length, reach)
    h = s.byte_hash(s.byte_prefix(), anchor, anchor + near)
    keep = found(h)
    anchor, first, last, h = anchor[keep], first[keep], last[keep], h[keep]
    row = s.doc_of(anchor)
    base = s.offsets[row]
    data = s.data.tobytes()
    for a, f, z, r, o, many in zip(anchor.tolist(), first.tolist(), last.tolist(), row.tolist(), base.tolist(), hot(h).tolist(), strict=True):
        if many:
            for w in range(f, z + 1):
                yield data[w : w + length], b"", r, w - o, w - o
        else:
            yield data[a : z + length], data[f:a][::-1], r, f - o, z - o


def suffix_dedup(docs: DataFrame, length: int = 200, reach: int = 96, whole_characters: bool = False, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts anywhere else in the corpus.

    docs: doc_id long, text string; other columns are ignored but for those named in keep, which come back after the others.
    whole_characters: characters that lose a byte are removed, so that what is kept is UTF-8. reach (at most length - GRAM): how far into a window its anchor may
    lie. Returns doc_id, n_bytes long, n_removed long, n_spans long (maximal removed runs), kept binary (the remaining bytes).
    A null text counts as empty; texts shorter than length lose nothing. Texts are whole; strings never cross documents. Rows
    that repeat a doc_id and its text count as one document and get the same result; so do rows without a doc_id that have equal texts. Rows
    that repeat a doc_id with another text are documents of their own. In groups of more than six suffixes windows are compared by 64-bit sums.
    """
    doc_id, rest = F.col("doc_id").cast("long"), F.struct(F.lit(0).alias("none"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)))
    docs = docs.select(doc_key().alias("key"), text_tag().alias("tag"), doc_id.alias("doc_id"), "text", rest.alias("rest"))
    sc = docs.sparkSession.sparkContext
    total = text_bytes(docs)
    near = length - reach + 1

    def near_hashes(s: Slice) -> tuple[np.ndarray, None]:
        a, _, _ = anchors(s, length, reach)
        return s.byte_hash(s.byte_prefix(), a, a + near), None

    filter_ = sc.broadcast(repeat_filter(docs.select("text"), near_hashes, total, hot_from=HOT_RUNS))

    # range borders only balance the exchange; they come from the anchors of a bounded sample
    pieces = docs.select("key", F.substring("text", 1, 20_000).alias("text"))
    sample = hashed_sample(pieces, "key", docs.count(), SAMPLE_DOCS).toArrow()["text"].combine_chunks()
    heads = sorted(s.data[a : a + near].tobytes() for s in slices(sample) for a in anchors(s, length, reach)[0].tolist())
    ranges = 1 << bucket_bits(total)
    borders = sc.broadcast(sorted({heads[i * len(heads) // ranges][:24] for i in range(1, ranges)}) if heads else [])

    def runs(batches) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], list[tuple[int, int, int, int]]] = {}
        for batch in batches:
            keys = list(zip(batch.column("key").to_pylist(), batch.column("tag").to_pylist(), strict=True))
            for s in slices(batch.column("text")):
                for right, left, row, f, z in _suffixes(s, length, reach, filter_.value.holds, filter_.value.is_hot):
                    held.setdefault((right, left), []).append((*keys[s.first + row], f, z))
                if len(held) >= FLUSH:
                    yield from send(held)
                    held = {}
        if held:
            yield from send(held)

    def send(held) -> Iterator[pa.RecordBatch]:
        # one document's place counts once, also where rows repeat it
        order = sorted(held)
        cuts = [0, *(bisect.bisect_left(order, (b, b"")) for b in borders.value), len(order)]
        rows = []
        for bucket, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b:
                rows.append((bucket, pack_run(order[a:b], [sorted(set(held[x])) for x in order[a:b]])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_RUN)

    def merged(table: pa.Table) -> pa.Table:
        parts = [unpack_run(x.as_py()) for x in table["run"]]
        starts = [np.r_[0, np.cumsum(p[3])] for p in parts]
        found = []

        def close(group: dict) -> None:
            found.extend(shared_windows([(r, x, sorted(set(p))) for (r, x), p in group.items()], length))

        group: dict[tuple[bytes, bytes], list] = {}
        for run, i, shared in merge_runs([(p[0], p[1]) for p in parts]):
            if shared < near and group:
                if len(group) > 1 or len(next(iter(group.values()))) > 1:
                    close(group)
                group = {}
            _, rights, lefts, _, places = parts[run]
            a, b = starts[run][i], starts[run][i + 1]
            group.setdefault((rights[i], lefts[i]), []).extend(zip(*places[:, a:b].tolist(), strict=True))
        if group:
            close(group)
        columns = np.array(found, np.int64).reshape(-1, 4).T
        return pa.table([pa.array(c) for c in columns], names=["key", "tag", "first", "last"])

    windows = docs.select("key", "tag", "text").mapInArrow(runs, "bucket int, run binary").groupBy("bucket").applyInArrow(merged, "key long, tag long, first long, last long")
    windows = windows.groupBy(F.col("key").alias("at_key"), F.col("tag").alias("at_tag")).agg(F.collect_list(F.struct("first", "last")).alias("windows"))

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def remove(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, rest = batch.column("doc_id").to_pylist(), batch.column("windows"), batch.column("rest")
            for s in slices(batch.column("text")):
                rows = []
                for i in range(s.rows):
                    text = s.data[s.offsets[i] : s.offsets[i + 1]]
                    found = lists[s.first + i]
                    if not found.is_valid:
                        rows.append((ids[s.first + i], len(text), 0, 0, text.tobytes()))
                        continue
                    change = np.zeros(len(text) + 1, np.int32)
                    first, end = found.values.field("first").to_numpy(), found.values.field("last").to_numpy() + length
                    np.add.at(change, first, 1)
                    np.add.at(change, end, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    if whole_characters:
                        character = np.cumsum((text & 0xC0) != 0x80)
                        gone = (np.bincount(character, gone) > 0)[character]
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    rows.append((ids[s.first + i], len(text), int(gone.sum()), spans, text[~gone].tobytes()))
                yield batch_of(rows, result).append_column("rest", rest.slice(s.first, s.rows))

    joined = docs.join(windows, (docs["key"] == windows["at_key"]) & (docs["tag"] == windows["at_tag"]), "left").drop("key", "at_key", "tag", "at_tag")
    done = joined.mapInArrow(remove, f"{result}, rest {docs.schema['rest'].dataType.simpleString()}")
    return done.select(*(x.split()[0] for x in result.split(", ")), *(F.col(f"rest.c{i}").alias(c) for i, c in enumerate(keep)))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
