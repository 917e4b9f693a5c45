"""Alignment of two tokenizers' tokens by the byte offsets at which both end one.

The tokens' ends are two ascending lists for each text. The shorter list drives: each of its ends is looked for in the longer one from
where the one before was found, in steps that double and then halve (galloping). Ends found in both cut the tokens into groups;
differences of their ranks are the groups' sizes. Many texts gallop in lockstep, in lanes of an array.

Two tokens that end together are suffixes of one another, so the pairs of ids that can be linked are at most the vocabularies' pairs of
suffixes (324,302 for the two public files, whatever the corpus): their counts are a table of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.bpe_chunks import Bpe, bpe
from evgraph.llm.shared import store
from evgraph.llm.text import slices

LANE = 64  # ends that one lane looks up, each from where it found the one before
TOKEN_BYTES = 1 << 18  # of ids that a step of the digest holds


class Pieces:
    """A sentencepiece model: texts to ids, ids to bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        known = range(self._model.get_piece_size())
        self.table = [bytes([int(self._model.id_to_piece(i)[1:-1], 16)]) if self._model.is_byte(i) else self._model.id_to_piece(i).replace("▁", " ").encode() for i in known]
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        self.kind = np.uint16 if len(self.table) <= 1 << 16 else np.uint32

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1) if texts else []


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def gallop(values: np.ndarray, target: np.ndarray, low: np.ndarray, top: np.ndarray) -> np.ndarray:
    """For each value the first place from low on, before top, whose target isn't less; top if there is none. target ascends between low and top."""
    low, high, step = low.copy(), top.copy(), np.ones(len(low), np.int64)
    seek = np.flatnonzero(low < top)
    while len(seek):
        probe = low[seek] + step[seek] - 1
        less = probe < top[seek]
        less[less] = target[probe[less]] < values[seek[less]]
        found, further = seek[~less], seek[less]
        high[found] = np.minimum(probe[~less], top[found])
        low[further] = probe[less] + 1
        step[further] *= 2
        seek = further
    seek = np.flatnonzero(low < high)
    while len(seek):
        middle = (low[seek] + high[seek]) >> 1
        less = target[middle] < values[seek]
        low[seek[less]] = middle[less] + 1
        high[seek[~less]] = middle[~less]
        seek = seek[low[seek] < high[seek]]
    return low


def _driven(driver: np.ndarray, target: np.ndarray, driver_cut: np.ndarray, target_cut: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in driver and target of the ends that both have, of the given documents."""
    lanes = -(-(driver_cut[docs + 1] - driver_cut[docs]) // LANE)
    doc = np.repeat(docs, lanes)
    first = driver_cut[doc] + LANE * (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    until, at, top = np.minimum(first + LANE, driver_cut[doc + 1]), target_cut[doc], target_cut[doc + 1]
    mine, theirs = [], []
    for turn in range(LANE):
        live = np.flatnonzero(first + turn < until)
        if not len(live):
            break
        place = first[live] + turn
        at[live] = gallop(driver[place], target, at[live], top[live])
        hit = at[live] < top[live]
        hit[hit] = target[at[live][hit]] == driver[place[hit]]
        mine.append(place[hit])
        theirs.append(at[live][hit])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *mine]), np.concatenate([none, *theirs])


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ends_a and ends_b of equal ends, in order. Document d has the ends cut[d] to cut[d + 1]; ends ascend within a document."""
    a_drives = np.diff(cut_a) <= np.diff(cut_b)
    a1, b1 = _driven(ends_a, ends_b, cut_a, cut_b, np.flatnonzero(a_drives))
    b2, a2 = _driven(ends_b, ends_a, cut_b, cut_a, np.flatnonzero(~a_drives))
    a, b = np.concatenate([a1, a2]), np.concatenate([b1, b2])
    order = np.argsort(a)
    return a[order], b[order]


def overlap_ranges(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of one text's A the first B token that shares a byte with it, and the one after the last: differences of ranks of its ends."""
    n, whole = len(ends_a), np.zeros(len(ends_a), np.int64)
    starts = np.r_[0, ends_a[:-1]] if n else ends_a
    first = gallop(starts + 1, ends_b, whole, whole + len(ends_b))
    return first, np.minimum(gallop(ends_a, ends_b, first, whole + len(ends_b)) + 1, len(ends_b))


def _aligned(code: Bpe, other: Pieces, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Ids of A and B and the sizes of their groups, for each text."""
    none_a, none_b, none = np.zeros(0, code.kind), np.zeros(0, other.kind), np.zeros(0, np.uint32)
    full = [i for i, t in enumerate(texts) if t]
    out = [[none_a] * len(texts), [none_b] * len(texts), [none] * len(texts), [none] * len(texts)]
    both = []
    for i, ids in zip(full, other.ids([texts[i].decode("utf-8", "replace") for i in full]), strict=True):
        want, b = b" " + texts[i], np.array(ids, other.kind)
        if b"".join(map(other.table.__getitem__, ids)) != want:
            continue
        a = code.plain(want)
        if b"".join(map(code.table.__getitem__, a.tolist())) == want:
            both.append((i, a, b))
    if not both:
        return tuple(out)
    a, b = np.concatenate([x[1] for x in both]), np.concatenate([x[2] for x in both])
    cut_a, cut_b = (np.cumsum([0, *(len(x[k]) for x in both)]) for k in (1, 2))
    # both lists end a document at the same byte, so the ends of all documents ascend as one
    at_a, at_b = common_ends(np.cumsum(code.lengths[a]), np.cumsum(other.lengths[b]), cut_a, cut_b)
    size_a, size_b = np.diff(at_a, prepend=-1).astype(np.uint32), np.diff(at_b, prepend=-1).astype(np.uint32)
    groups = np.searchsorted(at_a, cut_a)
    for k, (i, ids_a, ids_b) in enumerate(both):
        x, y = groups[k], groups[k + 1]
        out[0][i], out[1][i], out[2][i], out[3][i] = ids_a, ids_b, size_a[x:y], size_b[x:y]
    return tuple(out)


_PARTS = ("a_ids", "b_ids", "a_sizes", "b_sizes")
ALIGNED = "doc_id long, " + ", ".join(f"{c} binary" for c in _PARTS)


def align(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """Tokens of every whole text by two tokenizers, cut into groups where both end a token.

    docs: doc_id long, text string; other columns are ignored. byte_bpe (A): a byte-level BPE file in tokenizers' JSON form, which reads a space and the
    text; piece_bpe (B): a sentencepiece model that adds that space itself. Special tokens' strings are plain text.
    Returns doc_id, a_ids and b_ids binary (little-endian, 2 bytes each if the vocabulary allows, else 4), a_sizes and b_sizes binary (4 bytes each: the tokens
    of each group, in order). Null and empty texts, and those whose joined A or B bytes differ from the space and the text, have four
    empty values. Repeated rows get equal results; null doc_ids stay null; an empty table gives no rows.
    """

    def aligned(batches) -> Iterator[pa.RecordBatch]:
        code, other = bpe(byte_bpe), pieces(piece_bpe)
        for batch in batches:
            for s in slices(batch.column("text")):
                columns = _aligned(code, other, [s.text(i) for i in range(s.rows)])
                arrays = [batch.column("doc_id").slice(s.first, s.rows), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *_PARTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(aligned, ALIGNED)


class _Groups:
    """The aligned documents of some rows of a batch, as arrays."""

    def __init__(self, batch: pa.RecordBatch, first: int, rows: int, kinds: tuple):
        parts = [[np.frombuffer(x.as_buffer(), k) for x in batch.column(c).slice(first, rows)] for c, k in zip(_PARTS, (*kinds, np.uint32, np.uint32), strict=True)]
        self.counts = [np.array([len(x) for x in p], np.int64) for p in parts]
        self.a, self.b, self.size_a, self.size_b = (np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64) for p in parts)
        self.end_a, self.end_b = np.cumsum(self.size_a), np.cumsum(self.size_b)
        # groups of each document
        self.cut = np.r_[0, np.cumsum(self.counts[2])]

    def links(self, width: int) -> np.ndarray:
        """A number for the pair of ids that ends each group."""
        return self.a[self.end_a - 1] * width + self.b[self.end_b - 1]

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums of a value of each group, by document."""
        total = np.r_[0, np.cumsum(x, dtype=np.int64)]
        return total[self.cut[1:]] - total[self.cut[:-1]]


def _parts_of(batches, kinds: tuple) -> Iterator[tuple[pa.RecordBatch, int, _Groups]]:
    for batch in batches:
        for s in slices(batch.column("a_ids"), TOKEN_BYTES):
            yield batch, s.first, _Groups(batch, s.first, s.rows, kinds)


def pair_counts(aligned: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """(a_id, b_id, n long, best boolean): how many A-B pairs of tokens that end together have these ids, over the whole table.

    best: no other a_id has more with this b_id. Tasks count before the shuffle.
    """
    kinds, width = (bpe(byte_bpe).kind, pieces(piece_bpe).kind), len(pieces(piece_bpe).table)

    def counted(batches) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, _, g in _parts_of(batches, kinds):
            k, n = np.unique(g.links(width), return_counts=True)
            keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    pairs = aligned.select(*_PARTS).mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    named = pairs.select(F.expr(f"pair div {width}").alias("a_id"), (F.col("pair") % width).alias("b_id"), "n")
    most = named.groupBy("b_id").agg(F.max("n").alias("most"))
    return named.join(most, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def link_digests(aligned: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """Per document of align()'s rows: doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum (long), groups_sha256 string.

    A link is a pair of an A and a B token that end together; tokens aren't empty, so that a group has one. n_overlaps: pairs that share a byte (a group of x and y
    tokens has x + y - 1). n_best, count_sum: see pair_counts. groups_sha256: of `a1,a2|b1;a3|b2,b3`, or '' without tokens.
    """
    code, other = bpe(byte_bpe), pieces(piece_bpe)
    kinds, width = (code.kind, other.kind), len(other.table)
    counts = pair_counts(aligned, byte_bpe, piece_bpe).select((F.col("a_id") * width + F.col("b_id")).alias("pair"), "n", "best").toArrow().sort_by("pair")
    known = aligned.sparkSession.sparkContext.broadcast(tuple(counts[c].to_numpy() for c in ("pair", "n", "best")))
    n_a = len(code.table)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum"]

    def digested(batches) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        words = [f"{i}{sep}" for i in range(n_a) for sep in ",|"] + [f"{i}{sep}" for i in range(width) for sep in (",", ";", "")]
        for batch, first, g in _parts_of(batches, kinds):
            at = np.searchsorted(pair, g.links(width))
            # within a group A's tokens come before B's; the last of each is followed by another sign
            group_a, group_b = np.repeat(np.arange(len(g.size_a)), g.size_a), np.repeat(np.arange(len(g.size_b)), g.size_b)
            text = np.empty(len(g.a) + len(g.b), np.int64)
            last_a, last_b = np.zeros(len(g.a), np.int64), np.zeros(len(g.b), np.int64)
            last_a[g.end_a - 1] = 1
            last_b[g.end_b - 1] = 1
            ends = g.cut[1:][g.counts[2] > 0] - 1
            last_b[g.end_b[ends] - 1] = 2
            text[np.arange(len(g.a)) + (g.end_b - g.size_b)[group_a]] = 2 * g.a + last_a
            text[np.arange(len(g.b)) + g.end_a[group_b]] = 2 * n_a + 3 * g.b + last_b
            cut = np.r_[0, np.cumsum(g.counts[0] + g.counts[1])]
            digests = [hashlib.sha256("".join(map(words.__getitem__, text[x:y].tolist())).encode()).hexdigest() if y > x else "" for x, y in zip(cut[:-1], cut[1:], strict=True)]
            longs = [g.counts[0], g.counts[1], g.counts[2], g.counts[2], g.counts[0] + g.counts[1] - g.counts[2], g.sums(best[at]), g.sums(n[at])]
            arrays = [batch.column("doc_id").slice(first, len(digests)), *(pa.array(x, pa.int64()) for x in longs), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns, "groups_sha256"])

    return aligned.mapInArrow(digested, f"doc_id long, {', '.join(f'{c} long' for c in columns)}, groups_sha256 string")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    # both tokenizers run once; the counts and the digests read what they left
    aligned = store(align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *paths), "aligned-tokens")
    return link_digests(aligned, *paths)
