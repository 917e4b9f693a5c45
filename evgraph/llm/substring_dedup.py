"""Exact substring deduplication on words by fixed-block anchors.

The corpus is indexed by its non-overlapping blocks of ``window // 2`` words; every rolling
window of that length probes the index. Any run of ``window`` words that occurred before holds
one whole block of its earlier copy, so a probe hits inside it. Hits are extended to both sides to
windows of ``window`` words, compared by 96 bits of hashes, and windows that overlap join to maximal
exact repeats. The first occurrence of a window (smallest doc_id, then position) stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.repeats import repeat_filter
from evgraph.llm.shared import batch_of, bucket_bits, deal, doc_key, firsts, gather, text_bytes, text_tag
from evgraph.llm.text import U64, Slice, full_windows, slices, window_hashes, word_hashes

FLUSH = 1 << 19
_DEALT = pa.schema([("bucket", pa.int32()), ("h1", pa.binary()), ("h2", pa.binary()), ("doc", pa.binary()), ("tag", pa.binary()), ("at", pa.binary())])


class _Words:
    """The words of a slice, with what probing needs."""

    def __init__(self, s: Slice):
        self.s = s
        self.starts, self.ends, self.docs = s.words()
        self.first = np.searchsorted(self.docs, np.arange(s.rows + 1))
        self.hash = word_hashes(s, self.starts, self.ends)

    def probes(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        at = full_windows(self.docs, block)
        return at, window_hashes(self.hash, at, block)

    def candidates(self, window: int, found) -> np.ndarray:
        """Word numbers where a window begins that has a hit at one of the offsets where the block of an earlier copy can lie."""
        block = window // 2
        at, h = self.probes(block)
        hit = np.zeros(len(self.hash) + block + 1, np.int32)
        hit[at] = found(h)
        sums = np.concatenate([[0], np.cumsum(hit)])
        begin = full_windows(self.docs, window)
        return begin[sums[begin + block] > sums[begin]]

    def windows(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        second = word_hashes(self.s, self.starts, self.ends, 1)
        return window_hashes(self.hash, at, window, 0), (window_hashes(second, at, window, 1) >> U64(32)).astype(np.uint32)


def _earliest(h1, h2, doc, tag, at):
    """The first place of each window: smallest doc, then text tag, then word."""
    order = np.lexsort((at, tag, doc, h2, h1))
    columns = [c[order] for c in (h1, h2, doc, tag, at)]
    keep = firsts(*columns[:2])
    return tuple(c[keep] for c in columns)


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """Remove every word that lies in a window of `window` words whose sequence also starts earlier.

    docs: doc_id long, text string; other columns are ignored. Returns doc_id, n_words long,
    n_removed long, n_spans long (maximal removed runs), text string (kept words joined by one space).
    Null text: no words. Texts of fewer words than the window lose nothing. Rows that repeat a doc_id and its text count as one
    document and get the same result; so do rows without a doc_id that have equal texts, which order before all others. Rows that
    repeat a doc_id with another text are documents of their own, in order of a hash of the text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("key"), text_tag().alias("tag"), "text")
    sc = docs.sparkSession.sparkContext
    total = text_bytes(docs)
    block = window // 2

    def anchors(s: Slice):
        w = _Words(s)
        at, h = w.probes(block)
        return h, (at - w.first[w.docs[at]]) % block == 0

    index = sc.broadcast(repeat_filter(docs.select("text"), anchors, total, flagged=True))
    bucket = bucket_bits(total)

    def extended(batches):
        parts, n = [], 0
        for batch in batches:
            ids, tags = batch.column("key").to_numpy(), batch.column("tag").to_numpy().astype(np.uint32)
            for s in slices(batch.column("text")):
                w = _Words(s)
                at = w.candidates(window, index.value.holds)
                if not len(at):
                    continue
                h1, h2 = w.windows(at, window)
                owner = w.docs[at]
                parts.append(_earliest(h1, h2, ids[s.first + owner], tags[s.first + owner], (at - w.first[owner]).astype(np.int32)))
                n += len(parts[-1][0])
                if n >= FLUSH:
                    yield from send(parts)
                    parts, n = [], 0
        if n:
            yield from send(parts)

    def send(parts):
        h1, h2, doc, tag, at = _earliest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield from deal((h1 >> U64(64 - bucket)).astype(np.int32), [h1, h2, doc, tag, at], _DEALT)

    def first_places(table: pa.Table) -> pa.Table:
        _, _, doc, tag, at = _earliest(*(gather(table, c, kind) for c, kind in (("h1", U64), ("h2", np.uint32), ("doc", np.int64), ("tag", np.uint32), ("at", np.int32))))
        order = np.lexsort((at, tag, doc))
        doc, tag, at = doc[order], tag[order], at[order]
        cut = np.flatnonzero(firsts(doc, tag)) if len(doc) else np.zeros(0, np.int64)
        lists = [at[a:b].tobytes() for a, b in zip(cut, np.r_[cut[1:], len(doc)].astype(np.int64), strict=True)] if len(doc) else []
        return pa.table([pa.array(doc[cut]), pa.array(tag[cut].astype(np.int64)), pa.array(lists, pa.binary())], names=["first_doc", "first_tag", "at"])

    earliest = (
        docs.select("key", "tag", "text").mapInArrow(extended, "bucket int, h1 binary, h2 binary, doc binary, tag binary, at binary")
        .groupBy("bucket")
        .applyInArrow(first_places, "first_doc long, first_tag long, at binary")
    )
    earliest = earliest.groupBy("first_doc", "first_tag").agg(F.collect_list("at").alias("at"))

    result = "doc_id long, n_words long, n_removed long, n_spans long, text string, source string, key long, tag long"

    def triage(batches):
        """Documents without a candidate window are done; the others carry their text on."""
        for batch in batches:
            ids, keys, tags = (batch.column(c).to_pylist() for c in ("doc_id", "key", "tag"))
            for s in slices(batch.column("text")):
                w = _Words(s)
                waits = np.zeros(s.rows, bool)
                waits[w.docs[w.candidates(window, index.value.holds)]] = True
                rows = []
                for i in range(s.rows):
                    if waits[i]:
                        rows.append((ids[s.first + i], None, None, None, None, s.text(i).decode("utf-8", "replace"), keys[s.first + i], tags[s.first + i]))
                    else:
                        n = int(w.first[i + 1] - w.first[i])
                        rows.append((ids[s.first + i], n, 0, 0, _join(w, i, None), None, keys[s.first + i], tags[s.first + i]))
                yield batch_of(rows, result)

    def judge(batches):
        for batch in batches:
            done = batch.column("text").is_valid()
            if done.true_count:
                yield batch.filter(done).select(result_names)
            batch = batch.filter(pc.invert(done))
            if not batch.num_rows:
                continue
            ids, lists = batch.column("doc_id").to_pylist(), batch.column("at").to_pylist()
            for s in slices(batch.column("source")):
                w = _Words(s)
                begin = w.candidates(window, index.value.holds)
                keep = np.zeros(len(w.hash) + 1, bool)
                for i in range(s.rows):
                    for at in lists[s.first + i] or ():
                        keep[w.first[i] + np.frombuffer(at, np.int32)] = True
                again = begin[~keep[begin]]
                change = np.zeros(len(w.hash) + 1, np.int32)
                np.add.at(change, again, 1)
                np.add.at(change, again + window, -1)
                gone = np.cumsum(change)[:-1] > 0
                opens = gone & np.r_[True, (~gone[:-1]) | (w.docs[1:] != w.docs[:-1])] if len(gone) else gone
                rows = []
                for i in range(s.rows):
                    a, b = w.first[i], w.first[i + 1]
                    rows.append((ids[s.first + i], int(b - a), int(gone[a:b].sum()), int(opens[a:b].sum()), _join(w, i, gone), None, None, None))
                yield batch_of(rows, result)

    result_names = ["doc_id", "n_words", "n_removed", "n_spans", "text", "source", "key", "tag"]
    waiting = docs.mapInArrow(triage, result)
    joined = waiting.join(earliest, (F.col("key") == F.col("first_doc")) & (F.col("tag") == F.col("first_tag")), "left")
    return joined.drop("first_doc", "first_tag").mapInArrow(judge, result).drop("source", "key", "tag")


def _join(w: _Words, i: int, gone) -> str:
    a, b = int(w.first[i]), int(w.first[i + 1])
    text = w.s.text(i)
    words = text.split()  # bytes.split() has just the separators of the words: 0x20 and 0x09 to 0x0D
    if gone is not None:
        words = [x for x, g in zip(words, gone[a:b].tolist(), strict=True) if not g]
    return b" ".join(words).decode()


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
words AS (SELECT doc_id, p, ws[p] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
