"""Periodic runs of words by a dictionary of basic factors.

The dictionary names all factors of 1, 2, 4, 8 ... words: a factor of twice the length is named by the names of its halves. At length f a factor
that comes again after q words and once more after 2 q, with 2 q <= 2 f, makes an arithmetic progression, and q is the smallest period of what
it covers. Each q is proposed at the one length f with f / 2 < q <= f. Starts side by side with one q belong to one run: from the first start to
the last one's end. Since f < 2 q, a run of 4 q words or more has such starts, and the run that they span can't be extended.

Factors that don't come again in their document have no part in longer ones that do, so they leave the dictionary, which shrinks quickly on prose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.shared import firsts
from evgraph.llm.text import join_words, slices, word_hashes

RUN = "struct<start:long,length:long,period:long>"


def runs(words: np.ndarray, docs: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (word numbers), lengths and periods of all maximal runs, by start, then period. words: a value of each word; docs: its document, ascending."""
    n, f = len(words), 1
    at = np.arange(n)
    name = (docs << 32) | np.unique(words, return_inverse=True)[1]
    found = [(at[:0], at[:0], at[:0])]
    while len(at):
        order = np.argsort(name, kind="stable")  # places ascend within a name
        new = firsts(name[order])
        rank = np.cumsum(new) - 1
        again = np.flatnonzero(~new)
        step, follower = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        step[order[again - 1]] = at[order[again]] - at[order[again - 1]]
        follower[order[again - 1]] = order[again]
        ap = np.flatnonzero((2 * step > f) & (step <= f) & (step[follower] == step))
        if len(ap):
            place, q = at[ap], step[ap]
            cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1] + 1) | (q[1:] != q[:-1])])
            end = np.r_[cut[1:], len(ap)] - 1
            first, q = place[cut], q[cut]
            length = place[end] - first + 2 * q + f
            keep = length >= np.maximum(least, times * q)
            found.append((first[keep], length[keep], q[keep]))
        # names of the next length, for factors whose halves both come again
        shared = np.bincount(rank)[rank] > 1
        known = np.full(n, -1, np.int64)
        known[at[order[shared]]] = rank[shared]
        at = np.sort(at[order[shared]])
        at = at[at + f < n]
        at = at[(known[at + f] >= 0) & (docs[at + f] == docs[at])]
        name = known[at] * n + known[at + f]
        f *= 2
    start, length, q = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """Maximal runs of words with a period, and each text without the repeats.

    docs: doc_id long, text string; other columns are ignored. A run is a stretch of words with smallest period q and max(least, times * q) words or more that
    no neighbouring word extends; times is 4 at least. Words are runs of bytes other than 0x20 and 0x09-0x0D, compared by 64-bit hashes.
    Returns doc_id, n_words long, runs array<struct<start, length, period>> (start: number of the run's first word in the text, from 0; by start, then period) and text
    string: the words that no run holds after its first q, joined by one space. Null texts and those without words have no runs and an empty text. Each row is judged
    alone: repeated rows get equal results, null doc_ids stay null, an empty table gives no rows.
    """
    if times < 4:
        raise ValueError("times must be 4 or more")

    def found(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                starts, ends, doc = s.words()
                first, length, q = runs(word_hashes(s, starts, ends), doc, least, times)
                change = np.zeros(len(doc) + 1, np.int64)
                np.add.at(change, first + q, 1)
                np.add.at(change, first + length, -1)
                keep = np.cumsum(change[:-1]) == 0
                kept, _, offsets = join_words(s, starts[keep], ends[keep], doc[keep])
                cut = np.searchsorted(doc, np.arange(s.rows + 1))
                run_doc = doc[first]
                table = pa.StructArray.from_arrays([pa.array(first - cut[run_doc]), pa.array(length), pa.array(q)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(run_doc, np.arange(s.rows + 1)).astype(np.int32)), table)
                texts = pa.StringArray.from_buffers(s.rows, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(kept))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, s.rows), pa.array(np.diff(cut)), lists, texts], names=["doc_id", "n_words", "runs", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, f"doc_id long, n_words long, runs array<{RUN}>, text string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of every document whose crc32(doc_id) divides by 10 repeat from some word on, as the query's contract has it."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    number = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long")), lambda i: F.get("words", number(i).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("most"), r["start"].alias("start"), r["period"].alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.select("doc_id", "text", F.size("runs").cast("long").alias("n_runs"), F.array_min(ranked).alias("top"), F.array_join(lines, "").alias("lines"))
    length = -F.col("top.most")
    return found.select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * length / F.col("top.period")).cast("long").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
