"""Byte-level BPE of whole texts with reuse of content-defined chunks.

A rolling hash cuts texts into chunks, so that passages shared between documents fall into equal chunks. Chunks
that occur more than once are encoded once, in one task each; the rest is encoded where it lies. A chunk's own tokens are
exact between its first and last certain pre-token borders (a space after a printable ASCII character always begins a pre-token,
whatever surrounds it). What lies between the last such border of one chunk and the first of a later one is
encoded again as one piece, over as many chunks as needed, so that the joined tokens agree with those of the whole text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.repeats import repeat_filter
from evgraph.llm.shared import batch_of, store, text_bytes
from evgraph.llm.text import U64, Slice, slices

# fixed value: how byte-level pre-tokenisation splits text
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROLL, MEAN, LEAST = 16, 1024, 64


class Bpe:
    """The tokenizer of a vocabulary file: plain text to ids, ids to bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # printable bytes stand for themselves, the others for code points from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        odd = [b for b in range(256) if b not in set(plain)]
        as_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}
        vocab = {bytes(as_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.table = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in vocab.items():
            self.table[i] = token
        for token, i in self.specials.items():
            self.table[i] = token.encode()
        self.kind = np.uint16 if len(self.table) <= 1 << 16 else np.uint32
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        self._marks = [t.encode() for t in self.specials]
        self._code = tiktoken.Encoding("bpe", pat_str=PRE_TOKENS, mergeable_ranks=vocab, special_tokens=self.specials)

    def plain(self, text: bytes) -> np.ndarray:
        """Ids of a text without special tokens."""
        return self._code.encode_to_numpy(text.decode("utf-8", "replace"), disallowed_special=()).astype(self.kind) if text else np.zeros(0, self.kind)

    def has_special(self, text: bytes) -> bool:
        return any(m in text for m in self._marks)

    def full(self, text: bytes) -> np.ndarray:
        """Ids of a text in which special tokens count."""
        if not self.has_special(text):
            return self.plain(text)
        return self._code.encode_to_numpy(text.decode("utf-8", "replace"), allowed_special="all").astype(self.kind)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def chunk_edges(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the chunks of a slice; cuts lie between code points."""
    d, n = s.data, len(s.data)
    cuts = np.zeros(0, np.int64)
    if n > ROLL:
        padded = np.concatenate([d, np.zeros(8, np.uint8)])
        low = np.lib.stride_tricks.as_strided(padded, (n - ROLL + 1, 8), (1, 1)).copy().view(U64).ravel()
        high = np.lib.stride_tricks.as_strided(padded[8:], (n - ROLL + 1, 8), (1, 1)).copy().view(U64).ravel()
        roll = (low * U64(0x9E3779B97F4A7C15) ^ high) * U64(0xD6E8FEB86659FD93)
        cuts = np.flatnonzero((roll >> U64(40)) % U64(MEAN) == 0) + ROLL
        # only what lies in a document decides on its chunks, whatever its neighbours in the slice are
        doc = s.doc_of(cuts - 1)
        inside = cuts - ROLL >= s.offsets[doc]
        cuts, doc = cuts[inside], doc[inside]
        far = np.ones(len(cuts), bool)
        far[1:] = (np.diff(cuts) >= LEAST) | (doc[1:] != doc[:-1])
        cuts, doc = cuts[far], doc[far]
        for _ in range(3):
            cuts = cuts + ((cuts < n) & ((d[np.minimum(cuts, n - 1)] & 0xC0) == 0x80))
        cuts = cuts[cuts < s.offsets[doc + 1]]
    starts = np.unique(np.concatenate([cuts, s.offsets[:-1][np.diff(s.offsets) > 0]]))
    ends = np.r_[starts[1:], n] if len(starts) else starts
    return starts, ends, s.doc_of(starts)


def _borders(text: bytes) -> tuple[int, int]:
    """First and last certain pre-token border inside a chunk, or (-1, -1)."""
    d = np.frombuffer(text, np.uint8)
    at = np.flatnonzero((d[1:] == 32) & (d[:-1] > 32) & (d[:-1] < 127)) + 1
    return (int(at[0]), int(at[-1])) if len(at) else (-1, -1)


def core(code: Bpe, text: bytes) -> tuple[int, int, np.ndarray]:
    """The first and last certain borders of a chunk and the ids between them."""
    a, b = _borders(text)
    if a < 0 or a == b:
        return a, b, np.zeros(0, code.kind)
    ids = code.plain(text)
    at = np.cumsum(code.lengths[ids])
    i, j = np.searchsorted(at, (a, b))
    return a, b, ids[i + 1 : j + 1]


def join_chunks(code: Bpe, texts: list[bytes], cores: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Ids of the joined chunks: their cores, and the pieces between them encoded anew."""
    out, piece = [], []
    for text, (a, b, ids) in zip(texts, cores, strict=True):
        if a < 0:  # no border: the piece goes on into the next chunk
            piece.append(text)
            continue
        piece.append(text[:a])
        out += [code.plain(b"".join(piece)), ids]
        piece = [text[b:]]
    out.append(code.plain(b"".join(piece)))
    return np.concatenate(out)


def code_marks(path: str, text: bytes) -> bool:
    """True if the text holds a special token; such texts are encoded whole."""
    return bpe(path).has_special(text)


def text_key(text: bytes) -> str:
    return hashlib.blake2b(text, digest_size=16).hexdigest()


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """Token ids of every whole text, as the vocabulary file's tokenizer gives them, special tokens included.

    docs: doc_id long, text string; other columns are ignored. path: a byte-level BPE file in tokenizers' JSON form, readable on
    every machine. Returns doc_id, ids binary (little-endian, 2 bytes each if the vocabulary allows, else 4), n_tokens long,
    ids_sha256 string (of ids as unsigned 32-bit), decoded_sha256 string (of the text that the ids decode to). A null text counts as
    empty: no tokens. Repeated rows get equal results; null doc_ids stay null.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sc = docs.sparkSession.sparkContext

    def chunk_hashes(s: Slice) -> tuple[np.ndarray, None]:
        a, b, _ = chunk_edges(s)
        return s.byte_hash(s.byte_prefix(), a, b), None

    shared = sc.broadcast(repeat_filter(docs, chunk_hashes, text_bytes(docs)))

    def shared_chunks(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                a, b, _ = chunk_edges(s)
                h = s.byte_hash(s.byte_prefix(), a, b)
                _, one = np.unique(h, return_index=True)
                one = one[shared.value.holds(h[one])]
                if len(one):
                    a, b, h = a[one], b[one], h[one]
                    g = s.byte_hash(s.byte_prefix(1), a, b, 1)
                    texts = [s.data[x:y].tobytes() for x, y in zip(a, b, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(texts, pa.binary())], names=["h1", "h2", "chunk"])

    def encode_once(batches) -> Iterator[pa.RecordBatch]:
        code = bpe(path)
        for batch in batches:
            done = [core(code, x.as_py()) for x in batch.column("chunk")]
            cores = pa.array([np.array(c[:2], np.int64).tobytes() + c[2].tobytes() for c in done], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), cores], names=["h1", "h2", "core"])

    lexicon = (
        docs.mapInArrow(shared_chunks, "h1 long, h2 long, chunk binary")
        .groupBy("h1", "h2")
        .agg(F.min("chunk").alias("chunk"))
        .mapInArrow(encode_once, "h1 long, h2 long, core binary")
    )

    encoded = "ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def finished(code: Bpe, name, ids: np.ndarray) -> tuple:
        digest = hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()
        return name, ids.tobytes(), len(ids), digest, hashlib.sha256(code.decode(ids).encode()).hexdigest()

    def holes_of(s: Slice) -> tuple:
        """Chunks of a slice, their hashes, and for each document whether it waits for a shared chunk."""
        a, b, doc = chunk_edges(s)
        h = s.byte_hash(s.byte_prefix(), a, b)
        hole = shared.value.holds(h)
        waits = np.zeros(s.rows, bool)
        waits[doc[hole]] = True
        for i in np.flatnonzero(waits):
            waits[i] = not code_marks(path, s.text(i))
        return a, b, doc, h, hole & waits[doc], waits

    def in_place(batches) -> Iterator[pa.RecordBatch]:
        """The ids of documents that share no chunk."""
        code = bpe(path)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for s in slices(batch.column("text")):
                waits = holes_of(s)[-1]
                yield batch_of([finished(code, ids[s.first + i], code.full(s.text(i))) for i in np.flatnonzero(~waits)], f"doc_id long, {encoded}")

    def waiting(batches) -> Iterator[pa.RecordBatch]:
        """The other documents with the key of their text, and the text itself once in a slice."""
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for s in slices(batch.column("text")):
                rows, seen = [], set()
                for i in np.flatnonzero(holes_of(s)[-1]):
                    text = s.text(i)
                    key = text_key(text)
                    rows.append((ids[s.first + i], key, None if key in seen else text.decode("utf-8", "replace")))
                    seen.add(key)
                yield batch_of(rows, "doc_id long, key string, text string")

    def asked(batches) -> Iterator[pa.RecordBatch]:
        """The shared chunks of each waiting text, with their places."""
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for s in slices(batch.column("text")):
                a, b, doc, h, hole, _ = holes_of(s)
                at = np.flatnonzero(hole)
                g = s.byte_hash(s.byte_prefix(1), a[at], b[at], 1)
                places = at - np.searchsorted(doc, doc[at])
                columns = [pa.array([keys[s.first + i] for i in doc[at]], pa.string()), pa.array(places.astype(np.int32)), pa.array(h[at].view(np.int64)), pa.array(g.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "h1", "h2"])

    def joined(batches) -> Iterator[pa.RecordBatch]:
        code = bpe(path)
        for batch in batches:
            keys, parts = batch.column("key").to_pylist(), batch.column("parts")
            for s in slices(batch.column("text")):
                a, b, doc = chunk_edges(s)
                cut = np.searchsorted(doc, np.arange(s.rows + 1))
                rows = []
                for i in range(s.rows):
                    known = {p["at"]: p["core"] for p in parts[s.first + i].as_py() or ()}
                    chunks = [s.data[x:y].tobytes() for x, y in zip(a[cut[i] : cut[i + 1]], b[cut[i] : cut[i + 1]], strict=True)]
                    cores = []
                    for k, chunk in enumerate(chunks):
                        if (got := known.get(k)) is None:
                            cores.append(core(code, chunk))
                        else:
                            x, y = np.frombuffer(got, np.int64, 2)
                            cores.append((int(x), int(y), np.frombuffer(got, code.kind, offset=16)))
                    rows.append(finished(code, keys[s.first + i], join_chunks(code, chunks, cores)))
                yield batch_of(rows, f"key string, {encoded}")

    waits = store(docs.mapInArrow(waiting, "doc_id long, key string, text string"), "waiting")
    texts = waits.filter("text is not null").select("key", "text")
    holes = texts.mapInArrow(asked, "key string, at int, h1 long, h2 long").dropDuplicates(["key", "at"])
    parts = holes.join(lexicon, ["h1", "h2"]).groupBy("key").agg(F.collect_list(F.struct("at", "core")).alias("parts"))
    texts = texts.groupBy("key").agg(F.min("text").alias("text"))
    # copies of a text are encoded once, and only their keys meet the result
    done = texts.join(parts, "key", "left").mapInArrow(joined, f"key string, {encoded}")
    later = waits.select("doc_id", "key").join(done, "key").drop("key")
    return docs.mapInArrow(in_place, f"doc_id long, {encoded}").unionByName(later)


def op9_bpe_chunks(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
