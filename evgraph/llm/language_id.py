"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams (one to three code points, lower case) are hashed to 2**bits features. Document frequencies come from all
training documents. The weights are fitted on a bounded sample by follow-the-regularised-leader (FTRL-proximal) with L1 and L2
penalties, which keeps most of them at zero; a temperature, fitted on documents that the weights haven't seen, calibrates the probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.shared import hashed_sample

BITS = 15
LEARN = 3000  # documents that fit weights and temperature at most: the bound of what the driver holds
BLOCKS = 32  # parts in which the document frequencies are summed
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def counts(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and how often each occurs."""
    x = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    x = np.where((x == 32) | ((x >= 9) & (x <= 13)), 32, x).astype(np.uint32)
    x = np.concatenate([[np.uint32(32)], x, [np.uint32(32)]]).astype(np.uint32)
    shift = np.uint32(32 - bits)
    one = (x + np.uint32(1)) * np.uint32(2654435761)
    two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(31) + one[1:] * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(37) + one[2:] * np.uint32(0xC2B2AE35)
    grams = [(h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> shift for h in (one, two, three)]
    n = np.bincount(np.concatenate(grams).astype(np.int64), minlength=1 << bits)
    at = np.flatnonzero(n)
    return at, n[at]


class Model:
    """Weights over hashed features; classes are languages in order of name."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float, bits: int):
        self.languages, self.idf, self.weights, self.bias, self.temperature, self.bits = languages, idf, weights, bias, temperature, bits

    def logits(self, text: str | None) -> np.ndarray:
        at, v = vector(text, self.idf, self.bits)
        return (v @ self.weights[at] + self.bias).astype(np.float64)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not _LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def vector(text: str | None, idf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF with logarithmic counts, of length one."""
    at, n = counts(text, bits)
    v = (1 + np.log(n)) * idf[at]
    return at, (v / max(1e-12, float(np.sqrt(v @ v)))).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, size: int, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01):
    """Weights (size, classes) and bias by FTRL-proximal: per-coordinate rates, and weights whose sums stay under l1 are zero."""
    z, n = np.zeros((size + 1, classes), np.float32), np.zeros((size + 1, classes), np.float32)

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0, w)

    for _ in range(epochs):
        for at, v, y in rows:
            at, v = np.r_[at, size], np.r_[v, np.float32(1)]
            w = weights(at)
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    w = weights(np.arange(size + 1)).astype(np.float32)
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits under which the given answers are likeliest, by golden-section search of its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(y)), y])) + 1e-4 * t * t

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, over all rows, and the number of rows; tasks sum before they send."""
    part = (1 << bits) // BLOCKS

    def partial(batches) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                seen[counts(text.as_py(), bits)[0]] += 1
                rows += 1
        blocks = [seen[i * part : (i + 1) * part].tobytes() for i in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([rows] * BLOCKS, pa.int64()), pa.array(blocks, pa.binary())], names=["block", "n", "seen"])

    def total(table: pa.Table) -> pa.Table:
        seen = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table["seen"])
        return pa.table([[table["block"][0].as_py()], [sum(table["n"].to_pylist())], [seen.tobytes()]], schema=pa.schema([("block", pa.int32()), ("n", pa.int64()), ("seen", pa.binary())]))

    kind = "block int, n long, seen binary"
    rows = docs.select("text").mapInArrow(partial, kind).groupBy("block").applyInArrow(total, kind).collect()
    df = np.zeros(1 << bits, np.int64)
    for r in rows:
        df[r.block * part : (r.block + 1) * part] = np.frombuffer(r.seen, np.int64)
    return df, rows[0].n if rows else 0


def learn(docs: DataFrame, bits: int = BITS, most: int = LEARN) -> Model:
    """A model from the rows of docs (doc_id, text, lang) with a language that aren't held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    df, n = document_frequencies(known, bits)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    sample = hashed_sample(known.select("doc_id", "text", "lang"), "doc_id", n, most).toArrow().to_pylist()
    languages = sorted({r["lang"] for r in sample})
    rows = [(*vector(r["text"], idf, bits), languages.index(r["lang"])) for r in sample]
    rest = [r for i, r in enumerate(rows) if i % 4 == 3]
    weights, bias = ftrl([r for i, r in enumerate(rows) if i % 4 != 3], len(languages), 1 << bits)
    model = Model(languages, idf, weights, bias, 1.0, bits)
    logits = np.array([v @ weights[at] + bias for at, v, _ in rest], np.float64).reshape(-1, max(1, len(languages)))
    model.temperature = temperature(logits, np.array([y for _, _, y in rest], np.int64)) if rest else 1.0
    return model


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out boolean, lang_pred string and score double (calibrated probability of lang_pred) of every document.

    docs: doc_id, text, lang; other columns are ignored. Rows without lang or text, or held out (crc32(doc_id) mod 4 is 2), teach
    nothing, and a prediction sees the text alone. A text that is null or has no letters, and every text if nothing can be learned,
    gets `und` with score 0. Repeated rows get equal results.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def predicted(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(predicted, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
