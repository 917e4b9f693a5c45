"""Toxicity by compression distance: which of two zstandard dictionaries shortens a window more.

zstandard's trainer makes one dictionary from ordinary text and one from toxic text. What sets toxic text apart is a small part of it, so
its samples hold the words with border grams that are far more frequent in toxic documents than in ordinary ones; from all
of its text the trainer picks what all texts share. The toxic compressor has the ordinary dictionary too, behind its own, so that ordinary words cost the
same under both. A window's distance is the ordinary length minus the toxic length. A document's largest distances, with its number of
windows, give a probability by logistic calibration on labelled documents that the dictionaries haven't seen.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.shared import hashed_sample


WINDOW = 8  # words
_BREAKS = bytes.maketrans(b".,;:!?\"()[]{}*#$%&|<>~_=+/\\", b" " * 27)
LEARN = 5000  # labelled documents that are used at most: the bound of what the driver holds
# both dictionaries end with this text and so does every window: a block is then always compressed, and each byte saved shows
TAIL = b"  and  the  of  to  in  is  that  it  was  for  on  are  as  with  his  they  at  be  this  from  "
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, GRAM = 16_384, 2_048, 32, 8
_CONTENT = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"  # fixed value: the start offsets that end the header of a trained dictionary


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_BREAKS).split()


def spaced(words: Iterable[bytes]) -> bytes:
    """The words with two spaces at every border, so that the trainer's grams tell whole short words from parts of long ones."""
    return b"  " + b"  ".join(words) + b"  "


def windows(text: str | None) -> list[bytes]:
    w = tokens(text)
    return [spaced(w[i : i + WINDOW]) + TAIL for i in range(0, len(w), WINDOW)]


def _grams(word: bytes) -> set[bytes]:
    """The word with its borders, and what it begins and ends with."""
    w = b" " + word + b" "
    return {w} | {w[:n] for n in range(5, 9) if n < len(w)} | {w[-n:] for n in range(5, 9) if n < len(w)}


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of the dictionary that zstandard's trainer makes of the samples; with too little text for it, the end of the samples."""
    samples = [x for x in samples if len(x) > 2 * GRAM]
    if len(samples) >= 8 and sum(map(len, samples)) >= 2 * size:
        try:
            found = zstandard.train_dictionary(size, samples, k=SEGMENT, d=GRAM).as_bytes()
            return spaced([found[found.index(_CONTENT) + len(_CONTENT) :].strip(b" ")])
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def train_dictionaries(rows: Iterable[tuple[str, int]], ordinary_bytes: int = ORDINARY_BYTES, toxic_bytes: int = TOXIC_BYTES) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary, from (text, toxic) rows; empty without both kinds of rows.

    The ordinary samples are the ordinary documents, each word once. The toxic samples are the toxic documents' words with a border gram whose share of toxic
    documents exceeds that of ordinary ones at eight standard errors (fewer with little data) and by a factor of twelve, and that
    one in fifty toxic documents has. Equal texts teach once.
    """
    texts = list(dict.fromkeys(rows))
    seen = (Counter(), Counter())
    total = [0, 0]
    for text, toxic in texts:
        seen[toxic].update(set(tokens(text)))
        total[toxic] += 1
    if not all(total):
        return b"", b""
    grams = (Counter(), Counter())
    for word, n in seen[1].items():
        for g in _grams(word):
            grams[1][g] += n
    common_grams = {g for g, n in grams[1].items() if n >= max(4, total[1] // 50)}
    for word, n in seen[0].items():
        for g in _grams(word) & common_grams:
            grams[0][g] += n
    strict = min(8.0, 3.0 + math.sqrt(total[1]) / 4)
    strong = set()
    for g in common_grams:
        p1, p0 = min(1.0, grams[1][g] / total[1]), min(1.0, grams[0][g] / total[0])
        p = (p1 * total[1] + p0 * total[0]) / sum(total)
        error = math.sqrt(max(p * (1 - p), 1e-9) * (1 / total[0] + 1 / total[1]))
        if (p1 - p0) / error > strict and p1 > 12 * (p0 + 0.1 / total[0]):
            strong.add(g)
    marked = {w for w in seen[1] if not _grams(w).isdisjoint(strong)}
    ordinary = trained([spaced(dict.fromkeys(tokens(text))) for text, toxic in texts if not toxic], ordinary_bytes)
    toxic = trained([spaced(w for w in tokens(text) if w in marked) for text, toxic in texts if toxic], toxic_bytes)
    return toxic, ordinary


class Distance:
    """Compressors of the two dictionaries; a window's distance is how much shorter the toxic one makes it."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.pair = []
        if not toxic:
            return
        for content in (ordinary + TAIL, toxic + ordinary + TAIL):
            how = zstandard.ZstdCompressionParameters(
                format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
                window_log=17, hash_log=15, chain_log=15, strategy=zstandard.STRATEGY_LAZY2, min_match=4, search_log=5, target_length=64,
            )
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)

    def __call__(self, text: str | None) -> tuple[float, float, float]:
        """Largest and second largest distance, and the log of the number of windows."""
        w = windows(text)
        if not w or not self.pair:
            return 0.0, 0.0, 0.0
        ordinary, toxic = self.pair
        d = sorted((len(ordinary(x)) - len(toxic(x)) for x in w), reverse=True)[:2]
        return float(max(0, d[0])), float(max(0, d[1])) if len(d) > 1 else 0.0, math.log(len(w))


def calibrate(features: np.ndarray, toxic: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model of (1, features), by Newton's method with a small ridge."""
    x = np.c_[np.ones(len(features)), features]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - toxic) + 0.1 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def learn(docs: DataFrame, labels: DataFrame, most: int = LEARN) -> tuple[bytes, bytes, list[float]]:
    """Dictionaries and calibration from at most `most` labelled documents that aren't held out, the first by a hash of doc_id.

    Two thirds train the dictionaries, the rest the calibration.
    """
    marked = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    marked = hashed_sample(marked, "doc_id", labels.count(), most)
    # at most `most` rows go to all tasks, so no text is shuffled
    known = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).toArrow()
    third = [zlib.crc32(f"calibration {i}".encode()) % 3 == 0 for i in rows["doc_id"].to_pylist()]

    def part(calibrates: bool) -> Iterator[tuple[str, int]]:
        for i, t in enumerate(third):
            if t == calibrates:
                yield rows["text"][i].as_py(), int(rows["toxic"][i].as_py())

    toxic, ordinary = train_dictionaries(part(False))
    distance = Distance(toxic, ordinary)
    rest = [(distance(text), y) for text, y in part(True)]
    if len({y for _, y in rest}) < 2:
        return toxic, ordinary, [-3.0, 0.5, 0.0, 0.0]
    weights = calibrate(np.array([x for x, _ in rest]), np.array([y for _, y in rest]))
    return toxic, ordinary, weights.tolist()


def score(docs: DataFrame, model: tuple[bytes, bytes, list[float]], columns: list[str], name: str = "score") -> DataFrame:
    """The given columns of docs and the probability that each whole text is toxic. A null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select("text", *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))

    def scored(batches) -> Iterator[pa.RecordBatch]:
        toxic, ordinary, weights = sent.value
        distance = Distance(toxic, ordinary)
        w = np.array(weights)
        for batch in batches:
            x = np.array([distance(t.as_py()) for t in batch.column("text")]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p)], names=[*batch.schema.names[1:], "p"])

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    out = kept.mapInArrow(scored, f"{kinds}, p double")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), F.col("p").alias(name))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out boolean, score double and predicted int (1 if score >= threshold) of every document.

    docs: doc_id, text; labels: doc_id, toxic 0/1; other columns are ignored. Labels that are null, other than 0 or 1, or held
    out (crc32(doc_id) mod 4 is 2) teach nothing; without both labels no text is taken as toxic. A null or empty text has
    distance 0. Each row is scored alone, so repeated rows get equal results.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(docs, learn(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
