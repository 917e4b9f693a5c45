"""Skip-gram vectors of the nodes of walks, without a table of all nodes on any one machine.

A node's first vector follows from its name, so that tasks need no common vocabulary: each trains the vectors of the nodes that its own walks meet, and a node's vector is the mean over
the tasks that met it, weighted by how often. As in Node2Vec a node has one vector, for itself and as a neighbour, and is held against nodes drawn from the walks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_vectors(names: list[str], size: int, seed: int) -> np.ndarray:
    """A row for each name, of numbers between -1 / sqrt(size) and 1 / sqrt(size) that its hash gives."""
    digests = -(-4 * size // 64)
    raw = b"".join(blake2b(f"{seed}|{k}|{name}".encode()).digest() for name in names for k in range(digests))
    words = np.frombuffer(raw, dtype="<u4").reshape(len(names), 16 * digests)[:, :size]
    return ((words / 2.0**31 - 1) / np.sqrt(size)).astype(np.float32)


def near_pairs(nodes: np.ndarray, walks: np.ndarray, window: int, rng: np.random.Generator) -> np.ndarray:
    """(node, neighbour) for each two places of a walk (`walks` tells whose place it is) that lie within the window, which is cut at each place by chance as in word2vec."""
    reach, found = rng.integers(1, window + 1, len(nodes)), []
    for k in range(1, window + 1):
        at = np.flatnonzero(walks[k:] == walks[:-k])
        for a, b in ((at, at + k), (at + k, at)):
            seen = reach[a] >= k
            found.append(np.stack([nodes[a[seen]], nodes[b[seen]]], axis=1))
    return np.concatenate(found)


def trained(nodes: np.ndarray, walks: np.ndarray, vectors: np.ndarray, window: int, negatives: int, rate: float, passes: int, rng: np.random.Generator, at_once: int = 4096, drawn: int = 64, most: int = 16) -> np.ndarray:
    """`vectors` after so many passes over the walks' pairs, with a step that sinks to a tenth of `rate`.

    `at_once` pairs take a step together, against `drawn` nodes of the walks that count as `negatives` for each pair. A node's pulls add up to at most `most` of them in a step, so that hubs
    don't overshoot.
    """
    for turn in range(passes):
        pairs = near_pairs(nodes, walks, window, rng)
        pairs = pairs[rng.permutation(len(pairs))]
        for i in range(0, len(pairs), at_once):
            u, v = pairs[i : i + at_once].T
            n = nodes[rng.integers(0, len(nodes), drawn)]
            a, b, c = vectors[u], vectors[v], vectors[n]
            pull = 1 / (1 + np.exp(np.einsum("ij,ij->i", a, b)))[:, None]
            push = (negatives / drawn) / (1 + np.exp(-(a @ c.T)))
            ids, moves = np.concatenate([u, v, n]), np.concatenate([pull * b - push @ c, pull * a, -(push.T @ a)])
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            begins = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            counts = np.diff(np.r_[begins, len(ids)])
            step = rate * max(0.1, 1 - (turn + i / len(pairs)) / passes)
            vectors[ids[begins]] += step * np.add.reduceat(moves[order], begins, axis=0) * np.minimum(1, most / counts)[:, None].astype(np.float32)
    return vectors


def _task(batches: Iterator[pa.RecordBatch], size: int, window: int, negatives: int, rate: float, passes: int, seed: int) -> Iterator[pa.RecordBatch]:
    paths = pa.chunked_array([b.column(0) for b in batches], pa.list_(pa.string())).combine_chunks()
    if len(paths) == 0:
        return
    lengths = paths.value_lengths().to_numpy(zero_copy_only=False)
    coded = paths.flatten().dictionary_encode()
    nodes, names = coded.indices.to_numpy(), coded.dictionary
    rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
    vectors = trained(nodes, np.repeat(np.arange(len(lengths)), lengths), first_vectors(names.to_pylist(), size, seed), window, negatives, rate, passes, rng)
    met = np.bincount(nodes, minlength=len(names))
    for i in range(0, len(names), 10_000):
        some = slice(i, i + 10_000)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(vectors[some].ravel()), size).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([names[some], pa.array(met[some]), flat], names=["node", "met", "vector"])


def skip_gram(walks: DataFrame, size: int = 16, window: int = 3, negatives: int = 5, rate: float = 0.3, passes: int = 1, seed: int = 1, per_task: int = 50_000) -> DataFrame:
    """node, vector of all nodes of walks (walk_id, path); tasks get about `per_task` walks each, whatever their number. A rerun on as many walks gives the same vectors.

    walks is read twice, so it should be written. A node that is alone in all its walks keeps its first vector.
    """
    tasks = 1 + walks.count() // per_task
    dealt = walks.select("walk_id", "path").repartition(tasks, "walk_id").sortWithinPartitions("walk_id").select("path")
    rows = dealt.mapInArrow(partial(_task, size=size, window=window, negatives=negatives, rate=rate, passes=passes, seed=seed), "node string, met long, vector array<float>")
    # rows are shuffled as they are: sums of single numbers would be wider, and a task has no node twice
    sums = [F.sum(F.col("met") * F.col("vector")[i]).alias(f"s{i}") for i in range(size)]
    total = rows.repartition("node").groupBy("node").agg(F.sum("met").alias("met"), *sums)
    return total.select("node", F.array(*(F.col(f"s{i}") / F.col("met") for i in range(size))).alias("vector"))
