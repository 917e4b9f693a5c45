"""Approximate nearest neighbours by inverted lists with an adaptive dimension scan.

Vectors of unequal length get one more coordinate, so that the largest inner product is the smallest Euclidean distance. They are rotated at random, so
that any block of columns is a random projection. k-means centres, fitted on a bounded sample, cut the table into lists; every row is
indexed. A query first scans its nearest lists; the distance of its k-th best there goes with it to the other lists that it probes,
but for those that lie wholly beyond it. A scan adds up squared differences column block by column block, nearest lists first: after each block a
hypothesis test compares the scaled partial distance with the k-th best so far, which sinks from part to part, and candidates that
fail it are abandoned. What is left is scored on the original vectors in double precision.

Equal vectors collapse first: of each the k + 1 smallest ids can be among k nearest, so a vector that a third of the rows hold costs no more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.llm.shared import firsts, hashed_sample, store

SAMPLE = 20_000  # vectors that fit the lists at most
MOST_LISTS = 4096
PART = 4096  # vectors that a task scans together: some lists, or a part of a long one
RECALL = 0.96  # of the sample's neighbours that the probed lists hold
LEAD = 2  # lists that a query scans before it goes to the others
STEP = 256  # candidates between two lowerings of the distance to beat
QUANTILE = 2.33  # of the hypothesis test, in standard errors: a candidate as near as the k-th best fails one test in a hundred


class Index:
    """Rotation, centres and the constant that turns inner products into distances; none, if all vectors are of one length."""

    def __init__(self, rotation: np.ndarray, centres: np.ndarray, longest: float | None):
        self.rotation, self.centres, self.longest = rotation, centres, longest

    def place(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rotated vectors with the extra coordinate, if there is one; a query's is zero."""
        if self.longest is None:
            return x @ self.rotation
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.longest**2 - np.einsum("ij,ij->i", x, x)))
        return np.c_[x, extra] @ self.rotation

    def nearest(self, placed: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centres of each row, nearest first."""
        d = (self.centres**2).sum(axis=1) - 2 * placed @ self.centres.T
        n = min(n, len(self.centres))
        at = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, 1), axis=1, kind="stable"), 1)


def fit(sample: np.ndarray, longest: float | None, rows: int, seed: int = 7) -> Index:
    """k-means with about sqrt(rows) centres on the placed sample."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] + (longest is not None)
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    index = Index(rotation, np.zeros((1, dim)), longest)
    x = index.place(sample, False)
    k = int(min(MOST_LISTS, max(1, math.isqrt(rows)), max(1, len(x) // 4)))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        index.centres = centres
        own = np.concatenate([index.nearest(x[i : i + 4096], 1)[:, 0] for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=k)[:, None]
        centres = np.where(count > 0, sums / np.maximum(1, count), centres)
    # equal centres would tie, and a query could probe the empty ones of them
    index.centres = np.unique(centres.round(9), axis=0)
    return index


def probes_for(index: Index, sample: np.ndarray, k: int, recall: float) -> int:
    """How many lists must be probed for the given share of the k nearest, measured on the sample by brute force.

    Neighbours in the whole table are nearer than in the sample, so there they lie in fewer lists.
    """
    asks = sample[:: max(1, len(sample) // 256)]
    lists = index.nearest(index.place(sample, False), 1)[:, 0]
    order = index.nearest(index.place(asks, True), len(index.centres))
    rank = np.argsort(order, axis=1)
    score = asks @ sample.T
    best = np.argpartition(-score, min(k, len(sample) - 1), axis=1)[:, : k + 1]
    need = np.sort(np.take_along_axis(rank, lists[best], 1).ravel()) + 1
    return int(need[min(len(need) - 1, math.ceil(recall * len(need)))])


def deal_lists(counts: dict[int, int], lists: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each list: short lists share one, a long one is split."""
    first, parts = np.zeros(lists, np.int64), np.ones(lists, np.int64)
    shard, room = 0, PART
    for i in range(lists):
        n = counts.get(i, 0)
        if n > PART:
            parts[i] = -(-n // PART)
        if n > room:
            shard, room = shard + 1, PART
        first[i] = shard
        if parts[i] > 1:
            shard, room = shard + int(parts[i]), PART
        else:
            room -= n
    return first, parts


def scan(query: np.ndarray, placed: list[np.ndarray], parts: list[np.ndarray], k: int, best: float = math.inf, quantile: float = QUANTILE) -> tuple[np.ndarray, int]:
    """Rows that may be among the k nearest to a placed query, and how many column values were read.

    placed: all columns, in blocks; parts: candidate rows, those to be scanned first first; best: a squared distance that k others are known to keep. Under a
    random rotation the root of (columns / columns seen) times the partial squared distance estimates the distance with a relative standard
    error of sqrt((1 - seen / columns) / (2 * seen)) about.
    """
    dim = sum(b.shape[1] for b in placed)
    rows_, far, read = np.zeros(0, np.int64), np.zeros(0), 0
    rows = np.concatenate(parts) if parts else rows_
    for start in range(0, len(rows), STEP):
        now = rows[start : start + STEP]
        partial = np.zeros(len(now))
        for block, at in _at(placed):
            width = block.shape[1]
            step = block[now] - query[at : at + width]
            partial = partial + np.einsum("ij,ij->i", step, step)
            read, seen = read + step.size, at + width
            if best < math.inf and seen < dim:
                keep = partial * (dim / seen) <= best * (1 + quantile * math.sqrt((1 - seen / dim) / (2 * seen))) ** 2
                now, partial = now[keep], partial[keep]
                if not len(now):
                    break
        rows_, far = np.concatenate([rows_, now]), np.concatenate([far, partial])
        if len(far) >= k:
            best = min(best, float(np.partition(far, k - 1)[k - 1]))
            near = far <= best * (1 + 1e-9) + 1e-12
            rows_, far = rows_[near], far[near]
    return rows_, read


def _at(placed: list[np.ndarray]) -> Iterator[tuple[np.ndarray, int]]:
    at = 0
    for b in placed:
        yield b, at
        at += b.shape[1]


def usable(vector: str = "embedding"):
    """Not null, without null or non-finite components, and not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, probes: int | None = None, block: int = 16) -> DataFrame:
    """The k nearest vectors found for each query by largest inner product, the query's own row excepted.

    probes: lists that each query probes; without it, as many as reach RECALL on the sample. vectors, queries: vec_id long, embedding array<float>; other columns are ignored. Vectors that are null, zero, or hold a null or
    non-finite component, and those whose length isn't the most common one, take no part. Returns query_id, rank (from
    1; ties to the smaller vec_id), vec_id, score double. With fewer than k candidates all are returned. Rows that repeat a vec_id
    count once (the smallest vector of it). An empty table gives no rows.
    """
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"

    def clean(df):
        df = df.filter(F.col("vec_id").isNotNull() & usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        return df.groupBy("vec_id").agg(F.min("v").alias("v"))

    rows, asks = clean(vectors), clean(queries)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("square"), F.min(square).alias("least")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return spark.createDataFrame([], shape)
    dim, total = common.dim, common.n
    longest = None if common.least > 0.9999 * common.square else math.sqrt(common.square)
    rows, asks = rows.filter(F.size("v") == dim), asks.filter(F.size("v") == dim)
    # of equal vectors only the k + 1 smallest ids can be returned, also to a query that is one of them
    order = Window.partitionBy("v").orderBy("vec_id")
    rows = rows.withColumn("copy", F.row_number().over(order)).filter(F.col("copy") <= k + 1).drop("copy")
    chosen = hashed_sample(rows.select("vec_id", "v"), "vec_id", total, min(SAMPLE, max(1000, 8 * math.isqrt(total)))).toArrow()
    sample = _matrix(chosen["v"], dim)
    fitted = fit(sample, longest, total)
    lists = len(fitted.centres)
    index, near = spark.sparkContext.broadcast(fitted), min(lists, probes or probes_for(fitted, sample, k, RECALL))

    def own_list(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            placed = index.value.place(x, False)
            own = index.value.nearest(placed, 1)[:, 0] if len(x) else np.zeros(0, np.int64)
            off = np.linalg.norm(placed - index.value.centres[own], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own.astype(np.int32)), pa.array(off)], names=["vec_id", "v", "list", "off"])

    # equal queries are asked once, for k + 1, so that each can leave out its own row
    asked = asks.groupBy("v").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "v")
    indexed = store(rows.mapInArrow(own_list, "vec_id long, v array<double>, list int, off double"), "lists")
    facts = indexed.groupBy("list").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect()  # at most MOST_LISTS rows
    radius = np.zeros(lists)
    radius[[r["list"] for r in facts]] = [r["radius"] for r in facts]
    deal = spark.sparkContext.broadcast((*deal_lists({r["list"]: r["n"] for r in facts}, lists), radius))
    indexed = indexed.drop("off")

    def dealt(batches) -> Iterator[pa.RecordBatch]:
        first, parts, _ = deal.value
        for batch in batches:
            own = batch.column("list").to_numpy()
            shard = first[own] + batch.column("vec_id").to_numpy() % parts[own]
            yield batch.append_column("shard", pa.array(shard.astype(np.int32)))

    def probes_of(lead: bool):
        def probed(batches) -> Iterator[pa.RecordBatch]:
            """Each query with the lists of a shard that it probes: its nearest, or those behind them that its best distance reaches."""
            first, parts, radius = deal.value
            for batch in batches:
                x = _matrix(batch.column("v"), dim)
                best = np.array([math.inf if b is None else b for b in batch.column("best").to_pylist()], np.float64)
                turned = index.value.place(x, True) if len(x) else x
                at, shards, wanted = [], [], []
                for i, row in enumerate(index.value.nearest(turned, near) if len(x) else ()):
                    if lead:
                        row = row[:LEAD]
                    else:
                        row = row[LEAD:]
                        row = row[np.linalg.norm(index.value.centres[row] - turned[i], axis=1) - radius[row] <= math.sqrt(best[i])]
                    if not len(row):
                        continue
                    shard = np.repeat(first[row], parts[row]) + np.concatenate([np.arange(n) for n in parts[row]])
                    row = np.repeat(row, parts[row])
                    order = np.argsort(shard, kind="stable")  # nearest lists first within a shard
                    shard, row = shard[order], row[order]
                    cut = np.flatnonzero(firsts(shard))
                    at += [i] * len(cut)
                    shards += shard[cut].tolist()
                    wanted += [r.astype(np.int32).tobytes() for r in np.split(row, cut[1:])]
                at = pa.array(at, pa.int64())
                columns = [batch.column(c).take(at) for c in ("vec_id", "v", "best")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shards, pa.int32()), pa.array(wanted, pa.binary())], names=["vec_id", "v", "best", "shard", "lists"])

        return probed

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            own = left["list"].to_numpy()
            order = np.argsort(own, kind="stable")
            ids, x = left["vec_id"].to_numpy()[order], _matrix(left["v"], dim)[order]
            edges = np.searchsorted(own[order], np.arange(lists + 1))
            placed = index.value.place(x, False)
            blocks = [np.ascontiguousarray(placed[:, i : i + block]) for i in range(0, placed.shape[1], block)]
            q = _matrix(right["v"], dim)
            turned = index.value.place(q, True)
            for i, (query_id, wanted, best) in enumerate(zip(*(right[c].to_pylist() for c in ("vec_id", "lists", "best")), strict=True)):
                parts = [np.arange(edges[n], edges[n + 1]) for n in np.frombuffer(wanted, np.int32)]
                at, _ = scan(turned[i], blocks, parts, k + 1, math.inf if best is None else best)
                score = x[at] @ q[i]
                best = np.lexsort((ids[at], -score))[: k + 1]
                out_q += [query_id] * len(best)
                out_v.append(ids[at][best])
                out_s.append(score[best])
        return pa.table([pa.array(out_q, pa.int64()), pa.array(np.concatenate(out_v) if out_v else [], pa.int64()), pa.array(np.concatenate(out_s) if out_s else [], pa.float64())], names=["asked", "vec_id", "score"])

    held = indexed.mapInArrow(dealt, "vec_id long, v array<double>, list int, shard int")

    def found_in(queries: DataFrame, lead: bool) -> DataFrame:
        sent = queries.mapInArrow(probes_of(lead), "vec_id long, v array<double>, best double, shard int, lists binary")
        return held.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(search, "asked long, vec_id long, score double")

    top = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    leading = store(found_in(asked.withColumn("best", F.lit(None).cast("double")), True).withColumn("place", F.row_number().over(top)).filter(F.col("place") <= k + 1), "leading")
    edge = leading.filter(F.col("place") == k + 1).select(F.col("asked").alias("vec_id"), F.col("score").alias("edge"))
    # squared distance to the k-th best of the first lists, in the space of the index
    beat = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) + F.lit(common.square) - 2 * F.col("edge")
    later = asked.join(edge, "vec_id", "left").select("vec_id", "v", (F.greatest(beat, F.lit(0.0)) * (1 + 1e-6) + 1e-9).alias("best"))
    found = leading.drop("place").unionByName(found_in(later, False))
    found = found.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= k + 1)
    # back to every query of the same vector, without its own row
    same = asks.withColumnRenamed("vec_id", "query_id").join(asked.withColumnRenamed("vec_id", "asked"), "v").select("query_id", "asked")
    each = same.join(found, "asked").filter(F.col("vec_id") != F.col("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(final).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def op3_adaptive_scan(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(vectors, vectors.filter("vec_id % 20 = 0"))
