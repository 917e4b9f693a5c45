"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits of all fingerprints are dealt to m partitions, correlated bits together. If thresholds T of the partitions (-1 or more) add up to
radius - m + 1, two fingerprints within the radius differ by T[i] bits or fewer in some partition i. So each fingerprint may choose thresholds of its own:
dynamic programming takes those with the least estimated work (the values that it must probe, and the fingerprints that it is expected to meet there).
Estimates come from histograms of all fingerprints' bits, eight at a time; m is the number of partitions with the least estimated work for all of them.
Probes meet the index in an ordinary join that counts differing bits.

Equal fingerprints collapse first. A value that more than CELL different fingerprints have isn't joined: they and those that probe it are solved in tiles
whose classes go on as stars, and then only fingerprints outside of a value's largest class meet its other tiles. Nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.components import components
from evgraph.llm.ngram_join import Classes
from evgraph.llm.shared import store
from evgraph.llm.text import U64, Slice, full_windows, join_words, lower_ascii, slices

BITS = 64
CELL = 256  # different fingerprints of a value that are joined pair by pair
BLOCK = 2048  # fingerprints of a tile
PROBE_COST = 20.0  # work of a probed value, as a multiple of that of a fingerprint met there; timed on random fingerprints, 250,000 and 1,000,000 of them
STEP = 1 << 18  # shingles, and probes, that a task holds at once


def _bits(fp: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, the highest first."""
    return np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id long, fingerprint long) of every row of docs (doc_id long, text string; other columns are ignored).

    A-Z is lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D; shingles are size words joined by a space, repeats included, or all words of a shorter
    text. A bit is 1 if it is set in over half of the shingles' XXH64; without words (or with a null text) the fingerprint is zero.
    """

    def hashed(batches) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for s in slices(batch.column("text")):
                s = Slice(s.first, lower_ascii(s.data), s.offsets)
                starts, ends, doc = s.words()
                joined, begin, _ = join_words(s, starts, ends, doc)
                end = begin + ends - starts
                count = np.bincount(doc, minlength=s.rows)
                full, few = full_windows(doc, size), np.flatnonzero((count > 0) & (count < size))
                first = np.searchsorted(doc, few)
                one, two = np.concatenate([begin[full], begin[first]]), np.concatenate([end[full + size - 1], end[first + count[few] - 1]])
                owner = np.concatenate([doc[full], few])
                text, ones = joined.tobytes(), np.zeros((s.rows, BITS), np.int64)
                for x in range(0, len(one), STEP):
                    h = [xxh64_intdigest(text[a:b], seed) for a, b in zip(one[x : x + STEP].tolist(), two[x : x + STEP].tolist(), strict=True)]
                    mine = owner[x : x + STEP]
                    cut = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                    # a few texts' shingles may stand in two groups: full ones first, then short texts
                    np.add.at(ones, mine[cut], np.add.reduceat(_bits(np.array(h, U64)), cut, axis=0, dtype=np.int32))
                most = 2 * ones > np.bincount(owner, minlength=s.rows)[:, None]
                fp = np.packbits(most, axis=1).view(">u8").ravel().astype(U64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, s.rows), pa.array(fp.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed, "doc_id long, fingerprint long")


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits (0 is the highest) in m groups of nearly equal size: each grows by the bit that is most correlated with those it has.

    together: how many of n fingerprints have both bits of a pair.
    """
    share = together / max(1, n)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, out = list(range(BITS)), []
    for k in range(m):
        group = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        while len(group) < len(range(k, BITS, m)):
            group.append(max((b for b in free if b not in group), key=lambda b: (tie[b, group].sum(), -b)))
        free = [b for b in free if b not in group]
        out.append(group)
    return out


def project(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint side by side, the first highest."""
    out = np.zeros(len(fp), U64)
    for b in bits:
        out = out << U64(1) | (fp >> U64(BITS - 1 - b)) & U64(1)
    return out


def eights(group: list[int]) -> list[list[int]]:
    """Parts of a group of at most eight bits, as its histograms have them."""
    return [group[i : i + 8] for i in range(0, len(group), 8)]


class Layout:
    """One way to partition the bits, and the work that thresholds cost each fingerprint."""

    def __init__(self, groups: list[list[int]], histograms: list[list[np.ndarray]], radius: int):
        self.groups, self.radius, self.n = groups, radius, max(1, int(histograms[0][0].sum()))
        near = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
        # share of fingerprints at each distance from each value of an eight
        self.shares = [[np.stack([((near == d) * h).sum(axis=1) / self.n for d in range(radius + 1)], axis=1) for h in hs] for hs in histograms]

    def costs(self, fp: np.ndarray) -> np.ndarray:
        """Estimated work by group and threshold -1, 0, ... radius, for each fingerprint; eights count as independent."""
        out = np.zeros((len(self.groups), self.radius + 2, len(fp)))
        for g, group in enumerate(self.groups):
            at = np.zeros((self.radius + 1, len(fp)))
            at[0] = 1
            for part, share in zip(eights(group), self.shares[g], strict=True):
                here = share[project(fp, part).astype(np.int64)].T
                at = np.stack([sum(at[d - k] * here[k] for k in range(d + 1)) for d in range(self.radius + 1)])
            probes = np.cumsum([comb(len(group), d) for d in range(self.radius + 1)])
            out[g, 1:] = self.n * np.cumsum(at, axis=0) + PROBE_COST * probes[:, None]
        return out

    def allocate(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds by group (-1: none is probed) that add up to radius - groups + 1, and their work, for each fingerprint."""
        m, n = len(self.groups), len(fp)
        cost = self.costs(fp)
        # best[s]: least work of the groups so far if their thresholds, each plus one, add up to s; the total is radius + 1
        best = np.full((self.radius + 2, n), np.inf)
        best[0] = 0
        chosen = np.zeros((m, self.radius + 2, n), np.int8)
        for g in range(m):
            ways = np.full((self.radius + 2, self.radius + 2, n), np.inf)
            for s in range(self.radius + 2):
                for t in range(min(s, len(self.groups[g]) + 1) + 1):
                    ways[s, t] = best[s - t] + cost[g, t]
            chosen[g], best = ways.argmin(axis=1), ways.min(axis=1)
        out, left = np.zeros((m, n), np.int64), np.full(n, self.radius + 1)
        for g in range(m - 1, -1, -1):
            t = chosen[g, left, np.arange(n)]
            out[g] = t - 1
            left = left - t
        return out, best[self.radius + 1]

    def keys(self, fp: np.ndarray) -> list[np.ndarray]:
        """The number of each partition and value of each fingerprint, by group."""
        return [U64(g << 32) | project(fp, group) for g, group in enumerate(self.groups)]

    def probes(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(key, fingerprint) of the values that each fingerprint probes."""
        thresholds, _ = self.allocate(fp)
        for g, own in enumerate(self.keys(fp)):
            for t in range(self.radius + 1):
                ask = np.flatnonzero(thresholds[g] == t)
                if not len(ask):
                    continue
                masks = np.array([sum(1 << b for b in c) for d in range(t + 1) for c in combinations(range(len(self.groups[g])), d)], U64)
                few = max(1, STEP // len(masks))
                for x in range(0, len(ask), few):
                    rows = ask[x : x + few]
                    yield (own[rows][:, None] ^ masks[None, :]).ravel(), np.repeat(fp[rows], len(masks))


def _fps(batches) -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch.column("fingerprint").to_numpy(zero_copy_only=False).view(U64)


def _summed(df: DataFrame, task, keys: list[str], value: str = "long") -> pa.Table:
    """The tasks' figures (keys int, n) added up; as many rows as there are keys."""
    rows = df.mapInArrow(task, ", ".join([*(f"{k} int" for k in keys), f"n {value}"]))
    return rows.groupBy(keys).agg(F.sum("n").alias("n")).toArrow()


def plan_layout(fps: DataFrame, radius: int) -> Layout:
    """The layout with the least estimated work for all of fps (fingerprint long). The driver gets 4,096 counts and at most 256 for each eight of each layout."""

    def pairs(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for fp in _fps(batches):
            for x in range(0, len(fp), 1 << 16):
                b = _bits(fp[x : x + (1 << 16)]).astype(np.float32)
                total += (b.T @ b).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "n"])

    found = _summed(fps, pairs, ["cell"])
    together = np.zeros(BITS * BITS, np.int64)
    together[found["cell"].to_numpy()] = found["n"].to_numpy()
    n = fps.count()
    choices = [group_bits(together.reshape(BITS, BITS), n, m) for m in range(2, radius + 2)]
    parts = [(c, g, e, part) for c, groups in enumerate(choices) for g, group in enumerate(groups) for e, part in enumerate(eights(group))]

    def values(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(parts), 256), np.int64)
        for fp in _fps(batches):
            for k, (_, _, _, part) in enumerate(parts):
                total[k] += np.bincount(project(fp, part).astype(np.int64), minlength=256)
        k, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(v.astype(np.int32)), pa.array(total[k, v])], names=["part", "value", "n"])

    found = _summed(fps, values, ["part", "value"])
    counts = np.zeros((len(parts), 256), np.int64)
    counts[found["part"].to_numpy(), found["value"].to_numpy()] = found["n"].to_numpy()
    layouts = []
    for c, groups in enumerate(choices):
        histograms = [[counts[parts.index((c, g, e, part))] for e, part in enumerate(eights(group))] for g, group in enumerate(groups)]
        layouts.append(Layout(groups, histograms, radius))

    def work(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(layouts))
        for fp in _fps(batches):
            for x in range(0, len(fp), 4096):
                total += [layout.allocate(fp[x : x + 4096])[1].sum() for layout in layouts]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(layouts), dtype=np.int32)), pa.array(total)], names=["layout", "n"])

    found = _summed(fps, work, ["layout"], "double")
    return layouts[min(zip(found["n"].to_pylist(), found["layout"].to_pylist(), strict=True), default=(0, 0))[1]]


def _near(radius: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ two) <= radius


def _tile_stars(radius: int):
    def stars(table: pa.Table) -> pa.Table:
        """Each fingerprint of a tile with the first one of its class."""
        fp = np.unique(table["fingerprint"].to_numpy().view(U64))
        left, u, v = fp, [], []
        while len(left):
            head, left = left[0], left[1:]
            front = [head]
            while front and len(left):
                near = _near(radius, left, front.pop())
                front.extend(left[near])
                u.append(left[near])
                v.append(np.full(int(near.sum()), head))
                left = left[~near]
        u, v = (np.concatenate([fp[:0], *x]).view(np.int64) for x in (u, v))
        return pa.table([u, v], names=["u", "v"])

    return stars


def _stray_links(radius: int):
    def links(table: pa.Table) -> pa.Table:
        """Pairs of classes with a link between a stray and a member of another class, but for pairs that others of this task imply."""
        fp, asks = table["fingerprint"].to_numpy().view(U64), table["asks"].to_numpy()
        names, label = np.unique(table["label"].to_numpy(), return_inverse=True)
        classes, found = Classes(len(names)), []
        held = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks):
            for j in np.unique(label[held[_near(radius, fp[held], fp[i])]]).tolist():
                if classes.join(int(label[i]), j):
                    found.append((names[label[i]], names[j]))
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

    return links


def _labels(fps: DataFrame, linked: DataFrame) -> DataFrame:
    """(fingerprint, label): the component of linked, or the fingerprint itself."""
    joined = fps.join(linked, fps["fingerprint"] == linked["node"], "left")
    return joined.select("fingerprint", F.coalesce("component", "fingerprint").alias("label"))


def hamming_classes(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(fingerprint long, label long) of the different fingerprints of fps: labels are equal where chains of links of radius differing bits or fewer join them."""
    fps = store(fps.select("fingerprint").distinct(), "fingerprints")
    layout = plan_layout(fps, radius)

    def indexed(batches) -> Iterator[pa.RecordBatch]:
        for fp in _fps(batches):
            for key in layout.keys(fp):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["key", "fingerprint"])

    def probing(batches) -> Iterator[pa.RecordBatch]:
        for fp in _fps(batches):
            for key, asker in layout.probes(fp):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(asker.view(np.int64))], names=["key", "asker"])

    index, probes = fps.mapInArrow(indexed, "key long, fingerprint long"), fps.mapInArrow(probing, "key long, asker long")
    wide = store(index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CELL).select("key"), "wide-values")
    any_wide = not wide.isEmpty()
    narrow = (index.join(wide, "key", "left_anti"), probes.join(wide, "key", "left_anti")) if any_wide else (index, probes)
    # each of a pair finds the other by its own thresholds, so one direction is enough
    close = (F.col("asker") < F.col("fingerprint")) & (F.bit_count(F.col("asker").bitwiseXOR(F.col("fingerprint"))) <= radius)
    links = narrow[0].join(narrow[1], "key").filter(close).select(F.col("asker").alias("u"), F.col("fingerprint").alias("v"))
    if not any_wide:
        return _labels(fps, components(links))
    together = index.join(wide, "key", "left_semi").unionByName(probes.join(wide, "key", "left_semi").withColumnRenamed("asker", "fingerprint")).distinct()
    together = store(together, "wide-probes")
    sizes = store(together.groupBy("key").agg(F.count("*").alias("m")), "wide-sizes")
    tiles = together.join(sizes, "key").select("key", F.pmod(F.xxhash64("fingerprint"), F.ceil(F.col("m") / BLOCK)).alias("tile"), "fingerprint")
    stars = tiles.groupBy("key", "tile").applyInArrow(_tile_stars(radius), "u long, v long")
    labels = store(_labels(fps, components(links.unionByName(stars))), "labels")
    # values of several tiles: whoever is outside of the largest class meets all that probe the value or have it
    several = sizes.filter(F.col("m") > BLOCK)
    labelled = store(together.join(several, "key").join(labels, "fingerprint").select("key", "m", "fingerprint", "label"), "wide-labels")
    largest = labelled.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"))
    strays = labelled.join(largest, "key").filter(F.col("label") != F.col("top.label")).select("key", "m", "fingerprint", "label")
    strays = store(strays, "wide-strays")
    ask_tiles = strays.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("ask_tiles"))
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    tile_of = lambda n: F.pmod(F.xxhash64("fingerprint"), n)
    n_tiles = F.ceil(F.col("m") / BLOCK)
    facts = ("fingerprint", "label")
    held = labelled.join(ask_tiles, "key").select("key", tile_of(n_tiles).alias("tile"), to_all(F.col("ask_tiles")).alias("ask_tile"), *facts, F.lit(False).alias("asks"))
    asks = strays.join(ask_tiles, "key").select("key", to_all(n_tiles).alias("tile"), tile_of(F.col("ask_tiles")).alias("ask_tile"), *facts, F.lit(True).alias("asks"))
    more = held.unionByName(asks).groupBy("key", "tile", "ask_tile").applyInArrow(_stray_links(radius), "u long, v long")
    joined = components(more)
    return labels.join(joined, labels["label"] == joined["node"], "left").select("fingerprint", F.coalesce("component", "label").alias("label"))


def simhash_near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """Fingerprint of every row of docs and the component of rows that links of radius differing bits or fewer reach.

    docs: doc_id long, text string; other columns are ignored. For fingerprints see fingerprints(); those of null, empty and wordless texts are zero and link like any
    other. Returns doc_id, fingerprint long, component_id long: the smallest doc_id of the component. Rows that repeat a doc_id keep their rows; rows
    without one link like others and take a component's smallest doc_id (null if no row of it has one). An empty table gives no rows.
    """
    members = store(fingerprints(docs, size), "document-fingerprints")
    named = members.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    classed = named.join(hamming_classes(named, radius), "fingerprint")
    lookup = classed.join(classed.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fingerprint", "component_id")
    return members.join(lookup, "fingerprint").select("doc_id", "fingerprint", "component_id")


def op13_simhash_partitions(spark, sf_dir: str) -> DataFrame:
    found = simhash_near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
