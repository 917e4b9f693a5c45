"""Similarity join of documents on the Jaccard similarity of their word n-gram sets.

Sets that are equal collapse first; from then on a set is known by its 128-bit digest. A set's prefix, the shingles of which any similar set must hold one, takes shingles that
occur in one document only before others, so most documents have no key left and can't link. Sets that share a key
meet in tiles of neighbouring sizes (bands by the threshold ratio) and are compared by hashed parity bitmaps: the symmetric difference has
as many shingles as differing bits at least, so bit counts bound the overlap from above. What passes makes candidate groups, in which links are
verified by intersecting sorted arrays, but for pairs that are in one class already (their link changes nothing).

A key of more sets than a tile holds is split by size bands first: a band's sets meet those of the next, and only bands that are still too full make
groups without comparisons. A group of more than a tile's sets is never compared pair by pair: tiles of it are solved alone, then tiles of the classes' representatives, and so on;
near copies soon are one class. What is left are the sets outside of the group's largest class, which meet the sets of neighbouring bands, tile by tile.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.components import components
from evgraph.llm.repeats import repeat_filter
from evgraph.llm.shared import batch_of, store, text_bytes
from evgraph.llm.text import U64, Slice, full_windows, lower_ascii, mix, slices, window_hashes, word_hashes

BLOCK = 2048  # sets of a tile; a task compares one tile, or one with another
ROUNDS = 4  # of representatives, before the rest is compared in full


def shingles(s: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the slice's shingles and their documents; a document of fewer words has one, of all its words."""
    s = Slice(s.first, lower_ascii(s.data), s.offsets)
    starts, ends, docs = s.words()
    words = word_hashes(s, starts, ends)
    at = full_windows(docs, size)
    count = np.bincount(docs, minlength=s.rows)
    few = np.flatnonzero((count > 0) & (count < size))
    first = np.searchsorted(docs, few)
    h = np.concatenate([window_hashes(words, at, size), window_hashes(words, first, count[few]) if len(few) else np.zeros(0, U64)])
    return h, np.concatenate([docs[at], few])


def sets(s: Slice, size: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each document."""
    h, doc = shingles(s, size)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        keep = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        h, doc = h[keep], doc[keep]
    cut = np.searchsorted(doc, np.arange(s.rows + 1))
    for i in range(s.rows):
        yield h[cut[i] : cut[i + 1]]


def least_overlap(a: int, b: int, percent: int) -> int:
    """Smallest intersection with which 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """A set of n shingles that shares none of its first so many with another can't reach the threshold."""
    return n - -(-percent * n // 100) + 1


def bitmap(h: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each bit; at least two bits a shingle, 64 at least."""
    width = max(6, math.ceil(math.log2(max(1, len(h)) * 2)))
    parity = np.bincount((mix(h) >> U64(64 - width)).astype(np.int64), minlength=1 << width) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def fold(bits: np.ndarray, bytes_: int) -> np.ndarray:
    """A parity bitmap of fewer bits; places are top bits of hashes, so neighbours fold together."""
    while len(bits) > bytes_:
        b = np.unpackbits(bits)
        bits = np.packbits(b[::2] ^ b[1::2])
    return bits


class Tile:
    """Documents with sizes and parity bitmaps, compared with another tile's."""

    def __init__(self, sizes: np.ndarray, maps: list[bytes]):
        self.sizes = sizes
        self.maps = [np.frombuffer(m, np.uint8) for m in maps]

    def stacked(self, rows: np.ndarray, bytes_: int) -> np.ndarray:
        return np.stack([fold(self.maps[i], bytes_) for i in rows]).view(U64)


def passing(a: Tile, b: Tile, percent: int, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row of a, rows of b) that size and bit counts let pass. same: b is a, and only later rows count."""
    order = np.argsort(b.sizes, kind="stable")
    size_b = b.sizes[order]
    # bands of sizes: from a band only its own and the next can link
    width = math.log(100 / percent) if percent < 100 else 1e-9
    band = np.floor(np.log(np.maximum(1, a.sizes)) / width).astype(np.int64)
    for k in np.unique(band):
        mine = np.flatnonzero(band == k)
        low, high = a.sizes[mine].min(), a.sizes[mine].max()
        x, y = np.searchsorted(size_b, (low * percent / 100 - 1, high * 100 / percent + 1))
        theirs = np.sort(order[x:y])
        if not len(theirs):
            continue
        bytes_ = min(min(len(a.maps[i]) for i in mine), min(len(b.maps[i]) for i in theirs))
        left, right = a.stacked(mine, bytes_), b.stacked(theirs, bytes_)
        sizes = b.sizes[theirs]
        for i, m in enumerate(mine):
            differ = np.bitwise_count(right ^ left[i]).sum(axis=1).astype(np.int64)
            most = np.minimum((sizes + a.sizes[m] - differ) // 2, np.minimum(sizes, a.sizes[m]))
            ok = 100 * most >= percent * (sizes + a.sizes[m] - most)
            if same:
                ok &= theirs > m
            if ok.any():
                yield int(m), theirs[ok]


class Classes:
    """Union-find over a task's rows; rows with equal labels begin in one class."""

    def __init__(self, n: int, labels: list | None = None):
        self.up = np.arange(n)
        first: dict = {}
        for i, label in enumerate(labels or ()):
            self.up[i] = first.setdefault(label, i)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def roots(self, rows: np.ndarray) -> np.ndarray:
        up = self.up[rows]
        while not np.array_equal(up, nxt := self.up[up]):
            up = nxt
        return up


def _joins(classes: Classes, maps: list[bytes], sizes: np.ndarray, arrays: list[np.ndarray] | None, one: np.ndarray, two: np.ndarray | None, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows that join two classes: of tile one with tile two, or within tile one. arrays: verify pairs by their shingles."""
    a = Tile(sizes[one], [maps[i] for i in one])
    b = a if two is None else Tile(sizes[two], [maps[i] for i in two])
    for i, js in passing(a, b, percent, two is None):
        x = int(one[i])
        js = (one if two is None else two)[js]
        for y in js[classes.roots(js) != classes.root(x)].tolist():
            if classes.root(x) == classes.root(y):
                continue
            if arrays is not None:
                both = np.concatenate([arrays[x], arrays[y]])
                both.sort()
                overlap = int((both[1:] == both[:-1]).sum())
                if 100 * overlap < percent * (sizes[x] + sizes[y] - overlap):
                    continue
            classes.join(x, y)
            yield x, y


def _arrays(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U64) for x in table["hashes"]]


def _passing_links(percent: int):
    def links(table: pa.Table) -> pa.Table:
        """A spanning forest of the pairs of a key's or cell's sets that the bounds let pass."""
        ids, sizes = table["doc"].to_pylist(), table["n"].to_numpy()
        found = list(_joins(Classes(len(ids)), table["bits"].to_pylist(), sizes, None, np.arange(len(ids)), None, percent))
        return pa.table([pa.array([ids[x] for x, _ in found], pa.binary()), pa.array([ids[y] for _, y in found], pa.binary())], names=["u", "v"])

    return links


def _heads(percent: int):
    def heads(table: pa.Table) -> pa.Table:
        """The head (smallest set) of each set's class, by the links within a tile. Heads of large groups bring what the next round compares."""
        ids, sizes = table["doc"].to_pylist(), table["n"].to_numpy().astype(np.int64)
        order = np.array(sorted(range(len(ids)), key=ids.__getitem__))
        table, ids, sizes = table.take(pa.array(order)), [ids[i] for i in order], sizes[order]
        classes = Classes(len(ids))
        for _ in _joins(classes, table["bits"].to_pylist(), sizes, _arrays(table), np.arange(len(ids)), None, percent):
            pass
        root = classes.roots(np.arange(len(ids)))
        out = pa.table([pa.array(ids, pa.binary()), pa.array([ids[i] for i in root], pa.binary())], names=["doc", "head"])
        others = pa.array((root != np.arange(len(ids))) | (not table["large"][0].as_py()))
        for name in ("component", "n", "bits", "hashes"):
            column = table[name].combine_chunks()
            out = out.append_column(name, column if name == "component" else pc.if_else(others, pa.scalar(None, column.type), column))
        return out

    return heads


def _met_links(percent: int):
    def links(table: pa.Table) -> pa.Table:
        """Links between classes, of the sets outside of the largest class with those of a tile."""
        labels, sizes, asks = table["label"].to_pylist(), table["n"].to_numpy().astype(np.int64), table["asks"].to_numpy(zero_copy_only=False)
        one, two = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = []
        if len(one) and len(two):
            found = list(_joins(Classes(len(labels), labels), table["bits"].to_pylist(), sizes, _arrays(table), one, two, percent))
        return pa.table([pa.array([labels[x] for x, _ in found], pa.binary()), pa.array([labels[y] for _, y in found], pa.binary())], names=["u", "v"])

    return links


def size_band(percent: int) -> Column:
    """Band of column n: sets that link are in one band or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int") if percent < 100 else F.col("n").cast("int")


_CLASSED = "doc binary, head binary, component binary, n long, bits binary, hashes binary"


def tile_classes(sets_: DataFrame, sizes: DataFrame, turn: int, percent: int) -> DataFrame:
    """Classes within tiles of each component, as _CLASSED; sets_: component, doc, n, bits, hashes; sizes: component, m."""
    tile = F.pmod(F.xxhash64("doc", F.lit(turn)), F.ceil(F.col("m") / BLOCK)).alias("tile")
    large = ((F.col("m") > BLOCK) | F.lit(turn > 0)).alias("large")
    tiles = sets_.join(sizes, "component").select("component", tile, large, "doc", "n", "bits", "hashes")
    return store(tiles.groupBy("component", "tile").applyInArrow(_heads(percent), _CLASSED), "tile-classes")


def large_group_classes(found: DataFrame, stand: DataFrame, percent: int) -> DataFrame:
    """(doc, label) of the sets of large groups: equal labels are linked, directly or through others of the group.

    found: the classes within their tiles; stand: doc, n, bits, hashes of all sets.
    """
    labels, heads, before = found.select("component", "doc", F.col("head").alias("label")), found.filter("doc = head").drop("head"), None
    for turn in range(1, ROUNDS + 1):
        sizes = heads.groupBy("component").agg(F.count("*").alias("m"))
        total, most = sizes.agg(F.sum("m"), F.max("m")).first()
        if not total or most == 1 or (before is not None and total > 0.9 * before):
            break
        before = total
        found = tile_classes(heads, sizes, turn, percent)
        heads = found.filter("doc = head").drop("head")
        labels = labels.join(found.select(F.col("doc").alias("label"), "head"), "label").select("component", "doc", F.col("head").alias("label"))
        labels = store(labels, "large-group-labels")
    sizes = labels.groupBy("component", "label").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("component").agg(F.max(F.struct("m", "label")).alias("top")).select("component", F.col("top.label").alias("top"))
    marked = labels.join(largest, "component").select("component", "doc", "label", (F.col("label") != F.col("top")).alias("stray"))
    # groups that are one class by now need no more
    open_ = marked.filter("stray").select("component").distinct()
    marked = store(marked.join(open_, "component", "left_semi"), "large-group-strays")
    if marked.isEmpty():
        return labels.select("doc", "label")
    facts = stand.select("doc", "n", "bits", "hashes", size_band(percent).alias("band"))
    sets_ = store(marked.join(facts, "doc"), "large-group-sets")
    # a band's sets are met by the strays of its own band and the one below, and by those of the one above for its sets that aren't strays
    tiles = sets_.groupBy("component", "band").agg(F.ceil(F.count("*") / BLOCK).alias("tiles"), F.min("stray").alias("all_stray"))
    below = (F.col("band") == F.col("own") - 1) & F.col("all_stray")
    asks = sets_.filter("stray").withColumnRenamed("band", "own").withColumn("band", F.explode(F.array(F.col("own") - 1, "own", F.col("own") + 1)))
    asks = asks.join(tiles, ["component", "band"]).filter(~below)
    ask_tiles = asks.groupBy("component", "band").agg(F.ceil(F.count("*") / BLOCK).alias("ask_tiles"))
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = sets_.join(tiles, ["component", "band"]).join(ask_tiles, ["component", "band"])
    held = held.select("component", "band", F.pmod(F.xxhash64("doc"), F.col("tiles")).alias("tile"), to_all("ask_tiles").alias("ask_tile"), "label", "n", "bits", "hashes", F.lit(False).alias("asks"))
    asks = asks.join(ask_tiles, ["component", "band"])
    asks = asks.select("component", "band", to_all("tiles").alias("tile"), F.pmod(F.xxhash64("doc"), F.col("ask_tiles")).alias("ask_tile"), "label", "n", "bits", "hashes", F.lit(True).alias("asks"))
    linked = held.unionByName(asks).groupBy("component", "band", "tile", "ask_tile").applyInArrow(_met_links(percent), "u binary, v binary")
    joined = components(linked)
    out = labels.join(joined, F.col("label") == F.col("node"), "left")
    return out.select("doc", F.coalesce(joined["component"], "label").alias("label"))


def ngram_jaccard(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents linked by 100 * intersection >= percent * union of their sets of word n-grams.

    docs: doc_id long, text string; other columns are ignored. Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z
    lower-cased; a text of fewer words than size has one n-gram, of all its words; without words (or null) it has none and
    links with nothing. Returns doc_id, n_shingles long, component_id long (the smallest doc_id that links
    reach, its own included), group_id binary (the same for all rows of a component; null without words) and text_hash long (xxhash64 of the text). Rows that repeat a doc_id keep their rows, each with the set and the links of its own text. A null doc_id stays null, in a component of its own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(repeat_filter(docs, lambda s: (shingles(s, size)[0], None), text_bytes(docs)))
    kind = "doc_id long, text_hash long, n_shingles long, class binary, keys binary, bits binary, hashes binary"

    def described(batches) -> Iterator[pa.RecordBatch]:
        """Every document's set size and digest; keys, bitmap and set of those that can link."""
        for batch in batches:
            ids, tags = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            for s in slices(batch.column("text")):
                rows = []
                for i, h in enumerate(sets(s, size)):
                    n = len(h)
                    digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest() if n else None
                    row = (ids[s.first + i], tags[s.first + i], n, digest, None, None, None)
                    if n:
                        shared = h[known.value.holds(h)]
                        left = prefix_length(n, percent) - (n - len(shared))
                        if left > 0:
                            row = (*row[:4], shared[:left].tobytes(), bitmap(h), h.tobytes())
                    rows.append(row)
                yield batch_of(rows, kind)

    described_ = store(docs.mapInArrow(described, kind), "shingle-sets")
    members = described_.select("doc_id", "text_hash", "n_shingles", "class")
    holders = described_.filter(F.col("keys").isNotNull() & F.col("doc_id").isNotNull())
    # one row stands for each distinct set, whichever documents have it
    stand = holders.select(F.col("class").alias("doc"), F.col("n_shingles").alias("n"), "keys", "bits", "hashes").dropDuplicates(["doc"])
    stand = store(stand, "candidates")

    def exploded(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("keys")]
            count = [len(x) for x in lists]
            docs_ = batch.column("doc").take(pa.array(np.repeat(np.arange(len(lists)), count)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)), docs_], names=["key", "doc"])

    keyed = stand.select("doc", "keys").mapInArrow(exploded, "key long, doc binary")
    # keys with the same documents make the same comparisons: the smallest of them stays
    members_of = [F.count("*").alias("m"), *(F.bit_xor(F.xxhash64("doc", F.lit(i))).alias(f"mark_{i}") for i in (1, 2))]
    met = keyed.groupBy("key").agg(*members_of).filter("m > 1")
    rows = keyed.join(met.groupBy("m", "mark_1", "mark_2").agg(F.min("key").alias("key")).select("key", "m"), "key")
    # a key of more sets than a tile holds is split by size bands: a cell has the sets of a band and the next
    banded = rows.filter(F.col("m") > BLOCK).select("key", "doc").join(stand.select("doc", size_band(percent).alias("band")), "doc")
    banded = store(banded.select("key", F.explode(F.array(F.col("band") - 1, "band")).alias("cell"), "doc"), "wide-keys")
    cells = banded.groupBy("key", "cell").agg(*members_of, F.min("doc").alias("low")).filter("m > 1")
    cells = cells.groupBy("m", "mark_1", "mark_2", "low").agg(F.min(F.struct("key", "cell")).alias("at")).select("at.key", "at.cell", "m", "low")
    banded = banded.join(cells, ["key", "cell"])
    narrow = rows.filter(F.col("m") <= BLOCK).select("key", F.lit(None).cast("int").alias("cell"), "doc")
    close = narrow.unionByName(banded.filter(F.col("m") <= BLOCK).select("key", "cell", "doc")).join(stand.select("doc", "n", "bits"), "doc")
    passed = close.groupBy("key", "cell").applyInArrow(_passing_links(percent), "u binary, v binary")
    # a cell that is still too full is one group without comparisons
    wide = banded.filter(F.col("m") > BLOCK).select(F.col("doc").alias("u"), F.col("low").alias("v"))
    groups = store(components(passed.unionByName(wide)), "candidate-groups")
    sized = groups.groupBy("component").agg(F.count("*").alias("m"))
    together = groups.select("component", F.col("node").alias("doc")).join(stand.select("doc", "n", "bits", "hashes"), "doc")
    found = tile_classes(together, sized, 0, percent)
    classes = found.select(F.col("doc").alias("class"), "head")
    if (sized.agg(F.max("m")).first()[0] or 0) > BLOCK:
        big = sized.filter(F.col("m") > BLOCK).select("component")
        large = large_group_classes(found.join(big, "component", "left_semi"), stand, percent)
        small = found.join(big, "component", "left_anti").select(F.col("doc").alias("class"), "head")
        classes = store(small.unionByName(large.select(F.col("doc").alias("class"), F.col("label").alias("head"))), "classes")
    # a set without candidates is a class of its own; the smallest doc_id of a class names it
    named_sets = members.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("least"))
    headed = named_sets.join(classes, "class", "left").withColumn("head", F.coalesce("head", "class"))
    several = headed.groupBy("head").agg(F.min("least").alias("component_id"))
    lookup = headed.join(several, "head").select("class", "component_id", F.col("head").alias("group_id"))
    out = members.join(lookup, "class", "left")
    named = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", named.alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("group_id")).alias("group_id"), "text_hash")


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_sides AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_sides JOIN sizes s ON x = s.doc_id JOIN sizes t ON y = t.doc_id WHERE 100 * m >= 80 * (s.n + t.n - m)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_id AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(y, w.doc_id)) AS component_id FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id ON w.doc_id = x"""
