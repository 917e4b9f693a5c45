"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

A document's place on the ring is the hash of its doc_id; the ring has 2**cell_bits cells and every
shard owns virtual nodes at cell borders. Documents enter in ring order: each goes to the next virtual
node clockwise whose shard isn't full. As entry is in ring order, what an arc between two nodes sends to
a shard is one range of ranks, so the walk needs only the document count of each arc: at
most shards * vnodes numbers on the driver, however many documents there are.
"""

from __future__ import annotations

import json
from hashlib import blake2b

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ring(n_shards: int, vnodes: int, cell_bits: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in ring order; of two nodes at a cell the lower shard stays."""
    nodes: dict[int, int] = {}
    for shard in range(n_shards):
        for replica in range(vnodes):
            digest = blake2b(f"{shard}/{replica}".encode(), digest_size=8).digest()
            nodes.setdefault(int.from_bytes(digest, "big") >> (64 - cell_bits), shard)
    return sorted(nodes.items())


def capacities(total: int, n_shards: int, slack: float) -> list[int]:
    """Most rows of each shard. Without slack they add up to total and differ by one at most."""
    if slack:
        return [-(-int(total * (1 + slack)) // n_shards) + 1] * n_shards
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def fill(nodes: list[tuple[int, int]], counts: dict[int, int], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, slot of the first) of the ranges that go to one shard."""
    load, out = [0] * len(caps), []
    for arc in range(len(nodes)):
        at, left, node = 0, counts.get(arc, 0), arc
        while left:
            shard = nodes[node % len(nodes)][1]
            if take := min(left, caps[shard] - load[shard]):
                out.append((arc, at, at + take, shard, load[shard]))
                load[shard] += take
                at, left = at + take, left - take
            node += 1
    return out


def _table(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of longs, as a literal."""
    kind = "array<struct<" + ",".join(f"{n}:bigint" for n in names) + ">>"
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), kind)).alias("x")).select("x.*")


def ring_shards(docs: DataFrame, n_shards: int = 8, vnodes: int = 128, cell_bits: int = 16, slack: float = 0.0) -> DataFrame:
    """Put every document into one of n_shards shards; no shard holds more than (1 + slack) times the mean.

    With slack 0 row counts differ by one at most. docs: doc_id long, text string; others are ignored.
    Returns doc_id, size long (UTF-8 bytes of the text, none if null, plus 1), text_crc32 long (0 for null as for
    empty), shard int, slot long (gapless from 0 in each shard). Null doc_ids share one place of the ring; rows that
    repeat a doc_id lie side by side there, and equal rows may swap slots. An empty table gives no rows.
    """
    spark = docs.sparkSession
    nodes = ring(n_shards, vnodes, cell_bits)
    place = F.xxhash64(F.col("doc_id").cast("long"))
    cell = F.shiftrightunsigned(place, 64 - cell_bits)

    # arc k ends at node k; cells behind the last node belong to the first
    borders = [(0 if i == 0 else nodes[i - 1][0] + 1, c, i) for i, (c, _) in enumerate(nodes)] + [(nodes[-1][0] + 1, (1 << cell_bits) - 1, 0)]
    borders = [b for b in borders if b[0] <= b[1]]
    arcs = _table(spark, borders, ["low", "high", "arc"]).select("arc", F.explode(F.sequence("low", "high")).alias("cell"))
    filled = docs.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # at most 2**cell_bits rows, whatever the input
    cells = filled.join(F.broadcast(arcs), "cell").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r.arc: r.n for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    ranges = _table(spark, fill(nodes, counts, capacities(sum(counts.values()), n_shards, slack)), ["arc", "from_rank", "to_rank", "shard", "slot0"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), cell.alias("cell"), place.alias("place")
    )
    in_cell = Window.partitionBy("cell").orderBy("place", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(in_cell).cast("long") - 1)
    ranked = ranked.join(F.broadcast(cells.select("cell", "arc", "before")), "cell").withColumn("rank", F.col("rank") + F.col("before"))
    held = (ranked["arc"] == ranges["arc"]) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    placed = ranked.join(F.broadcast(ranges), held)
    return placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("slot0") + F.col("rank") - F.col("from_rank")).alias("slot"))


def op10_ring_sharding(spark, sf_dir: str) -> DataFrame:
    shards = ring_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
