"""Typed graphs: nodes and edges from tables, degrees, filters, expansion, indices, components, walks and flux."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.functions import expr
from evgraph.operators import joins


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session that has none gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: an iterative operator's lineage ends here. Its path is added to `paths`."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that `written` made, once all that reads them is written itself."""
    sc = spark.sparkContext
    for path in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def nodes(df: DataFrame, node_type: str, node_id: Column, labels: list[Column], entity_type: Column | None = None) -> DataFrame:
    """One row for each id: node_type, node_id, label (first that isn't blank, else the id), entity_type."""
    kind = entity_type if entity_type is not None else F.lit(None).cast("string")
    rows = df.select(F.lit(node_type).alias("node_type"), expr.key(node_id).alias("node_id"), expr.label(*labels, node_id).alias("label"), kind.alias("entity_type"))
    return rows.filter(F.col("node_id").isNotNull()).groupBy("node_type", "node_id").agg(F.min("label").alias("label"), F.min("entity_type").alias("entity_type"))


def edges(df: DataFrame, edge_type: str, source: tuple[str, Column], target: tuple[str, Column], weight: Column | None = None) -> DataFrame:
    """Edge rows with typed ends; a weight that doesn't read as a number is 1."""
    return df.select(
        F.lit(edge_type).alias("edge_type"), F.lit(source[0]).alias("source_type"), expr.key(source[1]).alias("source_id"),
        F.lit(target[0]).alias("target_type"), expr.key(target[1]).alias("target_id"), expr.number(weight, default=1.0).alias("weight") if weight is not None else F.lit(1.0).alias("weight"),
    )


def degrees(e: DataFrame) -> DataFrame:
    """Out, in and total degree of each node, plain and weighted, and how many edge types touch it: one shuffle of both ends."""
    out = e.select(F.col("source_type").alias("node_type"), F.col("source_id").alias("node_id"), "edge_type", "weight", F.lit(1).alias("o"))
    into = e.select(F.col("target_type").alias("node_type"), F.col("target_id").alias("node_id"), "edge_type", "weight", F.lit(0).alias("o"))
    ends = out.unionAll(into)
    return ends.groupBy("node_type", "node_id").agg(
        F.sum("o").cast("bigint").alias("out_degree"), F.sum(1 - F.col("o")).cast("bigint").alias("in_degree"), F.count("*").alias("degree"),
        F.round(F.sum(F.col("weight") * F.col("o")), 6).alias("out_weight"), F.round(F.sum(F.col("weight") * (1 - F.col("o"))), 6).alias("in_weight"), F.count_distinct("edge_type").alias("edge_types"),
    )


def without_isolated(n: DataFrame, e: DataFrame) -> DataFrame:
    """Nodes that an edge touches."""
    touched = e.select(F.col("source_type").alias("node_type"), F.col("source_id").alias("node_id")).union(e.select("target_type", "target_id"))
    return n.join(touched, ["node_type", "node_id"], "left_semi")


def expand(seeds: DataFrame, links: DataFrame, seed_key: str, other_key: str, known: DataFrame, known_key: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) one hop from the seeds: links of seeds whose other end is known, and those ends once each."""
    kept = joins.keep_known(joins.keep_known(links, seed_key, seeds, seed_key), other_key, known, known_key)
    return known.join(kept.select(F.col(other_key).alias(known_key)), known_key, "left_semi"), kept


def index(n: DataFrame, by: list[str], buckets: int = 64) -> DataFrame:
    """A dense number for every row in order of `by`, within all rows (node_idx) and within its type (type_idx).

    Rows are ranked within (type, hash bucket of the id) and offset by the counts of the groups before: no window spans the
    table. The order is by type, then bucket, then id.
    """
    cut = F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")
    rows = n.withColumn("cut", cut)
    sizes = rows.groupBy("node_type", "cut").agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("base", before(Window.orderBy("node_type", "cut"))).withColumn("type_base", before(Window.partitionBy("node_type").orderBy("cut")))
    place = F.row_number().over(Window.partitionBy("node_type", "cut").orderBy(*by)) - 1
    return rows.withColumn("place", place).join(F.broadcast(sizes.drop("n")), ["node_type", "cut"]).withColumn("node_idx", F.col("base") + F.col("place")).withColumn("type_idx", F.col("type_base") + F.col("place")).drop("cut", "place", "base", "type_base")


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _relabelled(e: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between the labels (node, label) of their ends, each once, written; those within a label vanish."""
    out = e.join(labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v")
    return written(out.filter("lu <> lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct(), "links")


def _contracted(e: DataFrame) -> DataFrame | None:
    """(node, label) for the nodes of edges (u, v) of numbers, one label for each component; None without edges.

    In a round every node goes to that of itself and its neighbours with the least hash of the round, and edges follow their ends: a share of the nodes vanishes, whatever the graph's shape.
    """
    moves = []
    while not e.isEmpty():
        rank = lambda c: F.xxhash64(F.lit(len(moves)), c)
        near = _both_ways(e).groupBy("u").agg(F.min(rank("v")).alias("least"), F.min_by("v", rank("v")).alias("v"))
        moves.append(written(near.select(F.col("u").alias("node"), F.when(rank("u") < F.col("least"), F.col("u")).otherwise(F.col("v")).alias("label")), "moves"))
        e = _relabelled(e, moves[-1])
    labels = None
    for m in reversed(moves):
        if labels is not None:
            m = written(m.join(labels.select(F.col("node").alias("label"), F.col("label").alias("end")), "label", "left").select("node", F.coalesce("end", "label").alias("label")), "labels")
        labels = m
    return labels


def components(e: DataFrame) -> DataFrame:
    """(node, component) by the smallest node reachable, for undirected edges (u, v).

    Nodes are numbered by 64-bit hashes that are checked to differ. Components of two edges a node, those to its neighbours of least and greatest number, are found first; under their labels
    nearly all other edges vanish, so that only a few steps meet all edges, and the rounds work on less than nodes.
    """
    e, seed = e.select("u", "v").filter("u <> v"), 0
    ends = written(e.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "ends")
    n = ends.count()
    number = lambda c: F.xxhash64(F.lit(seed), c)
    while ends.select(number("node")).distinct().count() < n:
        seed += 1
    numbered = written(e.select(number("u").alias("u"), number("v").alias("v")), "links")
    few = _both_ways(numbered).groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    labels = _contracted(written(few.select("u", F.explode(F.array("low", "high")).alias("v")), "links"))
    if labels is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    more = _contracted(_relabelled(numbered, labels))
    if more is not None:
        labels = labels.join(more.select(F.col("node").alias("label"), F.col("label").alias("end")), "label", "left").select("node", F.coalesce("end", "label").alias("label"))
    named = written(ends.withColumn("id", number("node")).join(labels.withColumnRenamed("node", "id"), "id").select("node", "label"), "labels")
    least = written(named.groupBy("label").agg(F.min("node").alias("component")), "components")
    return named.join(least, "label").select("node", "component")


def flux(e: DataFrame, state: DataFrame, column: str) -> DataFrame:
    """One diffusion step: for each dst the weighted sum of (u_src - u_dst), over the sum of its weights."""
    a = e.join(state.select(F.col("node").alias("src"), F.col(column).alias("us")), "src")
    b = a.join(state.select(F.col("node").alias("dst"), F.col(column).alias("ud")), "dst")
    return b.groupBy(F.col("dst").alias("node")).agg(F.round(F.sum(F.col("weight") * (F.col("us") - F.col("ud"))) / F.sum("weight"), 6).alias("flux"))


def neighbour_mean(e: DataFrame, state: DataFrame, column: str, self_loops: bool = False) -> DataFrame:
    """Weighted mean of the neighbours' state; with self_loops a node counts itself with weight 1."""
    rows = e.select("src", "dst", "weight")
    if self_loops:
        rows = rows.union(state.select(F.col("node"), F.col("node"), F.lit(1.0)))
    joined = rows.join(state.select(F.col("node").alias("src"), F.col(column).alias("u")), "src")
    return joined.groupBy(F.col("dst").alias("node")).agg(F.round(F.sum(F.col("weight") * F.col("u")) / F.sum("weight"), 6).alias("mean"))
