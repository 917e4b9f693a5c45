"""A graph as a dataset: edges brought to one form of ends, relations with numbers, triples, counts, and metapaths by node types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evgraph.operators import graph
from evgraph.operators.audit import union_all

# fixed values: names under which edge tables give their typed ends, the first one that exists wins
END_NAMES = {
    "source_type": ["source_type", "src_type", "head_type", "from_type", "source_node_type"],
    "source_id": ["source_id", "src_id", "head_id", "from_id", "source_node_id"],
    "target_type": ["target_type", "dst_type", "tail_type", "to_type", "target_node_type"],
    "target_id": ["target_id", "dst_id", "tail_id", "to_id", "target_node_id"],
}
INDEX_NAMES = ("source_index", "target_index")
UNMAPPED = ("error", "drop")
REVERSED = "__rev"

EdgeType = tuple[str, str, str]


def node_table(n: DataFrame) -> DataFrame:
    """Nodes with node_type and node_id as text, each once; the least value of every other column stays. Rows without a type or id are left out."""
    missing = [c for c in ("node_type", "node_id") if c not in n.columns]
    if missing:
        raise ValueError(f"node table lacks {', '.join(missing)}")
    keys = [F.col(c).cast("string").alias(c) for c in ("node_type", "node_id")]
    rest = [c for c in n.columns if c not in ("node_type", "node_id")]
    return n.select(*keys, *rest).dropna(subset=["node_type", "node_id"]).groupBy("node_type", "node_id").agg(F.count("*").alias("__n"), *(F.min(c).alias(c) for c in rest)).drop("__n")


def _mapped(e: DataFrame, lookups: list[tuple[DataFrame, list[str]]], unmapped: str, named: Column) -> DataFrame:
    """e joined with each lookup on its keys; an edge that finds no partner in one is dropped, or makes the job fail."""
    if unmapped not in UNMAPPED:
        raise ValueError(f"unmapped must be one of {', '.join(UNMAPPED)}")
    for rows, on in lookups:
        if unmapped == "drop":
            e = e.join(rows, on)
        else:
            found = rows.withColumn("__found", F.lit(True))
            e = e.join(found, on, "left")
            # the error is in the column that the lookup adds: only a query that reads no ends passes over it
            kept = next(c for c in rows.columns if c not in on)
            e = e.withColumn(kept, F.when(F.col("__found"), F.col(kept)).otherwise(F.raise_error(F.concat(F.lit("edge without a node: "), named)))).drop("__found")
    return e


def typed_ends(e: DataFrame, nodes: DataFrame, unmapped: str = "error") -> DataFrame:
    """Edges with source_type, source_id, target_type and target_id as text, whichever way they name their ends; other columns stay.

    Typed ends under any of END_NAMES are renamed and taken as they are. Otherwise source_index and target_index are looked up in nodes (node_type, node_id, node_index):
    an index that no node has, or a null one, makes the job fail ("error") or the edge go ("drop"). A table with neither is refused. An index that several nodes have
    is refused by the job under both settings.
    """
    found = {role: next((c for c in names if c in e.columns), None) for role, names in END_NAMES.items()}
    if all(found.values()):
        roles = {c: role for role, c in found.items()}
        return e.select(*(F.col(c).cast("string").alias(roles[c]) if c in roles else F.col(c) for c in e.columns))
    if not all(c in e.columns for c in INDEX_NAMES) or "node_index" not in nodes.columns:
        lacking = sorted(role for role, c in found.items() if c is None)
        raise ValueError(f"edge table lacks {', '.join(lacking)}; source_index and target_index with nodes that have node_index would do too")
    once = nodes.dropna(subset=["node_index"]).groupBy("node_index").agg(
        F.min(F.struct(F.col("node_type").cast("string").alias("t"), F.col("node_id").cast("string").alias("i"))).alias("end"), F.count_distinct("node_type", "node_id").alias("n")
    )
    end = F.when(F.col("n") == 1, F.col("end")).otherwise(F.raise_error(F.concat(F.lit("node_index of several nodes: "), F.col("node_index").cast("string"))))
    sides = [(once.select(F.col("node_index").alias(c), end.alias(f"__{c}")), [c]) for c in INDEX_NAMES]
    named = F.concat_ws(" to ", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in INDEX_NAMES))
    rest = [c for c in e.columns if c not in {*found.values(), *INDEX_NAMES}]
    ends = [F.col(f"__{c}.{f}").alias(f"{side}_{name}") for c, side in zip(INDEX_NAMES, ("source", "target")) for f, name in (("t", "type"), ("i", "id"))]
    return _mapped(e, sides, unmapped, named).select(*ends, *rest)


def indexed_ends(e: DataFrame, index: DataFrame, unmapped: str = "error") -> DataFrame:
    """Edges with typed ends, and source_idx and target_idx of the nodes (node_type, node_id, node_idx) that they name; unmapped as in typed_ends."""
    named = F.concat_ws(" to ", F.concat_ws(":", "source_type", "source_id"), F.concat_ws(":", "target_type", "target_id"))
    sides = [(index.select(F.col("node_type").alias(f"{s}_type"), F.col("node_id").alias(f"{s}_id"), F.col("node_idx").alias(f"{s}_idx")), [f"{s}_type", f"{s}_id"]) for s in ("source", "target")]
    return _mapped(e, sides, unmapped, named)


def with_relation(e: DataFrame, default: str = "context") -> DataFrame:
    """Edges with a relation: the column of that name, else edge_type, else edge_table, else the default."""
    name = next((c for c in ("relation", "edge_type", "edge_table") if c in e.columns), None)
    return e.withColumn("relation", F.col(name).cast("string") if name else F.lit(default))


def labeled_ends(e: DataFrame, nodes: DataFrame, unmapped: str = "error") -> DataFrame:
    """Labelled edges with typed ends, split as text and label as a number; a table without split or label is refused."""
    missing = [c for c in ("label", "split") if c not in e.columns]
    if missing:
        raise ValueError(f"labelled edges lack {', '.join(missing)}")
    return typed_ends(e, nodes, unmapped).withColumn("split", F.col("split").cast("string")).withColumn("label", F.col("label").cast("int"))


def both_ways(e: DataFrame) -> DataFrame:
    """Typed edges and their reverses, whose relation ends in __rev."""
    ends = ["relation", "source_type", "source_id", "target_type", "target_id"]
    swap = {"relation": F.concat("relation", F.lit(REVERSED))} | {f"{a}_{x}": F.col(f"{b}_{x}") for a, b in (("source", "target"), ("target", "source")) for x in ("type", "id")}
    return e.select(*ends).unionByName(e.select(*(swap[c].alias(c) for c in ends)))


def relation_index(e: DataFrame) -> DataFrame:
    """relation, relation_idx: numbers from 0 in order of the names. The window spans the distinct relations, a handful in any graph."""
    return e.select("relation").distinct().withColumn("relation_idx", (F.row_number().over(Window.orderBy("relation")) - 1).cast("int"))


def triples(e: DataFrame, index: DataFrame, unmapped: str = "error") -> DataFrame:
    """Distinct (head, relation_idx, tail) of typed edges with a relation; heads and tails are numbers of the index (node_type, node_id, node_idx)."""
    numbered = indexed_ends(e.select("relation", "source_type", "source_id", "target_type", "target_id").distinct(), index, unmapped)
    return numbered.join(relation_index(e), "relation").select(F.col("source_idx").alias("head"), "relation_idx", F.col("target_idx").alias("tail")).distinct()


def triple_counts(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """relation_idx, triples, heads, tails, relation of the distinct triples of typed edges both ways, without their reverses.

    nodes: node_type, node_id, each once, so that they could be numbered one to one: triples are counted by name, under one shuffle by their source, and only the distinct ends meet
    the nodes. A reversed relation has the counts of its own with heads and tails changed round. An edge without a node makes the job fail, as in `triples`.
    """
    ends = ["source_type", "source_id"]
    rows = e.select("relation", "source_type", "source_id", "target_type", "target_id")
    known = nodes.select("node_type", "node_id", F.lit(True).alias("__found"))
    n = F.when(F.col("__found"), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("edge without a node: "), F.concat_ws(":", "type", "id"))))
    met = lambda df, side: df.select("relation", F.col(f"{side}_type").alias("type"), F.col(f"{side}_id").alias("id"), "n").join(
        known.select(F.col("node_type").alias("type"), F.col("node_id").alias("id"), "__found"), ["type", "id"], "left"
    )
    # the shuffle by source serves the distinct triples, those of a source, and the source's own look-up
    heads = rows.repartition(*ends).distinct().groupBy(*ends, "relation").agg(F.count("*").alias("n"))
    tails = rows.groupBy("target_type", "target_id", "relation").agg(F.count("*").alias("n"))
    left = met(heads, "source").groupBy("relation").agg(F.sum(n).alias("triples"), F.count("*").alias("heads"))
    right = met(tails, "target").groupBy("relation").agg(F.count("*").alias("tails"), F.sum(n).alias("rows"))
    both = left.join(F.broadcast(right), "relation").filter(F.col("rows") > 0)
    back = F.struct(F.concat("relation", F.lit(REVERSED)).alias("relation"), "triples", F.col("tails").alias("heads"), F.col("heads").alias("tails"))
    each = both.select(F.explode(F.array(F.struct("relation", "triples", "heads", "tails"), back)).alias("x")).select("x.*")
    # a row for each relation, a handful in any graph
    return each.withColumn("relation_idx", (F.row_number().over(Window.orderBy("relation")) - 1).cast("int")).select("relation_idx", "triples", "heads", "tails", "relation")


def summary(nodes: DataFrame, e: DataFrame, labeled: DataFrame) -> DataFrame:
    """item, part, n: a dataset's counts in long form.

    nodes: node_type. e: typed edges with a relation. labeled: split, label. Items: nodes, edges and pairs of relation and end types, distinct triples with the reverses, relations,
    and labelled, positive and negative edges; part is the type, relation or split, or "all". One pass over each table; empty tables leave zeros for "all".
    """
    typed = F.concat_ws("|", "source_type", "relation", "target_type")
    # a reversed edge is a triple of its own, so triples both ways are twice the distinct ones
    distinct = e.select("relation", "source_type", "source_id", "target_type", "target_id").distinct()
    n = F.count("*").alias("n")
    total = lambda df, item, count=F.count("*"): df.agg(F.coalesce(count, F.lit(0)).cast("long").alias("n")).select(F.lit(item).alias("item"), F.lit("all").alias("part"), "n")
    by = lambda df, item, part: df.groupBy(part.alias("part")).agg(n).select(F.lit(item).alias("item"), "part", "n")
    counted = graph.written(e.groupBy("relation", typed.alias("edge_type")).agg(n), "edge-counts")
    rolled = lambda item, part: counted.groupBy(F.col(part).alias("part")).agg(F.sum("n").alias("n")).select(F.lit(item).alias("item"), "part", "n")
    splits = [(item, F.sum(x)) for item, x in (("labeled_edges", F.lit(1)), ("positive_edges", F.col("label")), ("negative_edges", 1 - F.col("label")))]
    marked = labeled.groupBy("split").agg(*(x.cast("long").alias(item) for item, x in splits)).unpivot("split", [i for i, _ in splits], "item", "n").select("item", F.col("split").alias("part"), "n")
    return union_all([
        by(nodes, "nodes", F.col("node_type")), total(nodes, "nodes"), total(nodes, "node_types", F.count_distinct("node_type")),
        rolled("edges", "relation"), rolled("edge_types", "edge_type"), total(counted, "edges", F.sum("n")), total(counted, "relations", F.count_distinct("relation")),
        total(distinct, "triples_both_ways", 2 * F.count("*")), marked,
    ])


def edge_types(e: DataFrame) -> list[EdgeType]:
    """The distinct (source type, relation, target type), sorted; there are as many rows as the graph's schema has edge types."""
    return sorted(tuple(r) for r in e.select("source_type", "relation", "target_type").distinct().collect())


def step_between(types: list[EdgeType], source: str, target: str, forward: bool = True) -> EdgeType:
    """The first edge type from one node type to another by name; with `forward`, a reversed one only if there is no other."""
    fit = sorted(t for t in types if t[0] == source and t[2] == target)
    if not fit:
        raise ValueError(f"no edge type leads from {source} to {target}")
    return next((t for t in fit if not t[1].endswith(REVERSED)), fit[0]) if forward else fit[0]


def bridge(types: list[EdgeType], source: str, through: str, target: str) -> list[EdgeType]:
    """The metapath from a source type through a bridge to a target type, and the same way back."""
    out = [step_between(types, source, through), step_between(types, through, target, False), step_between(types, target, through), step_between(types, through, source, False)]
    return checked_metapath(out, types)


def checked_metapath(path: list[EdgeType], types: list[EdgeType]) -> list[EdgeType]:
    """The metapath, if it has steps, all of them are edge types of the graph and each begins at the type where the one before ended."""
    if not path:
        raise ValueError("a metapath has one edge type or more")
    strange = [t for t in path if tuple(t) not in set(types)]
    if strange:
        raise ValueError(f"edge types that the graph lacks: {', '.join('|'.join(t) for t in strange)}")
    for a, b in zip(path, path[1:]):
        if a[2] != b[0]:
            raise ValueError(f"not connected: {'|'.join(a)} then {'|'.join(b)}")
    return [tuple(t) for t in path]


def metapath_steps(e: DataFrame, path: list[EdgeType]) -> list[DataFrame]:
    """For each step of a metapath the (src, dst) of its edges, named type:id."""
    name = lambda side: F.concat_ws(":", f"{side}_type", f"{side}_id")
    return [e.filter((F.col("source_type") == a) & (F.col("relation") == r) & (F.col("target_type") == b)).select(name("source").alias("src"), name("target").alias("dst")) for a, r, b in path]
