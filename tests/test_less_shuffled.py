"""Counts of triples and lines of edges whose repeats don't count, against the plain way."""

import os

import pytest
from pyspark.sql import functions as F

from evgraph.operators import dataset, graph, structure, walks


def test_triple_counts_are_those_of_numbered_triples_both_ways(spark):
    rows = [("likes", "a", "1", "b", "1"), ("likes", "a", "1", "b", "1"), ("likes", "a", "2", "b", "1"), ("likes", "a", "2", "b", "2"), ("knows", "a", "1", "a", "2"), ("knows", "a", "1", "a", "1")]
    e = spark.createDataFrame(rows, "relation string, source_type string, source_id string, target_type string, target_id string")
    n = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("b", "3")], "node_type string, node_id string")
    both = dataset.both_ways(e)
    t = dataset.triples(both, graph.index(n, ["node_id"]).select("node_type", "node_id", "node_idx"))
    want = t.groupBy("relation_idx").agg(F.count("*").alias("triples"), F.count_distinct("head").alias("heads"), F.count_distinct("tail").alias("tails")).join(dataset.relation_index(both), "relation_idx")
    got = dataset.triple_counts(e, n)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for missing in ("b", "a"):
        with pytest.raises(Exception, match="edge without a node"):
            dataset.triple_counts(e, n.filter(f"node_type <> '{missing}' or node_id <> '1'")).collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 0


@pytest.mark.parametrize("wide", [4096, 8])
def test_repeated_edges_of_a_metapath_count_once_without_a_shuffle_of_their_own(spark, wide):
    e = spark.range(400).selectExpr("concat('s', id % 3) as src", "concat('d', id % 50) as dst").unionByName(spark.range(60).selectExpr("concat('s', id % 2) as src", "'d1' as dst"))
    starts = spark.range(3).selectExpr("concat('s', id) as node")
    got, want = ({tuple(r) for r in walks.metapath_walks([x], starts, per_node=30, seed=2, wide=wide).selectExpr("walk_id", "concat_ws('>', path)").collect()} for x in (e, e.distinct()))
    assert got == want and len(got) == 90


def test_tables_of_old_steps_are_deleted(spark):
    e = spark.range(60).selectExpr("id % 10 as src", "(id * 7 + 3) % 10 as dst", "1.0 as weight").unionByName(spark.createDataFrame([(3, 99, 5.0)], "src long, dst long, weight double"))
    starts = spark.range(11).selectExpr("id as node")  # 10 and 99 have no edges
    folder = graph.shared_folder(spark)
    before = set(os.listdir(folder))
    w = walks.biased_walks(e, starts, 7, per_node=20, back=2.0, out=0.5, seed=1)
    got = {r["walk_id"]: r["path"] for r in w.collect()}
    assert len(got) == 220 and all(p[0] == int(i.split("#")[0]) for i, p in got.items())
    assert all(got[f"10#{r}"] == [10] for r in range(20)) and all(len(p) == 7 or p[-1] in (10, 99) for p in got.values())
    # a first round and one of repeats or two in the last step; before: those of all six steps
    assert len([f for f in set(os.listdir(folder)) - before if f.startswith("walks-") and not f.startswith("walks-ended")]) <= 5


def test_node_structure_shuffles_edges_once(spark):
    links = spark.createDataFrame(
        [("1", "x", "2", "y", 2001, 2.0, "t"), ("1", "x", "2", "y", 2000, 1.0, "u"), ("1", "x", "3", "z", 2002, None, "t"), ("9", "x", "1", "y", 2003, 1.0, "t"), ("1", "x", "1", "x", 2000, 1.0, "t"), ("1", "x", "4", "y", None, 1.0, "t")],
        "source_id string, source_kind string, target_id string, target_kind string, year int, weight double, edge_type string",
    )
    carriers, cutoffs = spark.createDataFrame([("1",), ("2",)], "carrier_id string"), spark.createDataFrame([(2000,), (2002,)], "cutoff int")
    out = structure.node_structure(structure.carrier_edges(links, carriers, ["x", "y"]), cutoffs, ["x", "y"])
    # edges and carriers; before: more for each kind of count
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") <= 2
    got = {(r["node_id"], r["cutoff"]): [r[m] for m in structure.metrics(["x", "y"])] for r in out.collect()}
    assert got == {
        ("1", 2000): [1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 0.0], ("1", 2002): [3.0, 4.0, 2.0, 2.0, 0.0, 2.0, 1.0],
        ("2", 2000): [1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0], ("2", 2002): [2.0, 3.0, 1.0, 2.0, 2.0, 0.0, 0.0],
    }
