"""Components of the whole typed graph."""

import os
from collections import Counter

import pytest

import evgraph.plans as plans

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@needs_tables
def test_components_cover_every_node(spark):
    from evgraph.plans import graph_plans

    c = plans.queries()["connected_components"](spark, DATA).collect()
    nodes = {r.node_type: r["count"] for r in graph_plans.all_nodes(spark, DATA).groupBy("node_type").count().collect()}
    assert {"order": sum(r.orders for r in c), "entity": sum(r.entities for r in c), "customer": sum(r.customers for r in c)} == nodes
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in graph_plans.all_nodes(spark, DATA).collect():
        root(f"{r.node_type}:{r.node_id}")
    for e in graph_plans.all_edges(spark, DATA).collect():
        parent[root(f"{e.source_type}:{e.source_id}")] = root(f"{e.target_type}:{e.target_id}")
    assert sorted(Counter(map(root, parent)).values()) == sorted(r.nodes for r in c)


def test_components_of_paths_stars_and_random_links(spark):
    import random

    from evgraph.operators import graph

    rng = random.Random(3)
    links = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("z", f"s{i}") for i in range(40)] + [(f"r{rng.randint(0, 90)}", f"r{rng.randint(0, 90)}") for _ in range(70)]
    links += [("a", "a"), ("b", None), ("p000", "p001"), ("p001", "p000")]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        if v is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    e = spark.createDataFrame(links, "u string, v string")
    assert {(r.node, r.component) for r in graph.components(e).collect()} == {(x, root(x)) for x in parent}
    assert graph.components(e.filter("u = v")).count() == 0


@needs_tables
def test_few_steps_meet_all_edges(spark, monkeypatch):
    """Edges are written as often as they are met: twice as many as the graph has at most, in all rounds."""
    from evgraph.operators import graph
    from evgraph.plans import graph_plans

    sizes, write = [], graph.written

    def counting(df, name):
        out = write(df, name)
        if name == "links":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counting)
    e = graph_plans.all_edges(spark, DATA).selectExpr("concat(source_type, source_id) as u", "concat(target_type, target_id) as v")
    graph.components(e)
    assert sum(sizes) <= 2 * e.count()
