"""Neighbourhoods of the unit graph, made and summed up where an entity's units lie, against the edges' own sums."""

import random

import pytest
from pyspark.sql import functions as F

from evgraph.operators import forecast, graph, neighbourhoods, structure


def made(spark, seed):
    """Units with twins, entities of equal degrees, and units without a state at some cutoffs."""
    rng = random.Random(seed)
    rows = [(f"u{i:03d}", f"a{rng.randint(0, 7)}", f"b{rng.randint(0, 7)}") for i in range(150)] + [("s1", "b1", "a1"), ("lone", "x", "y")]
    units = spark.createDataFrame(rows, "unit_id string, entity_a string, entity_b string")
    seen = [(u, c, *(float(rng.choice([0, 0, 1, 2, 5, 9])) for _ in structure.STATES)) for u, _, _ in rows for c in (1996, 1998) if rng.random() < 0.8]
    state = spark.createDataFrame(seen, "unit_id string, cutoff int, " + ", ".join(f"{s} double" for s in structure.STATES))
    return units, state


def table(df):
    return {tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df.collect()}


@pytest.mark.parametrize("bounds", [(2, 2000, 3), (2, 2000, 30), (2, 2000, 100), (15, 25, 10)])
def test_sums_are_those_of_the_edges(spark, bounds):
    units, state = made(spark, bounds[2])
    edges = forecast.shared_entity_edges(units, *bounds)
    two = ["history_total", "recent_total"]
    got = neighbourhoods.neighbour_state(neighbourhoods.pooled(units, state, [1996, 1998], two, bounds), state, two)
    want = forecast.neighbour_state(edges, state, two)
    assert table(got.select(want.columns)) == table(want) and want.count() > 100
    active = state.filter(structure.is_active())
    got = structure.diffusion_sums(neighbourhoods.pooled(units, active, [1996, 1998], list(structure.STATES), bounds, tops=list(structure.TOP)))
    assert table(got) == table(structure.diffusion_features(edges, state))
    last, e = state.filter("cutoff = 1998"), edges.select("src", "dst", F.col("edge_weight").alias("weight"))
    into, nodes = neighbourhoods.pooled(units, last, [1998], ["history_total"], bounds, incoming=True), last.select(F.col("unit_id").alias("node"), "history_total")
    assert table(neighbourhoods.flux(into, last, "history_total")) == table(graph.flux(e, nodes, "history_total"))
    assert table(neighbourhoods.neighbour_mean(into, last, "history_total")) == table(graph.neighbour_mean(e, nodes, "history_total", self_loops=True))


def test_no_edge_is_shuffled(spark):
    units, state = made(spark, 1)
    for df in (forecast.top_shared_entity_edges(units, 2, 2000, 100), neighbourhoods.pooled(units, state, [1996], ["history_total"], (2, 2000, 100))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(src" not in plan and "Window [row_number() windowspecdefinition(src" not in plan
