"""Skip-gram vectors are trained where walks lie: no table of all nodes on the driver."""

import numpy as np

from evgraph.operators import embeddings
from evgraph.plans import graph_plans


def _walks(spark, n=600):
    """Walks within two groups of ten nodes, and a node that is alone in its walk."""
    rng = np.random.default_rng(0)
    rows = [(f"w{i}", [f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 10, 8)]) for i in range(n)]
    return spark.createDataFrame([*rows, ("alone", ["c"])], "walk_id string, path array<string>")


def test_nodes_of_a_group_lie_together_and_every_node_has_a_vector(spark):
    w = _walks(spark)
    got = {r["node"]: np.array(r["vector"]) for r in embeddings.skip_gram(w, per_task=100).collect()}
    assert set(got) == {f"{g}{k}" for g in "ab" for k in range(10)} | {"c"} and {len(v) for v in got.values()} == {16}
    np.testing.assert_allclose(got["c"], embeddings.first_vectors(["c"], 16, 1)[0], atol=1e-6)
    cos = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    within = np.mean([cos(got[f"{g}{i}"], got[f"{g}{j}"]) for g in "ab" for i in range(10) for j in range(i)])
    across = np.mean([cos(got[f"a{i}"], got[f"b{j}"]) for i in range(10) for j in range(10)])
    assert within > across + 0.3
    again = {r["node"]: r["vector"] for r in embeddings.skip_gram(w.repartition(7), per_task=100).collect()}
    assert all(np.allclose(got[k], v) for k, v in again.items())


def test_walks_without_rows_give_no_vectors(spark):
    assert embeddings.skip_gram(_walks(spark, 0).filter("walk_id = 'no'")).count() == 0


def test_vectors_are_not_a_table_of_the_driver(spark):
    for query in (graph_plans.walk_vectors, graph_plans.typed_walk_vectors):
        df = query(spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LocalRelation" not in plan and "LogicalRDD" not in plan and df.dtypes == [("node", "string"), ("vector", "array<double>")]
        assert df.count() == graph_plans.typed_nodes(spark, "/root/testdata/sf0.001").count()
