"""Ties, nulls, hubs and empty tables on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from evgraph.functions import expr
from evgraph.operators import graph, joins, links, metrics, panel, units, walks
from evgraph.sources import tables


def one(spark, **columns):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))


def test_years(spark):
    df = spark.createDataFrame([("2018",), ("2018.0",), ("2018-03-15",), ("March 2018",), ("",), ("nan",), ("99999",)], "y string")
    assert [r[0] for r in df.select(expr.year(F.col("y"))).collect()] == [2018, 2018, 2018, 2018, None, None, None]
    assert one(spark, y="in 1999 or 2001").select(expr.year_in_text(F.col("y"))).first()[0] == 1999


def test_keys(spark):
    df = spark.createDataFrame([(" a ",), ("  ",), (None,), ("CUI-less",)], "k string")
    assert [r[0] for r in df.select(expr.key(F.col("k"))).collect()] == ["a", None, None, "CUI-less"]
    assert [r[0] for r in df.select(expr.grounded(F.col("k"))).collect()] == [True, False, False, False]


def test_orientation(spark):
    df = spark.createDataFrame([("x", "y", "2", "1"), ("y", "x", "2", "1"), ("x", "x", "2", "1"), ("x", "x", "1", "1"), ("z", "x", "1", "2")], "ta string, tb string, a string, b string")
    out = [r[0] and tuple(r[0]) for r in df.select(expr.oriented(F.col("ta"), F.col("tb"), F.col("a"), F.col("b"), [("x", "y"), ("x", "x")])).collect()]
    assert out == [("2", "1"), ("1", "2"), ("1", "2"), None, None]


def test_pairs_and_cap(spark):
    m = spark.createDataFrame([("c1", "1", "base", 2000, "a", "g", 2), ("c1", "1", "base", 2000, "b", "d", 8), ("c1", "1", "base", 2000, "c", "g", 1), ("c2", "2", "base", 2000, "a", "g", 1)], "carrier_key string, carrier_id string, carrier_type string, year int, entity_id string, entity_type string, mention_count long")
    e = units.evidence(m, [("g", "d"), ("g", "g")])
    assert {(r.pair_type, r.entity_a, r.entity_b, r.pair_weight) for r in e.collect()} == {("g-d", "a", "b", 4.0), ("g-d", "c", "b", 8**0.5), ("g-g", "a", "c", 2**0.5)}
    assert units.with_support(e, 2).count() == 0
    assert units.cap_entities(m, 1).count() == 2


def test_panel_is_dense(spark):
    y = spark.createDataFrame([("u", 2001, 2, 1)], "unit_id string, year int, carriers long, rows long")
    rows = panel.dense(y, 2000, 2003, ["carriers"]).orderBy("year").collect()
    assert [(r.carriers, r.carriers_so_far) for r in rows] == [(0, 0), (2, 2), (0, 2), (0, 2)]


def test_metrics_with_ties_and_one_class(spark):
    rows = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.1, 0), ("b", 0.3, 1), ("b", 0.2, 1)], "g string, score double, label int")
    m = {r.g: r for r in metrics.classification(rows, ["g"]).collect()}
    assert m["a"].auroc == 0.75 and m["a"].auprc == 0.5 and m["b"].auroc is None and m["b"].auprc == 1.0
    k = {r.g: r for r in metrics.at_k(metrics.ranked(rows.withColumn("t", F.col("label")), ["g"], "t"), ["g"], [10]).collect()}
    assert k["b"].precision == 1.0 and k["a"].recall == 1.0
    assert metrics.classification(rows.limit(0), ["g"]).count() == 0


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "y")], "u string, v string")
    assert {(r.node, r.component) for r in graph.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    w = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    starts = spark.createDataFrame([("a",), ("b",)], "node string")
    assert {len(r.path) for r in walks.biased_walks(w, starts, 7, back=4.0).collect()} == {7}


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert joins.keep_known(a, "k", b, "k").count() == 1 and joins.unmatched(a, "k", b, "k").count() == 2
    with pytest.raises(Exception, match="one to one"):
        joins.validated_merge(a.filter("k is not null"), b, ["k"]).collect()


def test_bad_rows(spark):
    lines = spark.createDataFrame([("a\tb",), ("a",), ("a\tb\tc",), ("",)], "value string")
    rows, bad = tables.parse_lines(lines, ["p", "q"])
    assert sorted((tuple(r) for r in rows.collect()), key=repr) == [("a", "b"), ("a", None), (None, None)] and bad.count() == 1
    with pytest.raises(Exception, match="too many fields"):
        tables.strict_lines(lines, ["p", "q"]).collect()


def test_large_negative_space_agrees_in_size(spark):
    s, t = spark.range(30).selectExpr("id as source"), spark.range(40).selectExpr("id as target")
    pos = spark.createDataFrame([(i, i) for i in range(20)], "source long, target long")
    want = spark.createDataFrame([("train", 50), ("test", 10)], "split string, n long")
    n = links.negatives(s, t, pos, want, small=1)
    assert {r.split: r["count"] for r in n.groupBy("split").count().collect()} == {"train": 50, "test": 10}
    assert n.join(pos, ["source", "target"]).count() == 0


def test_zero_vector(spark):
    v = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert links.vector_scores(v).first().cosine == 0.0
