"""Edges in one form, metapaths, reports, runs and audits on small tables with nulls, repeats and empty input."""

import pytest
from pyspark.sql import functions as F

from evgraph.operators import audit, dataset, evaluation, graph, metrics

NODES = [("order", "1", 10), ("order", "2", 11), ("part", "1", 20), ("part", "1", 20), (None, "9", 30), ("part", "7", None)]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "node_type string, node_id string, node_index int")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


ENDS = ["source_type", "source_id", "target_type", "target_id"]


def test_edges_by_index_get_typed_ends(spark, nodes):
    n = dataset.node_table(nodes)
    assert rows(n, "node_type", "node_id", "node_index") == [("order", "1", 10), ("order", "2", 11), ("part", "1", 20), ("part", "7", None)]
    e = spark.createDataFrame([(10, 20, "a", 1.0), (10, 20, "a", 1.0), (11, 20, "b", 2.0)], "source_index int, target_index int, edge_type string, weight double")
    assert rows(dataset.typed_ends(e, n), *ENDS, "weight") == [("order", "1", "part", "1", 1.0)] * 2 + [("order", "2", "part", "1", 2.0)]
    assert rows(dataset.with_relation(dataset.typed_ends(e, n)).distinct(), "relation") == [("a",), ("b",)]


def test_unmapped_edges_are_dropped_or_fail(spark, nodes):
    n = dataset.node_table(nodes)
    e = spark.createDataFrame([(10, 20), (10, 99), (None, 20), (11, None)], "source_index int, target_index int")
    assert rows(dataset.typed_ends(e, n, "drop"), *ENDS) == [("order", "1", "part", "1")]
    with pytest.raises(Exception, match="edge without a node"):
        dataset.typed_ends(e, n).collect()
    with pytest.raises(ValueError, match="unmapped must be"):
        dataset.typed_ends(e, n, "keep")


def test_an_index_of_two_nodes_fails(spark):
    n = spark.createDataFrame([("a", "1", 5), ("b", "1", 5), ("c", "1", 6)], "node_type string, node_id string, node_index int")
    e = spark.createDataFrame([(5, 6)], "source_index int, target_index int")
    with pytest.raises(Exception, match="node_index of several nodes"):
        dataset.typed_ends(e, n, "drop").collect()


def test_typed_ends_under_other_names_stay_as_they_are(spark, nodes):
    e = spark.createDataFrame([("order", 1, "part", 8, 3)], "src_type string, head_id int, dst_type string, to_id int, weight int")
    assert rows(dataset.typed_ends(e, nodes), *ENDS, "weight") == [("order", "1", "part", "8", 3)]
    with pytest.raises(ValueError, match="lacks source_type"):
        dataset.typed_ends(e.drop("src_type"), nodes)
    with pytest.raises(ValueError, match="lacks node_type"):
        dataset.node_table(nodes.drop("node_type"))
    with pytest.raises(ValueError, match="lack label, split"):
        dataset.labeled_ends(e, nodes)


def test_numbers_of_ends_and_triples(spark):
    index = spark.createDataFrame([("order", "1", 0), ("part", "1", 1), ("part", "2", 2)], "node_type string, node_id string, node_idx int")
    e = spark.createDataFrame([("x", "order", "1", "part", "1"), ("x", "order", "1", "part", "1"), ("a", "order", "1", "part", "2"), ("a", "order", "5", "part", "2")], "relation string, source_type string, source_id string, target_type string, target_id string")
    assert rows(dataset.triples(e, index, "drop"), "head", "relation_idx", "tail") == [(0, 0, 2), (0, 1, 1)]
    with pytest.raises(Exception, match="edge without a node"):
        dataset.triples(e, index).collect()
    assert rows(dataset.relation_index(dataset.both_ways(e)), "relation", "relation_idx") == [("a", 0), ("a__rev", 1), ("x", 2), ("x__rev", 3)]


def test_summary_of_empty_tables(spark):
    typed = "relation string, source_type string, source_id string, target_type string, target_id string"
    out = dataset.summary(spark.createDataFrame([], "node_type string"), spark.createDataFrame([], typed), spark.createDataFrame([], "split string, label int"))
    assert {(r["item"], r["part"]): r["n"] for r in out.collect()} == {(i, "all"): 0 for i in ("nodes", "node_types", "edges", "relations", "triples_both_ways")}


TYPES = [("customer", "ordered_by__rev", "order"), ("order", "mentions", "entity"), ("order", "ordered_by", "customer"), ("entity", "mentions__rev", "order"), ("order", "a_other__rev", "entity")]


def test_a_bridge_prefers_forward_steps_where_it_may():
    assert dataset.bridge(TYPES, "customer", "order", "entity") == [
        ("customer", "ordered_by__rev", "order"), ("order", "a_other__rev", "entity"), ("entity", "mentions__rev", "order"), ("order", "ordered_by", "customer"),
    ]
    assert dataset.step_between(TYPES, "order", "entity") == ("order", "mentions", "entity")
    with pytest.raises(ValueError, match="no edge type leads from entity to customer"):
        dataset.step_between(TYPES, "entity", "customer")


def test_metapaths_that_do_not_fit_are_refused():
    with pytest.raises(ValueError, match="one edge type or more"):
        dataset.checked_metapath([], TYPES)
    with pytest.raises(ValueError, match="that the graph lacks"):
        dataset.checked_metapath([("order", "gone", "entity")], TYPES)
    with pytest.raises(ValueError, match="not connected"):
        dataset.checked_metapath([TYPES[1], TYPES[2]], TYPES)


SCORES = [("a", 1, 0.9, 1), ("a", 2, 0.5, 0), ("a", 3, 0.5, 1), ("a", 4, 0.1, 0), ("b", 5, 0.3, 0), ("b", 6, 0.3, 0)]


def scored(spark, more=()):
    return spark.createDataFrame([*SCORES, *more], "split string, id int, score double, label int")


def test_report_by_hand(spark):
    r = {x["split"]: x.asDict() for x in evaluation.report(scored(spark), ["split"], "id", [2, 10], 0.5).collect()}
    a, b = r["a"], r["b"]
    assert (a["example_count"], a["positive_count"], a["negative_count"], a["positive_ratio"], a["mrr"]) == (4, 2, 2, 0.5, 1.0)
    # three of four pairs are won and one is tied
    assert (a["auroc"], a["auprc"]) == (0.875, round(0.5 + 0.5 * 2 / 3, 6))
    assert (a["hits_at_2"], a["precision_at_2"], a["recall_at_2"], a["enrichment_at_2"], a["hits_at_10"], a["precision_at_10"]) == (1, 0.5, 0.5, 1.0, 2, 0.5)
    assert (a["tp"], a["fp"], a["fn"], a["tn"], a["f1"]) == (2, 1, 0, 1, 0.8)
    # a split with one class has no AUROC, and without positives no average precision or recall
    assert (b["auroc"], b["auprc"], b["mrr"], b["recall_at_2"], b["ndcg_at_2"], b["enrichment_at_2"]) == (None, None, 0.0, None, None, None)


def test_report_is_that_of_whole_rankings(spark):
    """Ties, groups of one class and a group that holds nearly all rows: the same figures as by ranking each group whole."""
    x = spark.range(3000).select(
        F.when(F.col("id") % 50 == 0, F.lit("few")).when(F.col("id") % 77 == 0, F.lit("none")).otherwise(F.lit("hot")).alias("split"), "id",
        (F.pmod(F.xxhash64("id"), F.lit(400)) / 10.0).alias("score"), F.when((F.col("id") % 77 != 0) & (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0), 1).otherwise(0).alias("label"),
    )
    ks, names = [1, 10, 5000], ["hits", "precision", "recall", "ndcg", "enrichment"]
    got = {r["split"]: r.asDict() for r in evaluation.report(x, ["split"], "id", ks).collect()}
    ranks = metrics.ranked(x, ["split"], "id")
    want = {r["split"]: r.asDict() for r in metrics.classification(x, ["split"]).join(metrics.reciprocal_rank(ranks, ["split"]), "split").collect()}
    for r in metrics.at_k(ranks, ["split"], ks).collect():
        want[r["split"]] |= {f"{n}_at_{r['k']}": r[n] for n in names}
    assert set(got) == {"few", "none", "hot"}
    for g, w in want.items():
        for m in w.keys() - {"split", "rows", "positives"}:
            assert got[g][m] == (None if w[m] is None else pytest.approx(w[m], abs=2e-6)), (g, m)


def test_report_refuses_missing_scores_and_takes_empty_tables(spark):
    assert evaluation.report(scored(spark).limit(0), ["split"], "id", [2]).count() == 0
    for bad in [("a", 9, None, 1), ("a", 9, 0.1, None), ("a", 9, 0.1, 2), (None, 9, 0.1, 1), ("a", 9, float("nan"), 1)]:
        with pytest.raises(Exception, match="label of 0 or 1"):
            evaluation.report(scored(spark, [bad]), ["split"], "id", [2]).collect()


def test_long_and_selected_metrics(spark):
    long = evaluation.long(evaluation.report(scored(spark), ["split"], "id", [2]), ["split"])
    assert long.columns == ["split", "metric", "value"] and long.filter("split = 'b' and metric = 'auroc' and value is null").count() == 1
    assert rows(evaluation.selected(long, ["split"], ["mrr", "auroc", "gone"]), "split", "mrr", "auroc", "gone") == [("a", 1.0, 0.875, None), ("b", 0.0, None, None)]


def test_runs_are_collected_from_their_folders_and_ranked(spark):
    root = f"{graph.shared_folder(spark)}/runs-test"
    for run, mae, roc in (("one two", 0.5, 0.8), ("other", 0.2, None)):
        evaluation.write_run(spark.createDataFrame([("test", "mae", mae), ("test", "auroc", roc)], "split string, metric string, value double"), root, "set", run)
    board = evaluation.leaderboard(evaluation.collect_runs(spark, root))
    assert rows(board, "dataset", "metric", "run", "place", "behind_best") == [
        ("set", "auroc", "one two", 1, 0.0), ("set", "auroc", "other", 2, None), ("set", "mae", "one two", 2, 0.3), ("set", "mae", "other", 1, 0.0),
    ]


LINKS = [("t", "x", "1", "m1"), ("t", "x", " 2 ", "m2"), ("t", None, "2", None), ("t", "x", "none", "m3"), ("t", "y", "NONE", "m4"), ("u", "y", None, "m5"), ("u", "y", "3", "m6")]


def test_unmatched_entities(spark):
    links = spark.createDataFrame(LINKS, "source_table string, entity_type string, entity_id string, mention string").withColumn("ref", F.when(F.col("mention") == "m2", "r"))
    known = spark.createDataFrame([("1",), ("1",), (None,), ("3",)], "entity_id string")
    by_type = audit.unmatched_by_type(links, known, "none", ["ref"])
    assert rows(by_type, "source_table", "entity_type", "row_count", "entity_ids", "ref_present", "warning") == [
        ("t", "", 1, 1, 0, "ids missing from the dictionary"), ("t", "x", 2, 2, 1, "both"), ("t", "y", 1, 1, 0, "ungrounded mentions"), ("u", "y", 1, 0, 0, "ids missing from the dictionary"),
    ]
    by_entity = audit.unmatched_by_entity(links, known, "none", sample=1)
    assert rows(by_entity, "source_table", "entity_id", "row_count", "mentions", "entity_types", "sample_mentions") == [
        ("t", "2", 2, 1, "x", "m2"), ("t", "NONE", 1, 1, "y", "m4"), ("t", "none", 1, 1, "x", "m3"), ("u", None, 1, 1, "y", "m5"),
    ]
    assert tuple(audit.unmatched_decision(by_entity, "none").first()) == (5, 2, 3, 0.4, "review others, consider adding nodes")
    none = audit.unmatched_decision(audit.unmatched_by_entity(links.limit(0), known, "none"), "none").first()
    assert tuple(none) == (0, 0, 0, 0.0, "dictionary covers all")


@pytest.mark.parametrize("marker,other,decision", [(100, 0, "leave out ungrounded, use the dictionary"), (199, 1, "leave out ungrounded, review few others"), (90, 10, "review others, consider adding nodes")])
def test_decisions(spark, marker, other, decision):
    rows_ = [("t", "none", marker)] + ([("t", "7", other)] if other else [])
    assert audit.unmatched_decision(spark.createDataFrame(rows_, "source_table string, entity_id string, row_count long"), "none").first()["decision"] == decision


def test_input_checks(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None), (3, " ")], "id int, ref string"), spark.createDataFrame([], "k string")
    out = audit.input_checks({"a": a, "b": b}, {"a": ["id", "year"], "b": ["k"], "c": ["z"]}, [("a", "ref", "b", "k"), ("a", "gone", "b", "k")])
    assert rows(out, "check", "table_name", "violations", "detail") == sorted(
        [("table present", "a", 0, ""), ("required columns", "a", 1, "year"), ("not empty", "a", 0, ""), ("table present", "b", 0, ""), ("required columns", "b", 0, ""), ("not empty", "b", 1, ""), ("table present", "c", 1, ""), ("keys known", "a", 1, "ref in b.k")], key=repr
    )


def test_match_stats_of_an_empty_table(spark):
    assert tuple(audit.match_stats(spark.range(0), spark.range(0), "none").first()) == ("none", 0, 0, 0, None)


def test_sanity_finds_each_fault(spark):
    units = spark.createDataFrame(
        [("u1", "a-b", "1", "2", 2, 2, 0), ("u1", "a-b", "2", "1", 1, 1, 0), ("u3", "a-c", "3", "3", 1, 0, 1), ("u4", "b-a", "4", "5", 1, 0, 1)],
        "unit_id string, pair_type string, entity_a string, entity_b string, carrier_count long, p_count long, t_count long",
    )
    evidence = spark.createDataFrame([("u1", "p:1", "p"), ("u1", "p:2", "p"), ("u1", "p:2", "p"), ("u3", "t:1", "t"), ("u9", "t:1", "t")], "unit_id string, carrier_key string, carrier_type string")
    summary = spark.createDataFrame([(4, 6)], "unit_count long, edge_count long")
    out = {r["check"]: (r["status"], r["n"]) for r in audit.sanity(units, evidence, ["a-b", "a-c", "x-y"], ["b-a"], ["c"], ["p", "t"], summary).collect()}
    assert out == {
        "unexpected_pair_types": ("FAIL", 1), "forbidden_pair_types": ("FAIL", 1), "forbidden_entity_types": ("FAIL", 1), "self_pairs": ("FAIL", 1), "repeated_units": ("FAIL", 1), "reversed_pairs": ("FAIL", 1),
        "evidence_without_unit": ("FAIL", 1), "count_mismatches": ("FAIL", 2), "summary_units_differ": ("PASS", 0), "summary_edges_differ": ("FAIL", 1), "expected_pair_types_absent": ("WARN", 1),
        "cross_modal_units": ("PASS", 0), "p_supported_units": ("PASS", 2), "t_supported_units": ("PASS", 2),
    }
