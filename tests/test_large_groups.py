"""Pairs that are made behind their shuffle, and sums of dealt rows without another one."""

import os

import pytest
from pyspark.sql import functions as F

import evgraph.plans as plans
from evgraph.operators import features, forecast, panel, units

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_made_behind_their_shuffle(spark):
    m = spark.createDataFrame([("c", "base", 2000, f"e{i}", "g" if i < 3 else "d", 1) for i in range(6)], "carrier_id string, carrier_type string, year int, entity_id string, entity_type string, mention_count long")
    types = [("g", "d"), ("g", "g")]
    plan = plan_of(units.supported_evidence(m, types, 1))
    assert plan.index("explode(others") < plan.index("REPARTITION_BY_COL")
    pairs = {(r.entity_a, r.entity_b) for r in units.supported_evidence(m, types, 1).collect()}
    assert pairs == {(f"e{i}", f"e{j}") for i in range(3) for j in range(i + 1, 6)}


def test_what_follows_from_dealt_rows_needs_no_shuffle(spark):
    dealt = ("entity_a",)
    e = spark.range(60).select(
        F.concat(F.lit("u"), F.col("id") % 7).alias("unit_id"), (F.col("id") % 7).alias("entity_a"), F.when(F.col("id") % 2 == 0, "base").otherwise("trial").alias("carrier_type"),
        (F.col("id") % 11).cast("string").alias("carrier_key"), (1994 + F.col("id") % 5).cast("int").alias("year"), F.lit(1.0).alias("pair_weight"),
    ).repartition("entity_a")
    cutoffs = forecast.cutoff_table(spark, [(1996, "train")], 2, 1994)
    modes = ["base", "patent", "trial"]
    for make in (
        lambda d: panel.dense(panel.yearly(e, modes, d, keep=True), 1995, 1999, ["carriers", "rows"], d),
        lambda d: forecast.examples(panel.yearly(e, modes, d, keep=True), cutoffs, 2, "base", ["patent", "trial"], d).drop(*d),
        lambda d: features.edge_derived(e, modes, d),
    ):
        assert plan_of(make(dealt)).count("Exchange hashpartitioning") == 1 < plan_of(make(())).count("Exchange hashpartitioning")
        assert sorted(map(repr, make(dealt).collect())) == sorted(map(repr, make(()).collect()))


def test_tasks_are_made_by_one_pass(spark):
    x = spark.createDataFrame([("u", True, 1, False, 0), ("v", False, 0, True, 1), ("w", None, 1, True, 0)], "unit_id string, eligible_a boolean, label_a int, eligible_b boolean, label_b int")
    got = forecast.tasks(x, ["a", "b"])
    assert sorted((r.unit_id, r.task, r.label) for r in got.collect()) == [("u", "a", 1), ("v", "b", 1), ("w", "b", 0)]
    assert plan_of(got).count("Scan") == 1


@needs_tables
@pytest.mark.parametrize("name", ["model_coefficients", "mean_baseline", "stratified_sample", "task_summary"])
def test_evidence_is_not_stored(spark, name, monkeypatch):
    """Nothing but the rows of a model is written, and line items are read once."""
    from evgraph.plans import unit_plans

    def refuse(*_):
        raise AssertionError("evidence or examples are stored")

    monkeypatch.setattr(unit_plans, "stored_evidence", refuse)
    monkeypatch.setattr(unit_plans, "stored_examples", refuse)
    assert plans.queries()[name](spark, DATA).count() > 0
