"""Supported evidence by one shuffle, made once for each query."""

import os
import re

import pytest
from pyspark.sql import functions as F

import evgraph.plans as plans
from evgraph.operators import links, panel, units

DATA = "/root/testdata/sf0.001"
TYPES = [("g", "d"), ("g", "g")]


def test_supported_evidence_is_that_of_the_two_steps(spark):
    m = spark.range(400).select(
        (F.col("id") % 60).cast("string").alias("carrier_id"), F.when(F.col("id") % 7 > 0, "base").alias("carrier_type"), F.when(F.col("id") % 60 != 5, 2000 + (F.col("id") % 3).cast("int")).alias("year"),
        F.concat(F.lit("e"), F.xxhash64("id") % 9).alias("entity_id"), F.when(F.xxhash64("id") % 9 < 5, "g").otherwise("d").alias("entity_type"), F.lit(2).cast("long").alias("mention_count"),
    ).withColumn("carrier_key", F.concat_ws(":", "carrier_type", "carrier_id"))
    for least in (1, 2, 4):
        want = units.with_support(units.evidence(m, TYPES), least)
        got = units.supported_evidence(m, TYPES, least)
        assert want.count() > 0 and sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_totals_end_at_the_range(spark):
    y = spark.createDataFrame([("u", 1999, 5), ("u", 2001, 2), ("v", 2009, 3)], "unit_id string, year int, carriers long")
    rows = {(r.unit_id, r.year): (r.carriers, r.carriers_so_far) for r in panel.dense(y, 2000, 2002, ["carriers"]).collect()}
    assert rows == {("u", 2000): (0, 0), ("u", 2001): (2, 2), ("u", 2002): (0, 2)} | {("v", k): (0, 0) for k in (2000, 2001, 2002)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["audit_status", "dense_panel", "entity_hubs", "snapshots", "static_features", "stratified_sample", "task_summary", "unit_sanity", "regression_metrics"])
def test_line_items_are_read_once(spark, name):
    plan = plans.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[[^\]]*l_orderkey", plan)) <= 1


def test_repeated_pairs_share_no_more(spark):
    pairs = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y")], "source string, target string")
    left = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 1.0), ("b", 3, 1.0)], "source string, entity long, w double")
    right = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 4.0), ("z", 1, 1.0), ("y", 9, 1.0)], "target string, entity long, w double")
    rows = [(r.source, r.target, r.shared, r.wmin, r.union_size) for r in links.overlap(pairs, left, right).orderBy("source", "target").collect()]
    assert rows == [("a", "x", 2, 2.0, 2), ("a", "x", 2, 2.0, 2), ("a", "y", 0, 0.0, 3), ("b", "y", 0, 0.0, 2)]
