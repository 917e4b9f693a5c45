"""The unit graph with the reference's bounds: wide entities link their units."""

import os

import pytest
from pyspark.sql import functions as F

import evgraph.plans as plans
from evgraph.operators import forecast

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_wide_entities_give_all_links_in_any_blocks(spark):
    units = spark.range(60).selectExpr("concat('u', id) as unit_id", "'hub' as entity_a", "concat('e', id) as entity_b")
    for block in (7, 256):
        e = forecast.shared_entity_edges(units, 2, 2000, 100, block=block)
        assert e.count() == 60 * 59 and e.select("src", "dst").distinct().count() == 60 * 59


@needs_tables
def test_wide_unit_graph_links_units_through_suppliers(spark):
    units = plans.queries()["unit_master"](spark, DATA).select("unit_id", "entity_a", "entity_b").persist()
    degree = units.select(F.explode(F.array("entity_a", "entity_b")).alias("e")).groupBy("e").count()
    wide = {r.e for r in degree.filter("e like 'S%' and count between 41 and 2000").collect()}
    side = {r.unit_id: {r.entity_a, r.entity_b} for r in units.collect()}
    links = plans.queries()["unit_graph_wide"](spark, DATA).select("src", "dst").collect()
    assert wide and {e for r in links for e in side[r.src] & side[r.dst]} >= wide
    cutoffs = {r.cutoff for r in plans.queries()["neighbour_features_wide"](spark, DATA).select("cutoff").distinct().collect()}
    assert cutoffs == {1996, 1997, 1998}
