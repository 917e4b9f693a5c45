"""The order tables as a typed graph: orders, parts, suppliers and customers as nodes, line items and orders as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.functions import expr
from evgraph.operators import embeddings, forecast, graph, joins, walks
from evgraph.plans.bindings import CUTOFFS, HORIZON, carriers, entities, raw_mentions, sql, table


def all_nodes(s, d) -> DataFrame:
    c, e, t = table(s, d, "customer"), entities(s, d), table(s, d, "orders")
    parts = [
        graph.nodes(t, "order", F.col("o_orderkey"), [F.lit(None).cast("string")]),
        graph.nodes(e, "entity", F.col("entity_id"), [F.col("entity_name")], F.col("entity_type")),
        graph.nodes(c, "customer", F.col("c_custkey"), [F.col("c_name")]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def owned_edges(s, d) -> DataFrame:
    return graph.edges(table(s, d, "orders"), "ordered_by", ("order", F.col("o_orderkey")), ("customer", F.col("o_custkey")))


def all_edges(s, d) -> DataFrame:
    m = raw_mentions(s, d).groupBy("carrier_id", "entity_id").agg(F.count("*").alias("n"))
    mentions = graph.edges(m, "mentions", ("order", F.col("carrier_id")), ("entity", F.col("entity_id")), F.col("n"))
    return mentions.unionByName(owned_edges(s, d))


def all_links(s, d) -> DataFrame:
    """all_edges with a row for every mention: where repeats make no difference they needn't be counted first."""
    return graph.edges(raw_mentions(s, d), "mentions", ("order", F.col("carrier_id")), ("entity", F.col("entity_id"))).unionByName(owned_edges(s, d))


def edge_types(s, d):
    return all_edges(s, d).groupBy("edge_type", "source_type", "target_type").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 6).alias("weight"), F.count_distinct("source_id").alias("sources"), F.count_distinct("target_id").alias("targets"))


def node_types(s, d):
    n, e = all_nodes(s, d), all_edges(s, d)
    linked = graph.without_isolated(n, e).groupBy("node_type").agg(F.count("*").alias("linked"))
    return n.groupBy("node_type").agg(F.count("*").alias("nodes"), F.count("entity_type").alias("typed")).join(linked, "node_type", "left").fillna(0, ["linked"]).withColumn("isolated", F.col("nodes") - F.col("linked"))


def node_degree(s, d):
    return graph.degrees(all_edges(s, d))


def degree_quantiles(s, d):
    q = F.expr("percentile(degree, array(0.5, 0.9, 0.95, 0.99))")
    return graph.degrees(all_edges(s, d)).groupBy("node_type").agg(q.alias("q")).select("node_type", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))))


def top_degree(s, d):
    return graph.degrees(all_edges(s, d)).orderBy(F.desc("degree"), "node_type", "node_id").limit(20).select("node_type", "node_id", "degree")


def seed_orders(s, d):
    return carriers(s, d).filter(F.col("year").between(1997, 1998)).groupBy("carrier_id").agg(F.min("year").alias("year"))


def expansion(s, d):
    """One hop from the orders of two years to entities, then to all mentions of the entities found there."""
    links = raw_mentions(s, d).select("carrier_id", "entity_id")
    found, kept = graph.expand(seed_orders(s, d), links, "carrier_id", "entity_id", entities(s, d), "entity_id")
    again = joins.keep_known(links, "entity_id", found, "entity_id")
    return found.groupBy("entity_type").agg(F.count("*").alias("entities")).join(
        kept.join(entities(s, d), "entity_id").groupBy("entity_type").agg(F.count("*").alias("seed_links")), "entity_type"
    ).join(again.join(entities(s, d), "entity_id").groupBy("entity_type").agg(F.count("*").alias("all_links"), F.count_distinct("carrier_id").alias("all_orders")), "entity_type")


def domain_seeds(s, d):
    """Orders that mention a part whose name matches one of the terms."""
    terms = F.array(*(F.struct(F.lit(a).alias("tier"), F.lit(b).alias("term")) for a, b in (("core", "small ring"), ("core", "red widget"), ("wide", "widget"))))
    t = s.range(1).select(F.explode(terms).alias("t")).select("t.*").withColumn("pattern", expr.term_pattern(F.col("term")))
    hits = entities(s, d).join(F.broadcast(t), F.expr("lower(entity_name) rlike pattern"))
    m = raw_mentions(s, d).join(hits.select("entity_id", "tier", "term"), "entity_id")
    return m.groupBy("tier", "term").agg(F.count("*").alias("mentions"), F.count_distinct("carrier_id").alias("orders"), F.count_distinct("entity_id").alias("entities"))


def induced_edges(s, d):
    seeds = table(s, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").cast("string").alias("node_id"))
    e = graph.edges(table(s, d, "orders"), "ordered_by", ("order", F.col("o_orderkey")), ("customer", F.col("o_custkey")))
    orders_97 = carriers(s, d).filter("year = 1997").select(F.col("carrier_id").alias("node_id"))
    both = joins.keep_known(joins.keep_known(e, "target_id", seeds, "node_id"), "source_id", orders_97, "node_id")
    either = joins.keep_known(e, "target_id", seeds, "node_id").unionByName(joins.keep_known(joins.unmatched(e, "target_id", seeds, "node_id"), "source_id", orders_97, "node_id"))
    return both.agg(F.count("*").alias("both_ends"), F.count_distinct("target_id").alias("customers")).join(either.agg(F.count("*").alias("either_end")), how="full")


def filtered_graph(s, d):
    """Node counts before and after entities of a type and then isolated nodes are left out."""
    n, e = all_nodes(s, d), all_edges(s, d)
    kept = n.filter("entity_type is null or entity_type <> 'species'")
    e = e.join(kept.select(F.col("node_type").alias("target_type"), F.col("node_id").alias("target_id")), ["target_type", "target_id"], "left_semi")
    return joins.compare_counts(n, graph.without_isolated(kept, e), "node_type")


def project_rollup(s, d):
    o = table(s, d, "orders")
    return o.groupBy(expr.project_key(F.col("o_custkey")).alias("project_id")).agg(
        F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year"), F.count_distinct(F.year("o_orderdate")).alias("years"),
        F.count_distinct("o_orderkey").alias("applications"), F.round(F.sum("o_totalprice"), 2).alias("cost"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("earliest"),
    )


def mention_aggregate(s, d):
    m = raw_mentions(s, d)
    return m.groupBy("carrier_id", "entity_id").agg(
        F.count("*").alias("n"), F.count_distinct("field").alias("fields"), F.array_join(F.sort_array(F.collect_set("field")), "|").alias("field_list"), F.min("start").alias("first_start"), F.max("start").alias("last_start"),
        F.round(F.avg("prob"), 6).alias("mean_prob"), F.round(F.max("prob"), 6).alias("most_prob"), (F.max(F.when(F.col("field") == "R", 1).otherwise(0)) == 1).alias("has_return"),
    )


def mention_compression(s, d):
    m = raw_mentions(s, d).withColumn("side", F.substring("entity_id", 1, 1))
    a = m.groupBy("side").agg(F.count("*").alias("raw_rows"), F.count_distinct("carrier_id", "entity_id").alias("rows"))
    return a.withColumn("ratio", F.round(F.col("rows") / F.col("raw_rows"), 6))


def carrier_vectors(s, d):
    m = raw_mentions(s, d).groupBy("carrier_id", "entity_id").agg(F.count("*").cast("double").alias("w"))
    return m.groupBy("carrier_id").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("l2"))


def node_index(s, d):
    """Each type's range of dense numbers; the numbers within a type have no gaps."""
    i = graph.index(graph.nodes(entities(s, d), "entity", F.col("entity_id"), [F.col("entity_name")], F.col("entity_type")).withColumn("node_type", F.col("entity_type")), ["node_id"])
    return i.groupBy("node_type").agg(F.count("*").alias("n"), F.min("node_idx").alias("low"), F.max("node_idx").alias("high"), F.max("type_idx").alias("type_high"), F.count_distinct("node_idx").alias("distinct_idx"))


def label_choice(s, d):
    return all_nodes(s, d).filter("node_type <> 'order'")


def structure_at_cutoffs(s, d):
    """Degree of each entity from orders up to each cutoff: one range join with the few cutoffs, pooled by type."""
    m = raw_mentions(s, d).join(carriers(s, d).select("carrier_id", "year"), "carrier_id").groupBy("entity_id", "year", "carrier_id").agg(F.count("*").alias("n"))
    cut = forecast.cutoff_table(s, CUTOFFS, HORIZON, 1995)
    r = m.join(F.broadcast(cut), F.col("year") <= F.col("cutoff")).groupBy("entity_id", "cutoff").agg(F.count_distinct("carrier_id").alias("degree"), F.sum("n").alias("weight"))
    t = r.join(entities(s, d), "entity_id").groupBy("entity_type", "cutoff")
    return t.agg(F.count("*").alias("n"), F.round(F.avg("degree"), 6).alias("degree_mean"), F.max("degree").alias("degree_max"), F.sum("degree").alias("degree_sum"), F.round(F.stddev_pop("degree"), 5).alias("degree_std"), F.sum("weight").alias("weight"))


def _nation_edges(s, d):
    """Customers' nations to suppliers' nations, weighted by line items."""
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    c, p = table(s, d, "customer"), table(s, d, "supplier")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(p, li["l_suppkey"] == p["s_suppkey"])
    return j.groupBy(F.col("c_nationkey").cast("string").alias("src"), F.col("s_nationkey").cast("string").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


def _nation_state(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("node"), F.col("n_regionkey").cast("double").alias("u"))


def flux_step(s, d):
    return graph.flux(_nation_edges(s, d), _nation_state(s, d), "u")


def neighbour_mean_step(s, d):
    return graph.neighbour_mean(_nation_edges(s, d), _nation_state(s, d), "u", self_loops=True)


def relation_triples(s, d):
    e = all_edges(s, d).filter("edge_type = 'ordered_by'").select(F.col("source_id").alias("head"), "edge_type", F.col("target_id").alias("tail"))
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("head"), F.lit("in_region").alias("edge_type"), F.col("n_regionkey").cast("string").alias("tail"))
    t = e.union(n).distinct()
    from pyspark.sql import Window

    names = t.select("edge_type").distinct().withColumn("relation", F.row_number().over(Window.orderBy("edge_type")) - 1)
    return t.join(F.broadcast(names), "edge_type").groupBy("edge_type", "relation").agg(F.count("*").alias("triples"), F.count_distinct("head").alias("heads"), F.count_distinct("tail").alias("tails"))


def reverse_edges(s, d):
    e = all_edges(s, d).select("edge_type", "source_type", "source_id", "target_type", "target_id")
    back = e.select(F.concat("edge_type", F.lit("__rev")).alias("edge_type"), F.col("target_type").alias("source_type"), F.col("target_id").alias("source_id"), F.col("source_type").alias("target_type"), F.col("source_id").alias("target_id"))
    return e.unionByName(back).groupBy("edge_type", "source_type", "target_type").agg(F.count("*").alias("edges"), F.count_distinct("source_id").alias("sources"))


def context_without_target(s, d):
    e = all_edges(s, d)
    return e.filter(F.col("edge_type") != "ordered_by").groupBy("edge_type").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))


def components(s, d):
    """Components of the whole undirected graph over nodes of all types, isolated ones too, with the nodes of each type."""
    name = lambda kind, key: F.concat_ws(":", kind, key)
    links = all_links(s, d)
    c = graph.written(graph.components(links.select(name("source_type", "source_id").alias("u"), name("target_type", "target_id").alias("v"))), "components")
    # an end of an edge that no table describes counts by the type that the edge gives it
    n = all_nodes(s, d).select(name("node_type", "node_id").alias("node"))
    alone = n.join(c, "node", "left_anti").select("node", F.col("node").alias("component"))
    rows = c.unionByName(alone).withColumn("kind", F.substring_index("node", ":", 1))
    kinds = {"orders": "order", "entities": "entity", "customers": "customer"}
    return rows.groupBy("component").agg(F.count("*").alias("nodes"), *(F.count_if(F.col("kind") == k).alias(c) for c, k in kinds.items()))


def typed_edges(s, d) -> DataFrame:
    """The order graph, both ways: src, dst, weight, with typed names of nodes."""
    e = all_edges(s, d).select(F.concat_ws(":", "source_type", "source_id").alias("src"), F.concat_ws(":", "target_type", "target_id").alias("dst"), "weight")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def typed_nodes(s, d) -> DataFrame:
    return all_nodes(s, d).select(F.concat_ws(":", "node_type", "node_id").alias("node"))


def random_walks(s, d):
    """A walk of six nodes from every node of the order graph, slow to return and quick to leave."""
    w = walks.biased_walks(typed_edges(s, d), typed_nodes(s, d), 6, back=2.0, out=0.5, seed=1)
    return w.select("walk_id", F.concat_ws(">", "path").alias("path"))


def typed_walks(s, d):
    """A walk of six nodes from every node of the order graph."""
    return walks.hub_walks(typed_edges(s, d), typed_nodes(s, d), 6, seed=3).select("walk_id", F.concat_ws(">", "path").alias("path"))


def metapath(s, d):
    """Customer, order, entity, order, customer: one walk from each customer that has an order with an entity."""
    o = table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("c"), F.col("o_orderkey").cast("string").alias("o"))
    m = raw_mentions(s, d).select(F.col("carrier_id").alias("o"), "entity_id").distinct()
    steps = [o.select(F.col("c").alias("src"), F.col("o").alias("dst")), m.select(F.col("o").alias("src"), F.col("entity_id").alias("dst")), m.select(F.col("entity_id").alias("src"), F.col("o").alias("dst")), o.select(F.col("o").alias("src"), F.col("c").alias("dst"))]
    return walks.metapath_walks(steps, o.select(F.col("c").alias("node")).distinct()).select("walk_id", F.concat_ws(">", "path").alias("path"))


def walk_vectors(s, d):
    """Vectors of all nodes over a biased walk from each."""
    return embeddings.skip_gram(graph.written(walks.biased_walks(typed_edges(s, d), typed_nodes(s, d), 6, back=2.0, out=0.5, seed=2), "walk-corpus"))


def typed_walk_vectors(s, d):
    """Vectors of all nodes over two walks from each."""
    return embeddings.skip_gram(graph.written(walks.hub_walks(typed_edges(s, d), typed_nodes(s, d), 8, per_node=2, seed=4), "walk-corpus"))


def triple_scores(s, d):
    """DistMult and TransE scores of pairs of labelled vectors, with the label's mean vector as relation."""
    v = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    h, t = v.select(F.col("vec_id").alias("h"), "label", F.col("x").alias("hx")), v.select(F.col("vec_id").alias("t"), F.col("x").alias("tx"))
    j = h.join(t, F.col("t") == F.col("h") + 1)
    r = F.transform("hx", lambda a, i: F.cos(i.cast("double")))
    distmult = F.aggregate(F.zip_with(F.zip_with("hx", r, lambda a, b: a * b), "tx", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    gap = F.zip_with(F.zip_with("hx", r, lambda a, b: a + b), "tx", lambda a, b: a - b)
    return j.select("h", "t", F.round(distmult, 6).alias("distmult"), F.round(-F.sqrt(expr.dot(gap, gap)), 6).alias("transe"))


GRAPH = """edges AS (
  SELECT 'mentions' AS edge_type, 'order' AS source_type, carrier_id AS source_id, 'entity' AS target_type, entity_id AS target_id, CAST(count(*) AS DOUBLE) AS weight FROM raw_mentions GROUP BY ALL
  UNION ALL SELECT 'ordered_by', 'order', CAST(o_orderkey AS VARCHAR), 'customer', CAST(o_custkey AS VARCHAR), 1.0 FROM orders),
nodes AS (
  SELECT 'order' AS node_type, CAST(o_orderkey AS VARCHAR) AS node_id, CAST(o_orderkey AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS entity_type FROM orders
  UNION ALL SELECT 'entity', entity_id, entity_name, entity_type FROM entities
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name, NULL FROM customer),
ends AS (
  SELECT source_type AS node_type, source_id AS node_id, edge_type, weight, 1 AS o FROM edges UNION ALL SELECT target_type, target_id, edge_type, weight, 0 FROM edges),
degree AS (
  SELECT node_type, node_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(1 - o) AS BIGINT) AS in_degree, count(*) AS degree, round(sum(weight * o), 6) AS out_weight, round(sum(weight * (1 - o)), 6) AS in_weight, count(DISTINCT edge_type) AS edge_types
  FROM ends GROUP BY node_type, node_id)"""
NATIONS = """nation_edges AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS src, CAST(s_nationkey AS VARCHAR) AS dst, CAST(count(*) AS DOUBLE) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
state AS (SELECT CAST(n_nationkey AS VARCHAR) AS node, CAST(n_regionkey AS DOUBLE) AS u FROM nation)"""

BOTH_WAYS = """typed AS (SELECT source_type || ':' || source_id AS a, target_type || ':' || target_id AS b, weight FROM edges),
typed_both AS (SELECT src, dst, sum(weight) AS w FROM (SELECT a AS src, b AS dst, weight FROM typed UNION ALL SELECT b, a, weight FROM typed) GROUP BY src, dst),
typed_nodes AS (SELECT node_type || ':' || node_id AS node FROM nodes)"""


def _lines(name: str, edges: str) -> str:
    """Where each edge begins on its source's line: the edges in order of two digits of md5(dst), then dst."""
    return f"{name} AS (SELECT src, dst, sum(w) OVER (PARTITION BY src ORDER BY substr(md5(dst), 1, 2), dst) - w AS low, sum(w) OVER (PARTITION BY src) AS total FROM {edges})"


def _unit(*parts: str) -> str:
    """The SQL of expr.unit_interval."""
    return f"CAST(CAST('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496"


def _walked(lines: list[str], starts: str, seed: int, ends_early: bool) -> str:
    """Common table expressions w0, w1 and so on: the walks after each step, the k-th over the k-th lines."""
    ctes = [f"w0 AS (SELECT node || '#0' AS walk_id, node AS here, node AS path FROM {starts})"]
    for k, line in enumerate(lines):
        moved = f"SELECT walk_id, dst AS here, path || '>' || dst AS path FROM (SELECT w.*, {_unit(f"'{seed}'", 'walk_id', f"'{k}'")} * total AS point FROM w{k} w JOIN (SELECT DISTINCT src, total FROM {line}) ON src = here) p ASOF JOIN {line} l ON l.src = p.here AND l.low <= p.point"
        stays = f" UNION ALL SELECT walk_id, here, path FROM w{k} WHERE here NOT IN (SELECT src FROM {line})" if ends_early else ""
        ctes.append(f"w{k + 1} AS MATERIALIZED ({moved}{stays})")
    return ", ".join(ctes)


def _biased(length: int, back: float, out: float, seed: int, tries: int) -> str:
    """The same with proposals: the first of `tries` that is accepted; a walk without one would be missing."""
    most = max(1.0, 1 / back, 1 / out)
    ctes = ["w0 AS (SELECT node || '#0' AS walk_id, node AS here, CAST(NULL AS VARCHAR) AS was, node AS path FROM typed_nodes)"]
    for k in range(length - 1):
        u, v = _unit(f"'{seed}'", "walk_id", f"'{k}'", "t"), _unit(f"'{seed}'", "walk_id", f"'{k}'", "t", "'keep'")
        ctes.append(
            f"""w{k + 1} AS MATERIALIZED (SELECT walk_id, arg_min(dst, t) AS here, any_value(here) AS was, any_value(path) || '>' || arg_min(dst, t) AS path FROM (
            SELECT p.walk_id, p.here, p.was, p.path, p.t, p.v, l.dst FROM (SELECT w.*, t, {u} * total AS point, {v} AS v FROM w{k} w JOIN (SELECT DISTINCT src, total FROM lines) ON src = here CROSS JOIN range({1 if k == 0 else tries}) r(t)) p
            ASOF JOIN lines l ON l.src = p.here AND l.low <= p.point) x LEFT JOIN (SELECT src AS ns, dst AS nd FROM typed_both) ON ns = was AND nd = dst
            WHERE v < CASE WHEN was IS NULL THEN {most} WHEN dst = was THEN {1 / back} WHEN nd IS NOT NULL THEN 1.0 ELSE {1 / out} END / {most} GROUP BY walk_id
            UNION ALL SELECT walk_id, here, was, path FROM w{k} WHERE here NOT IN (SELECT src FROM lines))"""
        )
    return ", ".join(ctes)


ORACLES = {
    "random_walks": (random_walks, sql("SELECT walk_id, path FROM w5", f"{GRAPH}, {BOTH_WAYS}, {_lines('lines', 'typed_both')}, {_biased(6, 2.0, 0.5, 1, 128)}")),
    "typed_walks": (typed_walks, sql("SELECT walk_id, path FROM w5", f"{GRAPH}, {BOTH_WAYS}, {_lines('lines', 'typed_both')}, {_walked(['lines'] * 5, 'typed_nodes', 3, True)}")),
    "metapath_walks": (
        metapath,
        sql(
            "SELECT walk_id, path FROM w4",
            "co AS (SELECT DISTINCT project_id AS src, carrier_id AS dst, 1.0::DOUBLE AS w FROM carriers), oe AS (SELECT DISTINCT carrier_id AS src, entity_id AS dst, 1.0::DOUBLE AS w FROM raw_mentions), "
            "eo AS (SELECT dst AS src, src AS dst, w FROM oe), oc AS (SELECT dst AS src, src AS dst, w FROM co), started AS (SELECT DISTINCT src AS node FROM co), "
            + ", ".join(_lines(f"l_{e}", e) for e in ("co", "oe", "eo", "oc")) + ", " + _walked(["l_co", "l_oe", "l_eo", "l_oc"], "started", 0, False),
        ),
    ),
    "edge_types": (edge_types, sql("SELECT edge_type, source_type, target_type, count(*) AS edges, round(sum(weight), 6) AS weight, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets FROM edges GROUP BY ALL", GRAPH)),
    "node_types": (
        node_types,
        sql("SELECT n.node_type, count(*) AS nodes, count(entity_type) AS typed, count(d.node_id) AS linked, count(*) - count(d.node_id) AS isolated FROM nodes n LEFT JOIN degree d ON n.node_type = d.node_type AND n.node_id = d.node_id GROUP BY n.node_type", GRAPH),
    ),
    "node_degree": (node_degree, sql("SELECT * FROM degree", GRAPH)),
    "degree_quantiles": (
        degree_quantiles,
        sql("SELECT node_type, round(quantile_cont(degree, 0.5), 6) AS p50, round(quantile_cont(degree, 0.9), 6) AS p90, round(quantile_cont(degree, 0.95), 6) AS p95, round(quantile_cont(degree, 0.99), 6) AS p99 FROM degree GROUP BY node_type", GRAPH),
    ),
    "top_degree": (top_degree, sql("SELECT node_type, node_id, degree FROM degree ORDER BY degree DESC, node_type, node_id LIMIT 20", GRAPH)),
    "seed_carriers": (seed_orders, sql("SELECT carrier_id, min(year) AS year FROM carriers WHERE year BETWEEN 1997 AND 1998 GROUP BY carrier_id")),
    "hop_expansion": (
        expansion,
        sql(
            """SELECT entity_type, count(DISTINCT entity_id) AS entities, count(*) FILTER (year BETWEEN 1997 AND 1998) AS seed_links, count(*) AS all_links, count(DISTINCT carrier_id) AS all_orders
            FROM (SELECT m.carrier_id, m.entity_id, e.entity_type, c.year FROM raw_mentions m JOIN entities e ON m.entity_id = e.entity_id LEFT JOIN carriers c ON m.carrier_id = c.carrier_id
            WHERE m.entity_id IN (SELECT m2.entity_id FROM raw_mentions m2 JOIN carriers c2 ON m2.carrier_id = c2.carrier_id WHERE c2.year BETWEEN 1997 AND 1998)) GROUP BY entity_type"""
        ),
    ),
    "domain_terms": (
        domain_seeds,
        sql(
            r"""SELECT tier, term, count(*) AS mentions, count(DISTINCT carrier_id) AS orders, count(DISTINCT m.entity_id) AS entities FROM raw_mentions m JOIN entities e ON m.entity_id = e.entity_id
            JOIN (VALUES ('core', 'small ring', 'small[\s-]+ring'), ('core', 'red widget', 'red[\s-]+widget'), ('wide', 'widget', 'widget')) t(tier, term, p)
            ON regexp_matches(lower(e.entity_name), '(^|[^a-z0-9])' || t.p || '([^a-z0-9]|$)') GROUP BY tier, term"""
        ),
    ),
    "induced_and_context_edges": (
        induced_edges,
        sql("""SELECT count(*) FILTER (c_acctbal > 5000 AND year = 1997) AS both_ends, count(DISTINCT project_id) FILTER (c_acctbal > 5000 AND year = 1997) AS customers, count(*) FILTER (c_acctbal > 5000 OR year = 1997) AS either_end
        FROM carriers JOIN customer ON project_id = CAST(c_custkey AS VARCHAR)"""),
    ),
    "graph_filter": (
        filtered_graph,
        sql(
            """SELECT node_type, count(*) AS rows_before, count(*) FILTER (kept) AS rows_after, count(*) - count(*) FILTER (kept) AS rows_removed FROM (
            SELECT n.node_type, (n.entity_type IS NULL OR n.entity_type <> 'species') AND (n.node_type, n.node_id) IN (
              SELECT (x.source_type, x.source_id) FROM edges x JOIN nodes t ON x.target_type = t.node_type AND x.target_id = t.node_id WHERE t.entity_type IS NULL OR t.entity_type <> 'species'
              UNION SELECT (x.target_type, x.target_id) FROM edges x JOIN nodes t ON x.target_type = t.node_type AND x.target_id = t.node_id WHERE t.entity_type IS NULL OR t.entity_type <> 'species') AS kept
            FROM nodes n) GROUP BY node_type""",
            GRAPH,
        ),
    ),
    "project_rollup": (
        project_rollup,
        """SELECT CAST(o_custkey AS VARCHAR) AS project_id, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year, count(DISTINCT year(o_orderdate)) AS years,
        count(DISTINCT o_orderkey) AS applications, round(sum(o_totalprice), 2) AS cost, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS earliest FROM orders GROUP BY o_custkey""",
    ),
    "mention_aggregate": (
        mention_aggregate,
        sql("""SELECT carrier_id, entity_id, count(*) AS n, count(DISTINCT field) AS fields, string_agg(DISTINCT field, '|' ORDER BY field) AS field_list, min(start) AS first_start, max(start) AS last_start,
        round(avg(prob), 6) AS mean_prob, round(max(prob), 6) AS most_prob, bool_or(field = 'R') AS has_return FROM raw_mentions GROUP BY ALL"""),
    ),
    "mention_compression": (
        mention_compression,
        sql("SELECT substr(entity_id, 1, 1) AS side, count(*) AS raw_rows, count(DISTINCT (carrier_id, entity_id)) AS rows, round(count(DISTINCT (carrier_id, entity_id)) / count(*), 6) AS ratio FROM raw_mentions GROUP BY 1"),
    ),
    "carrier_vectors": (
        carrier_vectors,
        sql("SELECT carrier_id, count(*) AS n, sum(w) AS weight, round(sqrt(sum(w * w)), 6) AS l2 FROM (SELECT carrier_id, entity_id, CAST(count(*) AS DOUBLE) AS w FROM raw_mentions GROUP BY ALL) GROUP BY carrier_id"),
    ),
    "node_index": (
        node_index,
        sql("""SELECT node_type, n, CAST(before AS BIGINT) AS low, CAST(before + n - 1 AS BIGINT) AS high, n - 1 AS type_high, n AS distinct_idx FROM (
        SELECT entity_type AS node_type, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY entity_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM entities GROUP BY entity_type)"""),
    ),
    "node_labels": (label_choice, sql("SELECT * FROM nodes WHERE node_type <> 'order'", GRAPH)),
    "structure_at_cutoffs": (
        structure_at_cutoffs,
        sql("""SELECT entity_type, cutoff, count(*) AS n, round(avg(degree), 6) AS degree_mean, max(degree) AS degree_max, CAST(sum(degree) AS BIGINT) AS degree_sum, round(stddev_pop(degree), 5) AS degree_std, CAST(sum(weight) AS BIGINT) AS weight FROM (
        SELECT m.entity_id, e.entity_type, t.cutoff, count(DISTINCT m.carrier_id) AS degree, count(*) AS weight FROM raw_mentions m JOIN carriers c ON m.carrier_id = c.carrier_id JOIN entities e ON m.entity_id = e.entity_id
        JOIN (VALUES (1996), (1997), (1998)) t(cutoff) ON c.year <= t.cutoff GROUP BY ALL) GROUP BY entity_type, cutoff"""),
    ),
    "flux_step": (
        flux_step,
        sql("SELECT dst AS node, round(sum(weight * (a.u - b.u)) / sum(weight), 6) AS flux FROM nation_edges JOIN state a ON src = a.node JOIN state b ON dst = b.node GROUP BY dst", NATIONS),
    ),
    "neighbour_mean_step": (
        neighbour_mean_step,
        sql("SELECT dst AS node, round(sum(weight * u) / sum(weight), 6) AS mean FROM (SELECT * FROM nation_edges UNION ALL SELECT node, node, 1.0 FROM state) JOIN state ON src = node GROUP BY dst", NATIONS),
    ),
    "relation_triples": (
        relation_triples,
        """SELECT edge_type, CAST(row_number() OVER (ORDER BY edge_type) - 1 AS INTEGER) AS relation, triples, heads, tails FROM (SELECT edge_type, count(*) AS triples, count(DISTINCT head) AS heads, count(DISTINCT tail) AS tails FROM (
        SELECT DISTINCT o_orderkey AS head, 'ordered_by' AS edge_type, o_custkey AS tail FROM orders UNION SELECT n_nationkey, 'in_region', n_regionkey FROM nation) GROUP BY edge_type)""",
    ),
    "reverse_edges": (
        reverse_edges,
        sql("""SELECT edge_type, source_type, target_type, count(*) AS edges, count(DISTINCT source_id) AS sources FROM (SELECT edge_type, source_type, source_id, target_type FROM edges
        UNION ALL SELECT edge_type || '__rev', target_type, target_id, source_type FROM edges) GROUP BY ALL""", GRAPH),
    ),
    "context_without_target": (context_without_target, sql("SELECT edge_type, count(*) AS edges, round(sum(weight), 6) AS weight FROM edges WHERE edge_type <> 'ordered_by' GROUP BY edge_type", GRAPH)),
    "triple_scores": (
        triple_scores,
        """SELECT h.vec_id AS h, t.vec_id AS t, round(list_sum(list_transform(range(1, 65), lambda i: CAST(h.embedding[i] AS DOUBLE) * cos(i - 1) * CAST(t.embedding[i] AS DOUBLE))), 6) AS distmult,
        round(-sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(h.embedding[i] AS DOUBLE) + cos(i - 1) - CAST(t.embedding[i] AS DOUBLE), 2)))), 6) AS transe
        FROM embeddings h JOIN embeddings t ON t.vec_id = h.vec_id + 1""",
    ),
}
ROWS_ONLY = {"connected_components": components, "walk_vectors": walk_vectors, "typed_walk_vectors": typed_walk_vectors}
