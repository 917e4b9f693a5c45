"""Tables as such: expressions, parsing, set operations, ranking, profiles and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evgraph.functions import expr
from evgraph.operators import audit, joins
from evgraph.plans import graph_plans, unit_plans
from evgraph.plans.bindings import carriers, entities, raw_mentions, sql, table
from evgraph.sources import tables


def key_expressions(s, d):
    o = table(s, d, "orders")
    padded = F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" "))
    return o.select(
        "o_orderkey", expr.key(padded).alias("key"), expr.project_key(padded).alias("project"), expr.project_key(padded, "remove_spaces").alias("project_spaces"), expr.token(padded).alias("token"),
        expr.year_in_text(F.col("o_orderdate").cast("string")).alias("year"), expr.year(F.date_format("o_orderdate", "yyyy-MM-dd"), 1996, 2000).alias("bounded_year"), expr.number(F.col("o_orderpriority"), F.col("o_totalprice")).alias("number"),
        expr.grounded(F.col("o_orderstatus"), "P").alias("grounded"),
    )


def label_and_kind(s, d):
    """Kinds and semantic keys of all columns of the tables, by name."""
    names = [(t, c) for t in ("orders", "lineitem", "part", "supplier", "customer", "events", "documents") for c in table(s, d, t).columns]
    counts = audit.union_all([table(s, d, t).agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(t)) for t in ("orders", "lineitem", "part", "supplier", "customer", "events", "documents")])
    cat = s.range(1).select(F.explode(F.array(*(F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name")) for t, c in names))).alias("x")).select("x.*")
    fam = {"order": "orderkey", "part": "partkey", "supplier": "suppkey", "customer": "custkey", "document": "doc_id"}
    return cat.join(counts, "table_name").select("table_name", "column_name", "rows", expr.column_kind(F.col("column_name")).alias("kind"), expr.semantic_key(F.col("column_name"), fam).alias("family"))


def join_candidates(s, d):
    c = label_and_kind(s, d).filter("family is not null")
    a = c.select(F.col("table_name").alias("t1"), F.col("column_name").alias("c1"), F.col("kind").alias("k1"), "family")
    b = c.select(F.col("table_name").alias("t2"), F.col("column_name").alias("c2"), F.col("kind").alias("k2"), "family")
    j = a.join(b, "family").filter("t1 < t2")
    return j.select("family", "t1", "c1", "t2", "c2", F.when((F.col("k1") == "id") & (F.col("k2") == "id"), "high").otherwise("medium").alias("confidence"))


def quarantine(s, d):
    """Customers as tab-separated lines, with a tab inside of some names and fields missing from others."""
    c = table(s, d, "customer")
    name = F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit("\t"), "c_name")).otherwise(F.col("c_name"))
    line = F.when(F.col("c_custkey") % 5 == 0, F.concat_ws("\t", F.col("c_custkey").cast("string"), name)).otherwise(F.concat_ws("\t", F.col("c_custkey").cast("string"), name, F.col("c_mktsegment"), F.lit("")))
    rows, bad = tables.parse_lines(c.select(line.alias("value")), ["id", "name", "segment", "rest"])
    return rows.agg(F.count("*").alias("rows"), F.count("segment").alias("segments"), F.count("rest").alias("rest"), F.count_distinct("id").alias("ids")).join(bad.agg(F.count("*").alias("bad_rows"), F.max("fields").cast("bigint").alias("most_fields")), how="full")


def drift(s, d):
    p = tables.project(table(s, d, "part"), {"P_PARTKEY": "bigint", "p_size": "double", "p_missing": "string"})
    return p.agg(F.count("*").alias("rows"), F.sum("P_PARTKEY").alias("keys"), F.sum("p_size").alias("sizes"), F.count("p_missing").alias("missing"))


def roles(s, d):
    e = tables.canonical(table(s, d, "events"), {"unit": ["user", "user_id"], "period": ["ts", "date"], "modality": ["type"], "amount": ["weight", "value"], "none": ["abc"]})
    return e.groupBy("unit", F.col("modality")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("amount"), F.count("none").alias("none"))


def manifest(s, d):
    return tables.manifest({t: table(s, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")})


def schema_check(s, d):
    want = s.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("table_name"), F.lit(b).alias("column_list")) for a, b in (("region", "r_regionkey,r_name"), ("nation", "n_name,n_nationkey,n_regionkey"), ("gone", "x"))))).alias("x")).select("x.*")
    return tables.check_schemas(manifest(s, d), want)


def inventory(s, d):
    return tables.inventory(s, d, "*.parquet").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def semi_anti(s, d):
    li, p = table(s, d, "lineitem"), table(s, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    k = joins.keep_known(li, "l_partkey", p, "l_partkey").agg(F.count("*").alias("kept"), F.round(F.sum("l_quantity"), 2).alias("kept_quantity"))
    return k.join(joins.unmatched(li, "l_partkey", p, "l_partkey").agg(F.count("*").alias("unmatched"), F.round(F.sum("l_quantity"), 2).alias("unmatched_quantity")), how="full")


def before_after(s, d):
    o = table(s, d, "orders")
    return joins.compare_counts(o, o.filter("o_totalprice > 490000 and o_orderstatus <> 'F'"), "o_orderstatus")


def default_fill(s, d):
    late = table(s, d, "lineitem").filter("l_quantity >= 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return joins.attach(table(s, d, "supplier").select("s_suppkey", "s_name"), late, "s_suppkey", {"n": 0})


def range_join(s, d):
    """Orders so far at each cutoff."""
    cut = s.range(1996, 2001).select(F.col("id").cast("int").alias("cutoff"))
    return carriers(s, d).groupBy("carrier_type", "year").agg(F.count("*").alias("n")).join(F.broadcast(cut), F.col("year") <= F.col("cutoff")).groupBy("carrier_type", "cutoff").agg(F.sum("n").alias("orders"))


def merged(s, d):
    o = table(s, d, "orders")
    return joins.validated_merge(o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_orderstatus"), ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total"))


def set_operations(s, d):
    li, p = table(s, d, "lineitem"), table(s, d, "part")
    used, small = li.select(F.col("l_partkey").alias("k")).distinct(), p.filter("p_size < 25").select(F.col("p_partkey").alias("k"))
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("operation"), "n")
    return audit.union_all([n(used.union(small).distinct(), "union"), n(used.intersect(small), "intersect"), n(small.subtract(used), "difference"), n(used.unionAll(small), "union_all")])


def unpivoted(s, d):
    long = table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type").unpivot("p_partkey", ["p_name", "p_brand", "p_type"], "field", "text")
    return long.groupBy("field").agg(F.count("*").alias("rows"), F.count_distinct("text").alias("texts"), F.sum(F.length("text")).alias("characters"))


def pivoted(s, d):
    return carriers(s, d).groupBy("year").pivot("carrier_type", ["base", "patent", "trial"]).agg(F.count("carrier_id"))


def keep_first(s, d):
    o = table(s, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.asc_nulls_last("o_orderdate"), "o_orderkey")
    return o.withColumn("place", F.row_number().over(w)).filter("place = 1").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"))


def share_in_group(s, d):
    c = carriers(s, d).groupBy("year", "carrier_type").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("year")), 6))


def running_total(s, d):
    c = carriers(s, d).groupBy("carrier_type", "year").agg(F.count("*").alias("n"))
    return c.withColumn("so_far", F.sum("n").over(Window.partitionBy("carrier_type").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


def top_means(s, d):
    """Means of the ten largest values of three measures of each supplier: three ranks over one partitioning."""
    li = table(s, d, "lineitem")
    w = Window.partitionBy("l_suppkey")
    names = ("l_quantity", "l_extendedprice", "l_discount")
    r = li.withColumns({f"r_{c}": F.row_number().over(w.orderBy(F.desc(c), "l_orderkey", "l_linenumber", "l_partkey")) for c in names})
    return r.groupBy("l_suppkey").agg(*(F.round(F.avg(F.when(F.col(f"r_{c}") <= 10, F.col(c))), 5).alias(c) for c in names))


def quantile_strata(s, d):
    o = table(s, d, "orders")
    q = o.agg(F.expr("percentile(o_totalprice, array(0.25, 0.75))").alias("q"))
    name = F.when(F.col("o_totalprice") <= F.col("q")[0], "low").when(F.col("o_totalprice") >= F.col("q")[1], "high").otherwise("mid")
    return o.join(F.broadcast(q), F.lit(True), "left").groupBy(name.alias("stratum"), "o_orderstatus").agg(F.count("*").alias("n"))


def row_zscore(s, d):
    names = ["l_quantity", "l_extendedprice", "l_tax"]
    li = table(s, d, "lineitem")
    st = li.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_samp(c).alias(f"s_{c}") for c in names))
    z = sum((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in names) / len(names)
    return li.join(F.broadcast(st), F.lit(True), "left").groupBy("l_returnflag").agg(F.round(F.avg(z), 5).alias("mean"), F.round(F.max(z), 5).alias("most"), F.round(F.min(z), 5).alias("least"))


def minmax(s, d):
    o = table(s, d, "orders").withColumn("train", F.year("o_orderdate") < 1998)
    st = o.filter("train").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("o_totalprice") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return o.join(F.broadcast(st), F.lit(True), "left").groupBy("train").agg(F.round(F.avg(p), 6).alias("mean"), F.min(p).alias("least"), F.max(p).alias("most"))


def profile(s, d):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "conversations")
    out = audit.union_all([audit.profile(table(s, d, t), t) for t in names])
    return out.select("table_name", "column_name", "rows", "nulls", "distinct_values", "kind", "null_fraction")


def key_audits(s, d):
    pairs = (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("documents", "doc_id"))
    return audit.union_all([audit.key_audit(table(s, d, t), t, F.col(k)) for t, k in pairs])


def edge_audits(s, d):
    a = audit.edge_audit(table(s, d, "lineitem"), "lineitem", F.col("l_orderkey"), F.col("l_partkey"))
    return a.unionByName(audit.edge_audit(table(s, d, "orders"), "orders", F.col("o_orderkey"), F.col("o_custkey")))


def coverage(s, d):
    t = lambda n: table(s, d, n)
    return audit.union_all(
        [
            audit.coverage(t("lineitem"), F.col("l_orderkey"), t("orders"), F.col("o_orderkey"), "lineitem-orders"),
            audit.coverage(t("orders"), F.col("o_custkey"), t("customer"), F.col("c_custkey"), "orders-customer"),
            audit.coverage(t("labels"), F.col("doc_id"), t("documents"), F.col("doc_id"), "labels-documents"),
            audit.coverage(t("documents"), F.col("doc_id"), t("labels"), F.col("doc_id"), "documents-labels"),
        ]
    )


def key_trial(s, d):
    a = table(s, d, "orders").select(F.col("o_orderpriority").alias("k"))
    b = table(s, d, "orders").select(F.regexp_replace("o_orderpriority", "-", " ").alias("k")).distinct()
    return audit.key_trial(a, F.col("k"), b, F.col("k"), ["raw_trim_upper", "remove_spaces", "remove_hyphen_space"])


def unit_sanity(s, d):
    e = unit_plans.stored_evidence(s, d)
    return audit.unit_checks(unit_plans.stored_units(s, d, e), e, ["chemical-disease", "gene-disease", "chemical-gene"])


def audit_status(s, d):
    return audit.status(unit_sanity(s, d))


def endpoint_validation(s, d):
    e, n = graph_plans.all_edges(s, d), graph_plans.all_nodes(s, d)
    t = e.join(n.select(F.col("node_type").alias("target_type"), F.col("node_id").alias("target_id")), ["target_type", "target_id"], "left_anti").groupBy("edge_type").agg(F.count("*").alias("lost_targets"))
    o = e.join(n.select(F.col("node_type").alias("source_type"), F.col("node_id").alias("source_id")), ["source_type", "source_id"], "left_anti").groupBy("edge_type").agg(F.count("*").alias("lost_sources"))
    return e.groupBy("edge_type").agg(F.count("*").alias("edges")).join(t, "edge_type", "left").join(o, "edge_type", "left").fillna(0)


def scale_probe(s, d):
    """What a domain would select, counted without writing it."""
    seeds = entities(s, d).filter("entity_name like '%ring%'")
    m = raw_mentions(s, d).join(seeds.select("entity_id"), "entity_id", "left_semi")
    o = carriers(s, d).join(m.select("carrier_id"), "carrier_id", "left_semi")
    return seeds.agg(F.count("*").alias("entities")).join(m.agg(F.count("*").alias("links")), how="full").join(o.agg(F.count("*").alias("carriers"), F.count_distinct("project_id").alias("projects")), how="full")


def ungrounded(s, d):
    """Mentions whose entity isn't in the part table when it holds even sizes only, by field, with an approximate distinct count."""
    p = table(s, d, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("l_partkey"))
    return joins.unmatched(table(s, d, "lineitem"), "l_partkey", p, "l_partkey").groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.approx_count_distinct("l_partkey").alias("entities"))


def dense_check(s, d):
    p = unit_plans.dense_panel(s, d).agg(F.count("*").alias("rows"), F.count_distinct("unit_id").alias("units"), F.count_distinct("year").alias("years"))
    return p.withColumn("complete", F.col("rows") == F.col("units") * F.col("years"))


def heuristic_scores(s, d):
    u = unit_plans._examples(s, d)
    ratio = F.col("recent_3") / (F.col("history_total") - F.col("recent_3") + 1)
    return u.select("unit_id", "cutoff", (-F.col("idle")).alias("recency"), F.round(F.log1p("history_total"), 6).alias("activity"), F.round(ratio, 6).alias("growth"), F.round(F.log1p("recent_3") + F.log1p(ratio) * 0.5, 6).alias("hybrid"))


def json_events(s, d):
    e = table(s, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.round(F.sum("value"), 4).alias("value"), F.count_distinct("user_id").alias("users"))


TABLES = {"orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "supplier": "s_suppkey s_name s_nationkey s_acctbal", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars"}
PROFILED = TABLES | {"region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text"}
KIND = "CASE WHEN regexp_matches({c}, '(^|_)(id|key|pmid|number)$|key$|id$') THEN 'id' WHEN regexp_matches({c}, 'date|(^|_)ts$|time') THEN 'date' WHEN regexp_matches({c}, 'year') THEN 'year' WHEN regexp_matches({c}, 'title|text|abstract|name|comment|html') THEN 'text' ELSE 'other' END"
CATALOG = "catalog AS (SELECT table_name, column_name, rows, " + KIND.format(c="column_name") + " AS kind, CASE WHEN regexp_matches(column_name, 'orderkey') THEN 'order' WHEN regexp_matches(column_name, 'partkey') THEN 'part' WHEN regexp_matches(column_name, 'suppkey') THEN 'supplier' WHEN regexp_matches(column_name, 'custkey') THEN 'customer' WHEN regexp_matches(column_name, 'doc_id') THEN 'document' END AS family FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, unnest({cs.split()!r}) AS column_name, (SELECT count(*) FROM {t}) AS rows" for t, cs in TABLES.items()) + "))"
PROFILE = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, {KIND.format(c=repr(c))} AS kind, round((count(*) - count({c})) / count(*), 6) AS null_fraction FROM {t}" for t, cs in PROFILED.items() if t != "documents" for c in cs.split())


def _coverage(child: str, key: str, parent: str, parent_key: str) -> str:
    return f"""SELECT '{child}-{parent}' AS relation, *, round(matched_rows / nullif(rows, 0), 6) AS row_rate, round(matched_keys / nullif(keys, 0), 6) AS key_rate, coalesce(matched_rows / nullif(rows, 0) < 0.95, false) AS warns
    FROM (SELECT count(*) AS rows, count(p.k) AS matched_rows, count(DISTINCT c.{key}) AS keys, count(DISTINCT p.k) AS matched_keys FROM {child} c LEFT JOIN (SELECT DISTINCT {parent_key} AS k FROM {parent}) p ON c.{key} = p.k)"""


def _trial(mode: str, e: str, i: int) -> str:
    return f"SELECT '{mode}' AS mode, {i} AS priority, CAST(sum(n) FILTER (known) AS BIGINT) AS m0, count(*) FILTER (known) AS m1, CAST(sum(n) AS BIGINT) AS n0, count(*) AS n1 FROM (SELECT {e.format(k='o_orderpriority')} AS k, count(*) AS n, {e.format(k='o_orderpriority')} IN (SELECT {e.format(k=chr(34) + 'v' + chr(34))} FROM (SELECT DISTINCT replace(o_orderpriority, '-', ' ') AS v FROM orders)) AS known FROM orders GROUP BY ALL)"


ORACLES = {
    "key_expressions": (
        key_expressions,
        """SELECT o_orderkey, nullif(trim(o_orderpriority), '') AS key, nullif(replace(replace(upper(trim(o_orderpriority)), ' ', ''), '-', ''), '') AS project, nullif(replace(upper(trim(o_orderpriority)), ' ', ''), '') AS project_spaces,
        nullif(regexp_replace(lower(trim(o_orderpriority)), '[\\s_-]+', '-', 'g'), '') AS token, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN year(o_orderdate) BETWEEN 1996 AND 2000 THEN CAST(year(o_orderdate) AS INTEGER) END AS bounded_year,
        coalesce(TRY_CAST(o_orderpriority AS DOUBLE), o_totalprice) AS number, o_orderstatus <> 'P' AS grounded FROM orders""",
    ),
    "column_kinds": (label_and_kind, f"WITH {CATALOG} SELECT * FROM catalog"),
    "join_candidates": (join_candidates, f"WITH {CATALOG} SELECT a.family, a.table_name AS t1, a.column_name AS c1, b.table_name AS t2, b.column_name AS c2, CASE WHEN a.kind = 'id' AND b.kind = 'id' THEN 'high' ELSE 'medium' END AS confidence FROM catalog a JOIN catalog b ON a.family = b.family AND a.table_name < b.table_name"),
    "bad_row_quarantine": (
        quarantine,
        """SELECT count(*) FILTER (NOT bad) AS rows, count(*) FILTER (NOT bad AND (c_custkey % 5 <> 0 OR c_custkey % 7 = 0)) AS segments, 0::BIGINT + count(*) FILTER (NOT bad AND c_custkey % 5 <> 0 AND c_custkey % 7 = 0 AND false) AS rest,
        count(DISTINCT c_custkey) FILTER (NOT bad) AS ids, count(*) FILTER (bad) AS bad_rows, CAST(5 AS BIGINT) AS most_fields FROM (SELECT c_custkey, c_custkey % 7 = 0 AND c_custkey % 5 <> 0 AS bad FROM customer)""",
    ),
    "drift_tolerant_projection": (drift, "SELECT count(*) AS rows, CAST(sum(p_partkey) AS BIGINT) AS keys, CAST(sum(p_size) AS DOUBLE) AS sizes, CAST(0 AS BIGINT) AS missing FROM part"),
    "column_roles": (roles, "SELECT user_id AS unit, event_type AS modality, count(*) AS n, round(sum(value), 4) AS amount, CAST(0 AS BIGINT) AS none FROM events GROUP BY ALL"),
    "table_manifest": (manifest, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, CAST({len(PROFILED[t].split())} AS BIGINT) AS columns, '{','.join(PROFILED[t].split())}' AS column_list FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))),
    "semi_and_anti_join": (
        semi_anti,
        "SELECT count(*) FILTER (p_size < 10) AS kept, round(sum(l_quantity) FILTER (p_size < 10), 2) AS kept_quantity, count(*) FILTER (p_size >= 10 OR p_size IS NULL) AS unmatched, round(sum(l_quantity) FILTER (p_size >= 10 OR p_size IS NULL), 2) AS unmatched_quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
    ),
    "before_after_counts": (before_after, "SELECT o_orderstatus, count(*) AS rows_before, count(*) FILTER (o_totalprice > 490000 AND o_orderstatus <> 'F') AS rows_after, count(*) - count(*) FILTER (o_totalprice > 490000 AND o_orderstatus <> 'F') AS rows_removed FROM orders GROUP BY o_orderstatus"),
    "default_fill": (default_fill, "SELECT s_suppkey, s_name, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity >= 49 GROUP BY l_suppkey) ON s_suppkey = l_suppkey"),
    "cutoff_range_join": (range_join, sql("SELECT carrier_type, cutoff, count(*) AS orders FROM carriers JOIN (SELECT CAST(unnest(range(1996, 2001)) AS INTEGER) AS cutoff) ON year <= cutoff GROUP BY ALL")),
    "validated_merge": (merged, "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 1) AS total FROM orders GROUP BY o_orderstatus"),
    "set_operations": (
        set_operations,
        """WITH used AS (SELECT DISTINCT l_partkey AS k FROM lineitem), small AS (SELECT p_partkey AS k FROM part WHERE p_size < 25)
        SELECT 'union' AS operation, count(*) AS n FROM (SELECT * FROM used UNION SELECT * FROM small) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM used INTERSECT SELECT * FROM small)
        UNION ALL SELECT 'difference', count(*) FROM (SELECT * FROM small EXCEPT SELECT * FROM used) UNION ALL SELECT 'union_all', count(*) FROM (SELECT * FROM used UNION ALL SELECT * FROM small)""",
    ),
    "unpivot_text_fields": (unpivoted, "SELECT field, count(*) AS rows, count(DISTINCT text) AS texts, CAST(sum(length(text)) AS BIGINT) AS characters FROM (UNPIVOT (SELECT p_partkey, p_name, p_brand, p_type FROM part) ON p_name, p_brand, p_type INTO NAME field VALUE text) GROUP BY field"),
    "pivot_modalities": (pivoted, sql("SELECT year, nullif(count(*) FILTER (carrier_type = 'base'), 0) AS base, nullif(count(*) FILTER (carrier_type = 'patent'), 0) AS patent, nullif(count(*) FILTER (carrier_type = 'trial'), 0) AS trial FROM carriers GROUP BY year")),
    "keep_first": (keep_first, "SELECT o_custkey, o_orderkey, o_totalprice AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey) = 1"),
    "share_in_group": (share_in_group, sql("SELECT year, carrier_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY year), 6) AS share FROM carriers GROUP BY year, carrier_type")),
    "running_total": (running_total, sql("SELECT carrier_type, year, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY carrier_type ORDER BY year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM carriers GROUP BY carrier_type, year")),
    "top_ten_means": (
        top_means,
        "SELECT l_suppkey, " + ", ".join(f"round(avg({c}) FILTER (r{i} <= 10), 5) AS {c}" for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount")))
        + " FROM (SELECT *, " + ", ".join(f"row_number() OVER (PARTITION BY l_suppkey ORDER BY {c} DESC, l_orderkey, l_linenumber, l_partkey) AS r{i}" for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount"))) + " FROM lineitem) GROUP BY l_suppkey",
    ),
    "quantile_strata": (quantile_strata, "SELECT CASE WHEN o_totalprice <= lo THEN 'low' WHEN o_totalprice >= hi THEN 'high' ELSE 'mid' END AS stratum, o_orderstatus, count(*) AS n FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS lo, quantile_cont(o_totalprice, 0.75) AS hi FROM orders) GROUP BY ALL"),
    "row_zscore": (
        row_zscore,
        "SELECT l_returnflag, round(avg(z), 5) AS mean, round(max(z), 5) AS most, round(min(z), 5) AS least FROM (SELECT l_returnflag, ((l_quantity - m0) / s0 + (l_extendedprice - m1) / s1 + (l_tax - m2) / s2) / 3 AS z FROM lineitem, (SELECT avg(l_quantity) AS m0, stddev_samp(l_quantity) AS s0, avg(l_extendedprice) AS m1, stddev_samp(l_extendedprice) AS s1, avg(l_tax) AS m2, stddev_samp(l_tax) AS s2 FROM lineitem)) GROUP BY l_returnflag",
    ),
    "minmax_probability": (minmax, "SELECT train, round(avg(p), 6) AS mean, min(p) AS least, max(p) AS most FROM (SELECT year(o_orderdate) < 1998 AS train, greatest(0.0, least(1.0, (o_totalprice - lo) / (hi - lo))) AS p FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE year(o_orderdate) < 1998)) GROUP BY train"),
    "column_profile": (profile, PROFILE),
    "key_audit": (
        key_audits,
        " UNION ALL ".join(f"SELECT '{t}' AS table_name, *, rows - missing - distinct_keys AS repeated, concat_ws(';', CASE WHEN rows = 0 THEN 'empty' END, CASE WHEN missing > 0 THEN 'missing keys' END, CASE WHEN rows - missing - distinct_keys > 0 THEN 'repeated keys' END) AS warnings FROM (SELECT count(*) AS rows, count(*) - count({k}) AS missing, count(DISTINCT {k}) AS distinct_keys FROM {t})" for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("documents", "doc_id"))),
    ),
    "edge_audit": (edge_audits, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, count(*) - count({a}) AS missing_sources, count(*) - count({b}) AS missing_targets, count(DISTINCT {a}) AS sources, count(DISTINCT {b}) AS targets, count(*) - count(DISTINCT ({a}, {b})) AS repeated_pairs FROM {t}" for t, a, b in (("lineitem", "l_orderkey", "l_partkey"), ("orders", "o_orderkey", "o_custkey")))),
    "foreign_key_coverage": (coverage, " UNION ALL ".join(_coverage(*x) for x in (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id")))),
    "key_normalization_trial": (
        key_trial,
        "SELECT mode, coalesce(m0, 0) AS matched_rows, m1 AS matched_keys, round(coalesce(m0, 0) / n0, 6) AS row_rate, round(m1 / n1, 6) AS key_rate, row_number() OVER (ORDER BY m1 / n1 DESC, coalesce(m0, 0) / n0 DESC, priority) = 1 AS best FROM ("
        + " UNION ALL ".join(_trial(m, e, i) for i, (m, e) in enumerate((("raw_trim_upper", "upper(trim({k}))"), ("remove_spaces", "replace(upper(trim({k})), ' ', '')"), ("remove_hyphen_space", "replace(replace(upper(trim({k})), ' ', ''), '-', '')")))) + ")",
    ),
    "unit_sanity": (
        unit_sanity,
        sql("""SELECT *, violations = 0 AS passed FROM (
        SELECT 'unknown_pair_type' AS "check", count(*) FILTER (pair_type NOT IN ('chemical-disease', 'gene-disease', 'chemical-gene')) AS violations FROM units UNION ALL SELECT 'repeated_unit', count(*) - count(DISTINCT unit_id) FROM units
        UNION ALL SELECT 'self_pair', count(*) FILTER (entity_a = entity_b) FROM units UNION ALL SELECT 'reversed_pair', count(*) - count(DISTINCT pair_type || least(entity_a, entity_b) || greatest(entity_a, entity_b)) FROM units
        UNION ALL SELECT 'evidence_without_unit', count(*) FROM unit_evidence WHERE unit_id NOT IN (SELECT unit_id FROM units)
        UNION ALL SELECT 'count_mismatch', count(*) FILTER (n IS DISTINCT FROM carrier_count) FROM units LEFT JOIN (SELECT unit_id, count(DISTINCT carrier_key) AS n FROM unit_evidence GROUP BY unit_id) USING (unit_id))"""),
    ),
    "audit_status": (audit_status, sql("SELECT CAST(6 AS BIGINT) AS checks, count(*) FILTER (entity_a = entity_b) AS failed, 'PASS' AS status FROM units")),
    "endpoint_validation": (
        endpoint_validation,
        sql("SELECT edge_type, count(*) AS edges, count(*) FILTER (t.node_id IS NULL) AS lost_targets, count(*) FILTER (o.node_id IS NULL) AS lost_sources FROM edges LEFT JOIN nodes t ON target_type = t.node_type AND target_id = t.node_id LEFT JOIN nodes o ON source_type = o.node_type AND source_id = o.node_id GROUP BY edge_type", graph_plans.GRAPH),
    ),
    "scale_probe": (
        scale_probe,
        sql("SELECT (SELECT count(*) FROM seeds) AS entities, (SELECT count(*) FROM hits) AS links, count(*) AS carriers, count(DISTINCT project_id) AS projects FROM carriers WHERE carrier_id IN (SELECT carrier_id FROM hits)", "seeds AS (SELECT * FROM entities WHERE entity_name LIKE '%ring%'), hits AS (SELECT * FROM raw_mentions WHERE entity_id IN (SELECT entity_id FROM seeds))"),
    ),
    "dense_panel_check": (dense_check, sql("SELECT units * 7 AS rows, units, CAST(7 AS BIGINT) AS years, true AS complete FROM (SELECT count(*) AS units FROM units)")),
    "heuristic_scores": (
        heuristic_scores,
        sql("SELECT unit_id, cutoff, -idle AS recency, round(ln(1 + history_total), 6) AS activity, round(recent_3 / (history_total - recent_3 + 1), 6) AS growth, round(ln(1 + recent_3) + 0.5 * ln(1 + recent_3 / (history_total - recent_3 + 1)), 6) AS hybrid FROM examples", unit_plans.EXAMPLES),
    ),
    "event_properties": (json_events, "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, round(sum(value), 4) AS value, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"),
}
ROWS_ONLY = {"schema_check": schema_check, "source_inventory": inventory, "ungrounded_mentions": ungrounded}
