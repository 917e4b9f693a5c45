"""Domain selection, year filters, audits of links and ids, and steps and walks on the whole graphs, on the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.functions import expr
from evgraph.operators import audit, forecast, graph, neighbourhoods, selection
from evgraph.plans import feature_plans, unit_plans
from evgraph.plans.bindings import carriers, entities, raw_mentions, sql, table
from evgraph.plans.feature_plans import STATE
from evgraph.plans.unit_plans import WIDE_EDGES, YEARLY

TERM = "red widget"
WINDOW = (1996, 1998)


def matched_entities(s, d) -> DataFrame:
    return entities(s, d).filter(F.lower("entity_name").rlike(r"(^|[^a-z0-9])red[\s-]+widget([^a-z0-9]|$)")).select("entity_id")


def seeds(s, d) -> DataFrame:
    """Orders of 1997 that mention a matched part, by modality, and customers with a high balance."""
    hits = raw_mentions(s, d).join(matched_entities(s, d), "entity_id", "left_semi").select("carrier_id").distinct()
    found = carriers(s, d).filter("year = 1997").join(hits, "carrier_id", "left_semi").select(F.col("carrier_type").alias("kind"), F.col("carrier_id").alias("id"))
    rich = table(s, d, "customer").filter("c_acctbal > 9900").select(F.lit("project").alias("kind"), F.concat(F.lit("C"), "c_custkey").alias("id"))
    return found.unionByName(rich)


def carrier_selection(s, d):
    links = graph.written(feature_plans.carrier_links(s, d).filter("edge_type <> 'mentions'"), "carrier-links")
    start = graph.written(seeds(s, d), "seeds")
    parts = [selection.select_carriers(start, links, m).groupBy("kind").agg(F.count("*").alias("carriers")).withColumn("mode", F.lit(m)) for m in selection.EXPANSIONS]
    return audit.union_all(parts).select("mode", "kind", "carriers")


def entity_modes(s, d):
    """Entities of the seed orders, all of them and those that the term matched, by type."""
    chosen = seeds(s, d).filter("kind <> 'project'").select(F.col("id").alias("carrier_id"))
    m = raw_mentions(s, d)
    parts = [selection.entities_of(m, chosen, x).withColumn("mode", F.lit(n)) for n, x in (("all", None), ("matched", matched_entities(s, d)))]
    return audit.union_all(parts).join(entities(s, d), "entity_id").groupBy("mode", "entity_type").agg(F.count("*").alias("entities"))


def _year_filter(s, d):
    li = table(s, d, "lineitem")
    known = expr.key(F.col("l_orderkey"))
    candidates = li.select(F.when(F.col("l_linenumber") == 7, F.concat(F.lit("X"), known)).otherwise(known).alias("id"))
    return selection.filter_by_year(candidates, feature_plans.undated_carriers(s, d).select(F.col("carrier_id").alias("id"), "year"), *WINDOW)


def year_filter_accounts(s, d):
    return _year_filter(s, d)[1]


def year_filter_histogram(s, d):
    return _year_filter(s, d)[2]


def _project_links(s, d):
    c = feature_plans.undated_carriers(s, d)
    selected = carriers(s, d).filter("year = 1997").select(F.col("carrier_type").alias("kind"), F.col("carrier_id").alias("id"))
    return selection.project_links(c.select(F.col("carrier_type").alias("kind"), "carrier_id", "project_id", "year"), selected)


def project_link_summary(s, d):
    return _project_links(s, d)[0]


def project_link_years(s, d):
    return _project_links(s, d)[1]


def year_range_check(s, d):
    return forecast.year_checks(unit_plans.by_year(s, d), unit_plans.cutoffs(s), 1995)


def context_edge_dedup(s, d):
    e = table(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("supplier_id"), F.year("l_shipdate").alias("record_year"), F.col("l_returnflag").alias("flag"))
    return selection.dedup_context(e, ["order_id", "supplier_id"], "record_year")


def link_table_profile(s, d):
    found = [audit.link_profile(table(s, d, t), t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")]
    return audit.union_all([f for f in found if f is not None])


def id_checks(s, d):
    c, p, o = table(s, d, "customer"), table(s, d, "part"), table(s, d, "orders")
    return audit.union_all([
        audit.normalization(c, "c_name", "customer_name"), audit.normalization(p, "p_name", "part_name"), audit.normalization(o, "o_orderstatus", "order_status"), audit.normalization(o, "project_id", "project"),
        audit.ungrounded(c, "c_mktsegment", "segment", "machinery"), audit.ungrounded(p, "p_type", "part_type", "ungrounded"),
    ])


def _incoming(s, d) -> tuple[DataFrame, DataFrame]:
    """Sums over the edges that lead to each unit of the unit graph with the reference's bounds, and the units' carriers up to the last cutoff."""
    held = unit_plans.stored_evidence(s, d)
    state = feature_plans.diffusion_state(s, d, held).filter("cutoff = 1998").select("unit_id", "cutoff", F.col("history_total").alias("u"))
    state = graph.written(state, "state")
    return neighbourhoods.pooled(unit_plans.unit_ends(s, d, held), state, [1998], ["u"], unit_plans.WIDE, incoming=True), state


def unit_flux(s, d):
    return neighbourhoods.flux(*_incoming(s, d), "u")


def unit_neighbour_mean(s, d):
    return neighbourhoods.neighbour_mean(*_incoming(s, d), "u")


SEEDS = r"""matched AS (SELECT entity_id FROM entities WHERE regexp_matches(lower(entity_name), '(^|[^a-z0-9])red[\s-]+widget([^a-z0-9]|$)')),
seeds AS (
  SELECT carrier_type AS kind, carrier_id AS id FROM carriers WHERE year = 1997 AND carrier_id IN (SELECT carrier_id FROM raw_mentions WHERE entity_id IN (SELECT entity_id FROM matched))
  UNION ALL SELECT 'project', 'C' || c_custkey FROM customer WHERE c_acctbal > 9900)"""
BOTH = """follows AS (SELECT carrier_id, carrier_type, lag(carrier_id) OVER w AS before_id, lag(carrier_type) OVER w AS before_type FROM carriers WINDOW w AS (PARTITION BY project_id ORDER BY year, carrier_id::BIGINT)),
one_way AS (SELECT carrier_type AS fk, carrier_id AS fi, 'project' AS tk, 'C' || project_id AS ti FROM carriers UNION ALL SELECT carrier_type, carrier_id, before_type, before_id FROM follows WHERE before_id IS NOT NULL),
both_ways AS (SELECT * FROM one_way UNION ALL SELECT tk, ti, fk, fi FROM one_way)"""


def _selected(mode: str) -> tuple[list[str], str]:
    """Tables of a mode's steps, and the query that counts what they leave."""
    tables, now, given = [], {}, {}
    for kind in ("base", "patent", "trial", "project"):
        tables.append(f"{mode}_{kind} AS (SELECT DISTINCT id FROM seeds WHERE kind = '{kind}')")
        now[kind] = given[kind] = f"{mode}_{kind}"
    for i, (to, start, which) in enumerate(selection.EXPANSIONS[mode]):
        known = (given if which == "seeds" else now)[start]
        tables.append(f"{mode}_{i} AS (SELECT id FROM {now[to]} UNION SELECT ti FROM both_ways WHERE fk = '{start}' AND tk = '{to}' AND fi IN (SELECT id FROM {known}))")
        now[to] = f"{mode}_{i}"
    return tables, " UNION ALL ".join(f"SELECT '{mode}' AS mode, '{k}' AS kind, count(*) AS carriers FROM {t} HAVING count(*) > 0" for k, t in now.items())


_MODES = [_selected(m) for m in selection.EXPANSIONS]
YEARS = """dated AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN 'base' WHEN 'O' THEN 'trial' WHEN 'P' THEN 'patent' END AS kind, CAST(o_custkey AS VARCHAR) AS project_id,
  CAST(CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN year(o_orderdate) END AS INTEGER) AS year FROM orders),
wanted AS (SELECT DISTINCT CASE WHEN l_linenumber = 7 THEN 'X' || l_orderkey ELSE CAST(l_orderkey AS VARCHAR) END AS id FROM lineitem)"""
_LINK = "SELECT '{0}' AS table_name, count(*) AS rows, '{1}' AS id_columns, '{2}' AS likely_sources, '{3}' AS likely_targets, count(*) - count(DISTINCT ({4})) AS duplicate_rows FROM {0}"
_LINKS = [("nation", "n_nationkey|n_regionkey"), ("customer", "c_custkey|c_nationkey"), ("supplier", "s_suppkey|s_nationkey"), ("orders", "o_orderkey|o_custkey"), ("events", "event_id|user_id")]
_BAD = "count(*) FILTER ({0} IS NULL OR trim({0}) = '' OR {0} <> upper({0}) OR {0} LIKE '% %' OR {0} LIKE '%-%')"
POINTS = "points(cutoff, split) AS (VALUES (1996, 'train'), (1997, 'validation'), (1998, 'test'))"
DIFFUSED = f"{YEARLY}, {POINTS}, {STATE}, {WIDE_EDGES}, last_state AS (SELECT unit_id AS node, history_total AS u FROM state WHERE cutoff = 1998)"


def _checked(name: str, column: str, source: str, bad: str, warning: str) -> str:
    return f"SELECT '{name}' AS \"check\", count(*) AS rows, {bad.format(column)} AS bad, CASE WHEN {bad.format(column)} > 0 THEN '{warning}' ELSE '' END AS warning FROM {source}"


ORACLES = {
    "carrier_selection": (carrier_selection, sql(" UNION ALL ".join(q for _, q in _MODES), ", ".join([SEEDS, BOTH, *(t for ts, _ in _MODES for t in ts)]))),
    "entity_modes": (
        entity_modes,
        sql(
            """SELECT mode, entity_type, count(*) AS entities FROM (
            SELECT DISTINCT m.entity_id, e.entity_type, t.mode FROM raw_mentions m JOIN entities e ON m.entity_id = e.entity_id CROSS JOIN (VALUES ('all'), ('matched')) t(mode)
            WHERE m.carrier_id IN (SELECT id FROM seeds WHERE kind <> 'project') AND (t.mode = 'all' OR m.entity_id IN (SELECT entity_id FROM matched))) GROUP BY ALL""",
            SEEDS,
        ),
    ),
    "year_filter_accounts": (
        year_filter_accounts,
        f"""WITH {YEARS} SELECT count(*) AS candidates, count(d.id) AS in_node_table, count(*) - count(d.id) AS not_in_node_table, count(*) FILTER (year BETWEEN 1996 AND 1998) AS kept, count(*) FILTER (year BETWEEN 1996 AND 1998) AS rows_in_window,
        count(*) FILTER (year NOT BETWEEN 1996 AND 1998) AS rows_out_of_window, count(*) FILTER (d.id IS NOT NULL AND year IS NULL) AS rows_without_year FROM wanted w LEFT JOIN dated d ON w.id = d.id""",
    ),
    "year_filter_histogram": (year_filter_histogram, f"WITH {YEARS} SELECT year, count(*) AS n FROM wanted JOIN dated USING (id) WHERE year BETWEEN 1996 AND 1998 GROUP BY year"),
    "project_link_summary": (
        project_link_summary,
        f"WITH {YEARS} SELECT kind, count(*) AS selected_carriers, count(*) AS matched_links, count(DISTINCT project_id) AS projects FROM dated WHERE id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE year(o_orderdate) = 1997) GROUP BY kind",
    ),
    "project_link_years": (
        project_link_years,
        f"WITH {YEARS} SELECT kind, year, count(*) AS links FROM dated WHERE year IS NOT NULL AND id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE year(o_orderdate) = 1997) GROUP BY ALL",
    ),
    "year_range_check": (
        year_range_check,
        sql(
            "SELECT min(year) AS year_min, max(year) AS year_max, count(*) AS rows, count(DISTINCT unit_id) AS units, 1995 AS history_start, 2001 AS last_future_end, 1995 >= min(year) AS history_covered, 2001 <= max(year) AS future_covered FROM by_year",
            YEARLY,
        ),
    ),
    "context_edge_dedup": (
        context_edge_dedup,
        """SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_suppkey AS VARCHAR) AS supplier_id, count(*) AS edge_record_count, min(year(l_shipdate)) AS min_record_year, max(year(l_shipdate)) AS max_record_year,
        CAST(min(year(l_shipdate)) AS INTEGER) AS record_year, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_suppkey""",
    ),
    "link_table_profile": (link_table_profile, " UNION ALL ".join(_LINK.format(t, ids, *ids.split("|"), ids.replace("|", ", ")) for t, ids in _LINKS)),
    "id_checks": (
        id_checks,
        " UNION ALL ".join([
            _checked("customer_name", "c_name", "customer", _BAD, "ids not fully normalized"), _checked("part_name", "p_name", "part", _BAD, "ids not fully normalized"), _checked("order_status", "o_orderstatus", "orders", _BAD, "ids not fully normalized"),
            "SELECT 'project', NULL, NULL, 'missing column'",
            _checked("segment", "c_mktsegment", "customer", "count(*) FILTER (upper(trim({0})) = 'MACHINERY')", "ungrounded ids present"), _checked("part_type", "p_type", "part", "count(*) FILTER (upper(trim({0})) = 'UNGROUNDED')", "ungrounded ids present"),
        ]),
    ),
    "unit_flux": (unit_flux, sql("SELECT dst AS node, round(sum(edge_weight * (a.u - b.u)) / sum(edge_weight), 6) AS flux FROM unit_edges JOIN last_state a ON src = a.node JOIN last_state b ON dst = b.node GROUP BY dst", DIFFUSED)),
    "unit_neighbour_mean": (
        unit_neighbour_mean,
        sql("SELECT dst AS node, round(sum(w * u) / sum(w), 6) AS mean FROM (SELECT src, dst, edge_weight AS w FROM unit_edges UNION ALL SELECT node, node, 1.0 FROM last_state) JOIN last_state ON src = node GROUP BY dst", DIFFUSED),
    ),
}
