"""Entity-pair units, panels and forecasts on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evgraph.functions import expr
from evgraph.operators import forecast, neighbourhoods, panel, units
from evgraph.operators.graph import written
from evgraph.plans.bindings import CUTOFFS, HORIZON, PAIR_TYPES, carriers, entities, raw_mentions, sql

MODES = ["base", "patent", "trial"]
FOLLOW = ["patent", "trial"]
DEALT = ("entity_a", "entity_b")  # the columns that supported evidence is dealt by
POINTS = [c for c, _ in CUTOFFS]
NARROW, WIDE = (2, 40, 10), (2, 2000, 100)  # least and largest degree of an entity, neighbours of a unit


def mentions(s, d):
    return units.standardize(raw_mentions(s, d), carriers(s, d), entities(s, d), ["species"])


def evidence(s, d):
    return units.evidence(mentions(s, d), PAIR_TYPES)


def supported(s, d):
    return units.supported_evidence(mentions(s, d), PAIR_TYPES, 2)


def unit_master(s, d, e=None):
    """e: the supported evidence, where a query has it stored."""
    return units.master(supported(s, d) if e is None else e, MODES)


def by_year(s, d, e=None, dealt=DEALT, keep=False):
    return panel.yearly(supported(s, d) if e is None else e, MODES, dealt, keep)


def stored_evidence(s, d):
    """The supported evidence written once, for queries that read it several times."""
    return written(supported(s, d), "evidence")


def stored_units(s, d, e=None):
    return written(unit_master(s, d, e), "units")


def mention_counts(s, d):
    return mentions(s, d).groupBy("carrier_type", "entity_type", "year").agg(F.count("*").alias("pairs"), F.sum("mention_count").alias("mentions"))


def pair_evidence(s, d):
    e = evidence(s, d)
    return e.groupBy("pair_type", "carrier_type").agg(F.count("*").alias("rows"), F.count_distinct("unit_id").alias("units"), F.round(F.sum("pair_weight"), 4).alias("weight"))


def pair_weights(s, d):
    e = evidence(s, d)
    a, b = F.col("mention_count_a"), F.col("mention_count_b")
    return e.groupBy("pair_type").agg(*(F.round(F.sum(expr.pair_weight(a, b, m)), 4).alias(m) for m in ("sqrt_product", "min", "product", "sum", "mean")))


def build_summary(s, d):
    raw = raw_mentions(s, d).agg(F.count("*").alias("raw_rows"))
    kept = mentions(s, d).agg(F.count("*").alias("mention_rows"), F.count_distinct("carrier_key").alias("carriers"))
    u = unit_master(s, d).agg(F.count("*").alias("units"), F.min("carrier_count").alias("least_support"), F.round(F.expr("percentile(carrier_count, 0.5)"), 6).alias("median_support"), F.max("carrier_count").alias("most_support"))
    return raw.join(kept, how="full").join(u, how="full")


def support_sweep(s, d):
    e = evidence(s, d).groupBy("unit_id").agg(F.count_distinct("carrier_key").alias("carrier_count"), F.count("*").alias("rows"))
    return units.support_sweep(e, [1, 2, 3, 5])


def type_summary(s, d):
    return unit_master(s, d).groupBy("pair_type").agg(F.count("*").alias("units"), F.sum("carrier_count").alias("carriers"), F.round(F.avg("carrier_count"), 6).alias("mean_carriers"), F.round(F.avg("total_weight"), 5).alias("mean_weight"))


def flags(s, d):
    u = unit_master(s, d)
    f = {"P": F.col("base_count") > 0, "A": F.col("patent_count") > 0, "T": F.col("trial_count") > 0}
    u = u.withColumn("pattern", expr.evidence_pattern(f)).withColumn("modalities", sum(x.cast("int") for x in f.values()))
    return u.groupBy("pattern").agg(F.count("*").alias("units"), F.max("modalities").alias("modalities"))


def capped(s, d):
    return units.cap_entities(mentions(s, d), 3).groupBy("carrier_type").agg(F.count("*").alias("rows"), F.sum("mention_count").alias("mentions"))


def entities_per_carrier(s, d):
    n = mentions(s, d).groupBy("carrier_key", "carrier_type").agg(F.count_distinct("entity_id").alias("n"))
    q = lambda p: F.round(F.expr(f"percentile(n, {p})"), 6)
    return n.groupBy("carrier_type").agg(F.min("n").alias("least"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


def entity_hubs(s, d):
    # the units, each once and with two entities that differ, so that a degree is a plain count
    u = supported(s, d).select("entity_a", "entity_b", "pair_type").distinct()
    # written, as its rows and their ranks are met
    deg = written(u.select(F.explode(F.array("entity_a", "entity_b")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("degree")), "degrees")
    from evgraph.operators.metrics import midranks

    n = deg.agg(F.count("*").alias("n"))
    ranks = midranks(deg.withColumn("g", F.lit(1)), ["g"], "degree").drop("g")
    return deg.join(F.broadcast(ranks), "degree").join(F.broadcast(n), F.lit(True), "left").select("entity_id", "degree", F.round(F.col("midrank") / F.col("n"), 6).alias("percentile"))


def top_units(s, d):
    return unit_master(s, d).orderBy(F.desc("carrier_count"), F.desc("total_weight"), "unit_id").limit(25).select("unit_id", "pair_type", "carrier_count", "total_weight")


def stored_examples(s, d, e=None):
    return written(_examples(s, d, e), "examples")


def dense_panel(s, d):
    p = panel.dense(by_year(s, d, keep=True), 1995, 2001, ["carriers", "rows"], DEALT)
    return p.select("unit_id", "year", "carriers", "rows", "carriers_so_far", "rows_so_far", "base_carriers", "patent_carriers", "trial_carriers", F.round("weight", 6).alias("weight"))


def panel_years(s, d):
    p = panel.dense(by_year(s, d, keep=True), 1995, 2001, ["carriers"], DEALT)
    return p.groupBy("year").agg(F.count_if(F.col("carriers") > 0).alias("active_units"), F.count_if(F.col("carriers_so_far") > 0).alias("seen_units"), F.sum("carriers").alias("carriers"), F.count("*").alias("units"))


def first_events(s, d):
    return panel.first_events(by_year(s, d), MODES)


def lags(s, d, e=None):
    return panel.lags(panel.first_years(panel.first_events(by_year(s, d, e), MODES), MODES), "base", FOLLOW)


def unit_sequences(s, d):
    q = panel.sequences(by_year(s, d), ["carriers"])
    text = F.array_join(F.transform("steps", lambda x: F.concat_ws(":", x["year"].cast("string"), x["carriers"].cast("string"))), ";")
    return q.select("unit_id", F.size("steps").cast("bigint").alias("n"), text.alias("steps"))


def cutoffs(s):
    return forecast.cutoff_table(s, CUTOFFS, HORIZON, 1995)


def typed_examples(s, d, e=None):
    """Examples with the pair type of their units."""
    dealt = (*DEALT, "pair_type")
    return forecast.examples(by_year(s, d, e, dealt, keep=True), cutoffs(s), HORIZON, "base", FOLLOW, dealt).drop(*DEALT)


def _examples(s, d, e=None):
    return typed_examples(s, d, e).drop("pair_type")


def forecast_examples(s, d):
    return _examples(s, d)


def task_summary(s, d):
    rows = forecast.tasks(_examples(s, d), ["patent", "trial", "follow_up"]).select("task", "split", "label")
    return rows.groupBy("task", "split").agg(F.count("*").alias("rows"), F.sum("label").alias("positives"), F.round(F.avg("label"), 6).alias("rate"))


def leakage_audit(s, d):
    return forecast.leakage_audit(_examples(s, d), FOLLOW, ["train", "validation", "test"])


def resplit(s, d):
    x = _examples(s, d).withColumn("split", expr.split_of(F.col("cutoff"), {"train": [1996], "test": [1998]}))
    return x.filter("split <> 'unused'").groupBy("split", "cutoff").agg(F.count("*").alias("rows"), F.sum("label_follow_up").alias("positives"))


def unit_ends(s, d, e=None):
    """Units with their two entities, written."""
    return written(unit_master(s, d, e).select("unit_id", "entity_a", "entity_b"), "unit-ends")


def unit_edges(s, d, e=None):
    return forecast.top_shared_entity_edges(unit_ends(s, d, e), *NARROW)


def _neighbours(u, state, points, bounds):
    columns = ["history_total", "recent_3"]
    return neighbourhoods.neighbour_state(neighbourhoods.pooled(u, state, points, columns, bounds), state, columns)


def neighbour_features(s, d):
    e = stored_evidence(s, d)
    state = _examples(s, d, e).filter("split = 'test'").select("unit_id", "cutoff", "history_total", "recent_3")
    return _neighbours(unit_ends(s, d, e), state, [1998], NARROW)


def wide_unit_edges(s, d, e=None):
    """The unit graph with the reference's bounds: entities of 2 to 2000 units, 100 neighbours."""
    return forecast.top_shared_entity_edges(unit_ends(s, d, e), *WIDE)


def wide_neighbour_features(s, d):
    """Neighbours' state in the wide unit graph at the cutoffs of all splits."""
    e = stored_evidence(s, d)
    state = _examples(s, d, e).select("unit_id", "cutoff", "history_total", "recent_3")
    return _neighbours(unit_ends(s, d, e), state, POINTS, WIDE)


def normalized_features(s, d):
    z = forecast.normalized(stored_examples(s, d), ["history_total", "recent_3", "age"], F.col("split") == "train")
    return z.groupBy("split").agg(*(F.round(F.avg(f"{c}_z"), 6).alias(f"{c}_mean") for c in ("history_total", "recent_3", "age")), *(F.round(F.max(f"{c}_z"), 5).alias(f"{c}_max") for c in ("history_total", "recent_3", "age")))


def feature_diagnostics(s, d):
    x, names = _examples(s, d), ["history_total", "recent_3", "previous_3", "active_years", "age", "idle"]
    one = x.agg(F.count("*").alias("n"), *(F.struct(F.count_if(F.col(c) != 0).alias("nonzero"), F.round(F.avg(c), 6).alias("mean"), F.max(c).cast("bigint").alias("most")).alias(c) for c in names))
    rows = one.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in names))).alias("r"))
    return rows.select("r.feature", "r.s.*", F.round(F.col("r.s.nonzero") / F.col("n"), 6).alias("fraction"))


YEARLY = """by_year AS (
  SELECT unit_id, year, count(DISTINCT carrier_key) AS carriers, count(*) AS rows, sum(pair_weight) AS weight,
    count(DISTINCT CASE WHEN carrier_type = 'base' THEN carrier_key END) AS base_carriers,
    count(DISTINCT CASE WHEN carrier_type = 'patent' THEN carrier_key END) AS patent_carriers,
    count(DISTINCT CASE WHEN carrier_type = 'trial' THEN carrier_key END) AS trial_carriers
  FROM unit_evidence GROUP BY unit_id, year)"""
DENSE = f"""{YEARLY}, dense AS (
  SELECT g.unit_id, g.year, coalesce(b.carriers, 0) AS carriers, coalesce(b.rows, 0) AS rows, coalesce(b.weight, 0) AS weight,
    coalesce(b.base_carriers, 0) AS base_carriers, coalesce(b.patent_carriers, 0) AS patent_carriers, coalesce(b.trial_carriers, 0) AS trial_carriers
  FROM (SELECT u.unit_id, CAST(y.year AS INTEGER) AS year FROM (SELECT DISTINCT unit_id FROM by_year) u CROSS JOIN generate_series(1995, 2001) y(year)) g
  LEFT JOIN by_year b ON g.unit_id = b.unit_id AND g.year = b.year)"""
EXAMPLES = f"""{YEARLY}, cutoffs(cutoff, split) AS (VALUES (1996, 'train'), (1997, 'validation'), (1998, 'test')),
x0 AS (
  SELECT b.unit_id, c.cutoff, c.split,
    coalesce(sum(carriers) FILTER (year <= cutoff), 0) AS history_total, coalesce(sum(carriers) FILTER (year <= cutoff AND year > cutoff - 3), 0) AS recent_3,
    coalesce(sum(carriers) FILTER (year <= cutoff AND year > cutoff - 5), 0) AS recent_5, coalesce(sum(carriers) FILTER (year BETWEEN cutoff - 5 AND cutoff - 3), 0) AS previous_3,
    count(*) FILTER (year <= cutoff AND carriers > 0) AS active_years, min(year) FILTER (year <= cutoff) AS first_active, max(year) FILTER (year <= cutoff) AS last_active,
    coalesce(sum(carriers) FILTER (year > cutoff), 0) AS future_total,
    coalesce(sum(base_carriers) FILTER (year <= cutoff), 0) AS history_base, coalesce(sum(base_carriers) FILTER (year > cutoff), 0) AS future_base,
    coalesce(sum(patent_carriers) FILTER (year <= cutoff), 0) AS history_patent, coalesce(sum(patent_carriers) FILTER (year > cutoff), 0) AS future_patent,
    coalesce(sum(trial_carriers) FILTER (year <= cutoff), 0) AS history_trial, coalesce(sum(trial_carriers) FILTER (year > cutoff), 0) AS future_trial
  FROM by_year b CROSS JOIN cutoffs c WHERE b.year <= c.cutoff + 3 GROUP BY ALL HAVING count(*) FILTER (year <= cutoff) > 0),
examples AS (
  SELECT unit_id, cutoff, split, CAST(history_total AS BIGINT) AS history_total, CAST(recent_3 AS BIGINT) AS recent_3, CAST(recent_5 AS BIGINT) AS recent_5, CAST(previous_3 AS BIGINT) AS previous_3,
    active_years, first_active, last_active, CAST(future_total AS BIGINT) AS future_total, CAST(history_base AS BIGINT) AS history_base, CAST(future_base AS BIGINT) AS future_base,
    CAST(history_patent AS BIGINT) AS history_patent, CAST(future_patent AS BIGINT) AS future_patent, CAST(history_trial AS BIGINT) AS history_trial, CAST(future_trial AS BIGINT) AS future_trial,
    history_base > 0 AND history_patent = 0 AS eligible_patent, CAST(future_patent > 0 AS INTEGER) AS label_patent, round(log10(1 + future_patent), 6) AS heat_patent,
    history_base > 0 AND history_trial = 0 AS eligible_trial, CAST(future_trial > 0 AS INTEGER) AS label_trial, round(log10(1 + future_trial), 6) AS heat_trial,
    CAST(future_patent > 0 OR future_trial > 0 AS INTEGER) AS label_follow_up, history_base > 0 AND history_patent + history_trial = 0 AS eligible_follow_up,
    cutoff - first_active AS age, cutoff - last_active AS idle
  FROM x0)"""
EDGES = """sides AS (SELECT unit_id, entity_a AS entity_id FROM units UNION ALL SELECT unit_id, entity_b FROM units),
deg AS (SELECT entity_id, count(*) AS degree FROM sides GROUP BY entity_id HAVING count(*) BETWEEN 2 AND 40),
links AS (
  SELECT a.unit_id AS src, b.unit_id AS dst, round(sum(1 / ln(1 + degree)), 6) AS edge_weight, count(*) AS shared
  FROM sides a JOIN deg d ON a.entity_id = d.entity_id JOIN sides b ON a.entity_id = b.entity_id AND a.unit_id <> b.unit_id GROUP BY ALL),
unit_edges AS (SELECT src, dst, edge_weight, shared FROM links QUALIFY row_number() OVER (PARTITION BY src ORDER BY edge_weight DESC, shared DESC, dst) <= 10)"""
WIDE_EDGES = EDGES.replace("BETWEEN 2 AND 40", "BETWEEN 2 AND 2000").replace("<= 10)", "<= 100)")
NEIGHBOURS = """SELECT e.src AS unit_id, x.cutoff, count(*) AS neighbours, round(sum(edge_weight), 6) AS weight_sum,
  round(avg(history_total), 6) AS history_total_mean, max(history_total) AS history_total_max, CAST(sum(history_total) AS BIGINT) AS history_total_sum, round(sum(edge_weight * history_total) / sum(edge_weight), 6) AS history_total_wmean,
  round(avg(recent_3), 6) AS recent_3_mean, max(recent_3) AS recent_3_max, CAST(sum(recent_3) AS BIGINT) AS recent_3_sum, round(sum(edge_weight * recent_3) / sum(edge_weight), 6) AS recent_3_wmean
FROM unit_edges e JOIN examples x ON e.dst = x.unit_id GROUP BY ALL"""
FEATURES = ("history_total", "recent_3", "previous_3", "active_years", "age", "idle")

ORACLES = {
    "unit_master": (unit_master, sql("SELECT * FROM units")),
    "mention_counts": (mention_counts, sql("SELECT carrier_type, entity_type, year, count(*) AS pairs, CAST(sum(mention_count) AS BIGINT) AS mentions FROM mentions GROUP BY ALL")),
    "pair_evidence": (pair_evidence, sql("SELECT pair_type, carrier_type, count(*) AS rows, count(DISTINCT unit_id) AS units, round(sum(pair_weight), 4) AS weight FROM evidence GROUP BY ALL")),
    "pair_weights": (
        pair_weights,
        sql("""SELECT pair_type, round(sum(sqrt(mention_count_a * mention_count_b)), 4) AS sqrt_product, round(sum(CAST(least(mention_count_a, mention_count_b) AS DOUBLE)), 4) AS min,
        round(sum(CAST(mention_count_a * mention_count_b AS DOUBLE)), 4) AS product, round(sum(CAST(mention_count_a + mention_count_b AS DOUBLE)), 4) AS sum, round(sum((mention_count_a + mention_count_b) / 2), 4) AS mean FROM evidence GROUP BY pair_type"""),
    ),
    "build_summary": (
        build_summary,
        sql("""SELECT (SELECT count(*) FROM raw_mentions) AS raw_rows, (SELECT count(*) FROM mentions) AS mention_rows, (SELECT count(DISTINCT carrier_key) FROM mentions) AS carriers,
        count(*) AS units, min(carrier_count) AS least_support, round(quantile_cont(carrier_count, 0.5), 6) AS median_support, max(carrier_count) AS most_support FROM units"""),
    ),
    "support_sweep": (
        support_sweep,
        sql("SELECT t.least, count(*) AS units, CAST(sum(n) AS BIGINT) AS evidence_rows FROM (SELECT unit_id, count(DISTINCT carrier_key) AS c, count(*) AS n FROM evidence GROUP BY unit_id) u JOIN (VALUES (1), (2), (3), (5)) t(least) ON u.c >= t.least GROUP BY t.least"),
    ),
    "unit_type_summary": (
        type_summary,
        sql("SELECT pair_type, count(*) AS units, CAST(sum(carrier_count) AS BIGINT) AS carriers, round(avg(carrier_count), 6) AS mean_carriers, round(avg(total_weight), 5) AS mean_weight FROM units GROUP BY pair_type"),
    ),
    "evidence_flags": (
        flags,
        sql("""SELECT pattern, count(*) AS units, max(modalities) AS modalities FROM (SELECT coalesce(nullif(CASE WHEN base_count > 0 THEN 'P' ELSE '' END || CASE WHEN patent_count > 0 THEN 'A' ELSE '' END || CASE WHEN trial_count > 0 THEN 'T' ELSE '' END, ''), 'none') AS pattern,
        CAST(base_count > 0 AS INTEGER) + CAST(patent_count > 0 AS INTEGER) + CAST(trial_count > 0 AS INTEGER) AS modalities FROM units) GROUP BY pattern"""),
    ),
    "entity_cap": (
        capped,
        sql("SELECT carrier_type, count(*) AS rows, CAST(sum(mention_count) AS BIGINT) AS mentions FROM (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY carrier_key ORDER BY mention_count DESC, entity_id) <= 3) GROUP BY carrier_type"),
    ),
    "entities_per_carrier": (
        entities_per_carrier,
        sql("""SELECT carrier_type, min(n) AS least, round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.75), 6) AS q75, max(n) AS most, round(avg(n), 6) AS mean
        FROM (SELECT carrier_key, carrier_type, count(DISTINCT entity_id) AS n FROM mentions GROUP BY ALL) GROUP BY carrier_type"""),
    ),
    "entity_hubs": (
        entity_hubs,
        sql("""SELECT entity_id, degree, round((rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2) / count(*) OVER (), 6) AS percentile
        FROM (SELECT entity_id, count(DISTINCT unit_id) AS degree FROM (SELECT entity_a AS entity_id, unit_id FROM units UNION ALL SELECT entity_b, unit_id FROM units) GROUP BY entity_id)"""),
    ),
    "top_units": (top_units, sql("SELECT unit_id, pair_type, carrier_count, total_weight FROM units ORDER BY carrier_count DESC, total_weight DESC, unit_id LIMIT 25")),
    "dense_panel": (
        dense_panel,
        sql(
            """SELECT unit_id, year, carriers, rows, CAST(sum(carriers) OVER w AS BIGINT) AS carriers_so_far, CAST(sum(rows) OVER w AS BIGINT) AS rows_so_far, base_carriers, patent_carriers, trial_carriers, round(weight, 6) AS weight
            FROM dense WINDOW w AS (PARTITION BY unit_id ORDER BY year ROWS UNBOUNDED PRECEDING)""",
            DENSE,
        ),
    ),
    "panel_years": (
        panel_years,
        sql(
            """SELECT year, count(*) FILTER (carriers > 0) AS active_units, count(*) FILTER (so_far > 0) AS seen_units, CAST(sum(carriers) AS BIGINT) AS carriers, count(*) AS units
            FROM (SELECT *, sum(carriers) OVER (PARTITION BY unit_id ORDER BY year ROWS UNBOUNDED PRECEDING) AS so_far FROM dense) GROUP BY year""",
            DENSE,
        ),
    ),
    "first_events": (
        first_events,
        sql(
            """SELECT unit_id, modality, min(year) AS first_year, arg_min(n, year) AS first_count FROM (
            SELECT unit_id, year, 'base' AS modality, base_carriers AS n FROM by_year UNION ALL SELECT unit_id, year, 'patent', patent_carriers FROM by_year UNION ALL SELECT unit_id, year, 'trial', trial_carriers FROM by_year)
            WHERE n > 0 GROUP BY unit_id, modality""",
            YEARLY,
        ),
    ),
    "lag_features": (
        lags,
        sql(
            """SELECT *, first_patent_year - first_base_year AS lag_patent, first_trial_year - first_base_year AS lag_trial, least(first_patent_year, first_trial_year) AS first_follow_up,
            least(first_patent_year, first_trial_year) - first_base_year AS lag_follow_up, first_base_year <= least(first_patent_year, first_trial_year) AS base_first
            FROM (SELECT unit_id, min(year) FILTER (base_carriers > 0) AS first_base_year, min(year) FILTER (patent_carriers > 0) AS first_patent_year, min(year) FILTER (trial_carriers > 0) AS first_trial_year FROM by_year GROUP BY unit_id)""",
            YEARLY,
        ),
    ),
    "unit_sequences": (unit_sequences, sql("SELECT unit_id, count(*) AS n, string_agg(year || ':' || carriers, ';' ORDER BY year) AS steps FROM by_year GROUP BY unit_id", YEARLY)),
    "forecast_examples": (forecast_examples, sql("SELECT * FROM examples", EXAMPLES)),
    "task_summary": (
        task_summary,
        sql(
            """SELECT task, split, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS rate FROM (
            SELECT 'patent' AS task, split, label_patent AS label FROM examples WHERE eligible_patent UNION ALL SELECT 'trial', split, label_trial FROM examples WHERE eligible_trial
            UNION ALL SELECT 'follow_up', split, label_follow_up FROM examples WHERE eligible_follow_up) GROUP BY ALL""",
            EXAMPLES,
        ),
    ),
    "leakage_audit": (
        leakage_audit,
        sql(
            """SELECT u.check AS "check", u.violations, u.violations = 0 AS passed FROM (SELECT count(*) FILTER (last_active > cutoff) AS history_after_cutoff, count(*) FILTER (split NOT IN ('train', 'validation', 'test')) AS unknown_split,
            count(*) FILTER (history_total <> history_base + history_patent + history_trial) AS counts_not_additive, count(*) FILTER (label_follow_up <> greatest(label_patent, label_trial)) AS label_not_union,
            count(*) FILTER (eligible_follow_up AND history_base = 0) AS eligible_without_base, count(*) FILTER (eligible_follow_up AND history_patent + history_trial > 0) AS eligible_with_follow_up,
            count(*) FILTER (recent_5 > history_total) AS recent_over_history, count(*) FILTER (age < 0) AS negative_age FROM examples) UNPIVOT (violations FOR "check" IN (history_after_cutoff, unknown_split, counts_not_additive, label_not_union, eligible_without_base, eligible_with_follow_up, recent_over_history, negative_age)) u""",
            EXAMPLES,
        ),
    ),
    "latest_resplit": (
        resplit,
        sql("SELECT CASE cutoff WHEN 1996 THEN 'train' WHEN 1998 THEN 'test' END AS split, cutoff, count(*) AS rows, CAST(sum(label_follow_up) AS BIGINT) AS positives FROM examples WHERE cutoff IN (1996, 1998) GROUP BY ALL", EXAMPLES),
    ),
    "unit_graph": (unit_edges, sql("SELECT * FROM unit_edges", EDGES)),
    "neighbour_features": (
        neighbour_features,
        sql(
            """SELECT e.src AS unit_id, x.cutoff, count(*) AS neighbours, round(sum(edge_weight), 6) AS weight_sum,
            round(avg(history_total), 6) AS history_total_mean, max(history_total) AS history_total_max, CAST(sum(history_total) AS BIGINT) AS history_total_sum, round(sum(edge_weight * history_total) / sum(edge_weight), 6) AS history_total_wmean,
            round(avg(recent_3), 6) AS recent_3_mean, max(recent_3) AS recent_3_max, CAST(sum(recent_3) AS BIGINT) AS recent_3_sum, round(sum(edge_weight * recent_3) / sum(edge_weight), 6) AS recent_3_wmean
            FROM unit_edges e JOIN examples x ON e.dst = x.unit_id WHERE x.split = 'test' GROUP BY ALL""",
            EDGES + ", " + EXAMPLES,
        ),
    ),
    "unit_graph_wide": (wide_unit_edges, sql("SELECT * FROM unit_edges", WIDE_EDGES)),
    "neighbour_features_wide": (wide_neighbour_features, sql(NEIGHBOURS, WIDE_EDGES + ", " + EXAMPLES)),
    "normalized_features": (
        normalized_features,
        sql(
            "SELECT split, " + ", ".join(f"round(avg(({c} - m{i}) / CASE WHEN s{i} < 1e-6 THEN 1 ELSE s{i} END), 6) AS {c}_mean, round(max(({c} - m{i}) / CASE WHEN s{i} < 1e-6 THEN 1 ELSE s{i} END), 5) AS {c}_max" for i, c in enumerate(("history_total", "recent_3", "age")))
            + " FROM examples, (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(("history_total", "recent_3", "age"))) + " FROM examples WHERE split = 'train') GROUP BY split",
            EXAMPLES,
        ),
    ),
    "feature_diagnostics": (
        feature_diagnostics,
        sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} <> 0) AS nonzero, round(avg({c}), 6) AS mean, CAST(max({c}) AS BIGINT) AS most, round(count(*) FILTER ({c} <> 0) / count(*), 6) AS fraction FROM examples" for c in FEATURES), EXAMPLES),
    ),
}
