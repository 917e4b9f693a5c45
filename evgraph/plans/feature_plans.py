"""Structural and diffusion features, static features, feature variants and snapshots on the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.functions import expr
from evgraph.operators import features, graph, neighbourhoods, panel, structure, units
from evgraph.plans import unit_plans
from evgraph.plans.bindings import carriers, entities, raw_mentions, sql, table
from evgraph.plans.unit_plans import EXAMPLES, FOLLOW, MODES, WIDE_EDGES, YEARLY

KINDS = ["base", "patent", "trial", "project", "entity"]
NUMERIC = ["history_total", "recent_3", "recent_5", "previous_3", "active_years", "age", "idle", "history_base", "history_patent", "history_trial"]
CATEGORICAL = ["pair_type", "pattern"]
STRUCTURE, DIFFUSION = structure.structure_columns(MODES, KINDS), structure.diffusion_columns()


def carrier_links(s, d) -> DataFrame:
    """Orders to customers, to entities and to the order before of the same customer, with kinds, years and weights."""
    c = carriers(s, d)
    owned = c.select(F.col("carrier_id").alias("source_id"), F.col("carrier_type").alias("source_kind"), F.concat(F.lit("C"), "project_id").alias("target_id"), F.lit("project").alias("target_kind"), "year", F.lit(1.0).alias("weight"), F.lit("ordered_by").alias("edge_type"))
    # mentions lie by carrier for the count and the join behind it
    counted = raw_mentions(s, d).repartition("carrier_id").groupBy("carrier_id", "entity_id").agg(F.count("*").cast("double").alias("weight"))
    held = counted.join(c, "carrier_id").select(F.col("carrier_id").alias("source_id"), F.col("carrier_type").alias("source_kind"), F.col("entity_id").alias("target_id"), F.lit("entity").alias("target_kind"), "year", "weight", F.lit("mentions").alias("edge_type"))
    last = Window.partitionBy("project_id").orderBy("year", F.col("carrier_id").cast("long"))
    follows = c.select("*", F.lag(F.struct("carrier_id", "carrier_type")).over(last).alias("before")).filter("before is not null")
    follows = follows.select(F.col("carrier_id").alias("source_id"), F.col("carrier_type").alias("source_kind"), F.col("before.carrier_id").alias("target_id"), F.col("before.carrier_type").alias("target_kind"), "year", F.lit(1.0).alias("weight"), F.lit("follows").alias("edge_type"))
    return owned.unionByName(held).unionByName(follows)


def carrier_structure(s, d):
    edges = structure.carrier_edges(carrier_links(s, d), carriers(s, d), KINDS)
    return structure.node_structure(edges, unit_plans.cutoffs(s), KINDS)


def pooled_structure(s, d, e):
    held = structure.support(e, unit_plans.cutoffs(s))
    return structure.pooled_structure(held, carrier_structure(s, d), MODES, KINDS)


def structural_features(s, d):
    """Every forecast example with the pooled structure of its carriers."""
    e = unit_plans.stored_evidence(s, d)
    return features.with_groups(unit_plans._examples(s, d, e).select("unit_id", "cutoff"), pooled_structure(s, d, e))


def diffusion_state(s, d, e=None):
    return structure.cutoff_state(unit_plans.by_year(s, d, e), unit_plans.cutoffs(s), FOLLOW)


def pooled_diffusion(s, d, e):
    state = diffusion_state(s, d, e).filter(structure.is_active())
    return structure.diffusion_sums(neighbourhoods.pooled(unit_plans.unit_ends(s, d, e), state, unit_plans.POINTS, list(structure.STATES), unit_plans.WIDE, tops=list(structure.TOP)))


def diffusion_features(s, d):
    """Every forecast example with the pooled state of its neighbours in the unit graph (entities of 2 to 2000 units, 100 neighbours)."""
    e = unit_plans.stored_evidence(s, d)
    return features.with_groups(unit_plans._examples(s, d, e).select("unit_id", "cutoff"), pooled_diffusion(s, d, e))


def labelled_units(s, d, e=None) -> DataFrame:
    u = unit_plans.unit_master(s, d, e)
    return u.withColumn("pattern", expr.evidence_pattern({"P": F.col("base_count") > 0, "A": F.col("patent_count") > 0, "T": F.col("trial_count") > 0}))


def feature_variants(s, d):
    e = unit_plans.stored_evidence(s, d)
    x = unit_plans._examples(s, d, e).join(labelled_units(s, d, e).select("unit_id", *CATEGORICAL), "unit_id")
    x = features.with_groups(x, pooled_structure(s, d, e), pooled_diffusion(s, d, e))
    return features.variant_summary(x, {"base": NUMERIC, "structure": STRUCTURE, "diffusion": DIFFUSION}, {"base": CATEGORICAL})


def undated_carriers(s, d) -> DataFrame:
    """Carriers whose year isn't known where the order has no priority."""
    vague = table(s, d, "orders").filter("o_orderpriority = '4-NOT SPECIFIED'").select(expr.key(F.col("o_orderkey")).alias("carrier_id"), F.lit(True).alias("vague"))
    return carriers(s, d).join(vague, "carrier_id", "left").withColumn("year", F.when(F.col("vague").isNull(), F.col("year"))).drop("vague")


def partly_dated_evidence(s, d) -> DataFrame:
    m = units.standardize(raw_mentions(s, d), undated_carriers(s, d), entities(s, d), ["species"], keep_undated=True)
    e = units.supported_evidence(m.fillna(-1, ["year"]), unit_plans.PAIR_TYPES, 2)
    return e.withColumn("year", F.nullif("year", F.lit(-1)))


def undated_evidence(s, d):
    return panel.undated(partly_dated_evidence(s, d), MODES)


def edge_derived(s, d):
    return features.edge_derived(partly_dated_evidence(s, d), MODES, unit_plans.DEALT)


def hub_covariates(s, d):
    return features.hub_covariates(unit_plans.stored_units(s, d))


def static_features(s, d):
    """Units with their first years and lags, what their evidence tells, how wide their entities are, and their modalities."""
    e = unit_plans.stored_evidence(s, d)
    u = graph.written(labelled_units(s, d, e).withColumns({f"has_{m}": F.col(f"{m}_count") > 0 for m in MODES}), "units")
    lags = unit_plans.lags(s, d, e).drop("base_first")
    return features.static_features(u, lags, features.edge_derived(e, MODES), features.hub_covariates(u))


def snapshot_rows(s, d) -> tuple[DataFrame, DataFrame]:
    e = unit_plans.stored_evidence(s, d)
    u = graph.written(labelled_units(s, d, e).select("unit_id", *CATEGORICAL), "units")
    nodes = graph.written(features.encoded(features.index_by(u, "unit_id", 5), CATEGORICAL), "nodes")
    return features.snapshots(nodes, unit_plans._examples(s, d, e), unit_plans.cutoffs(s), NUMERIC, CATEGORICAL, FOLLOW), nodes


def snapshots(s, d):
    return snapshot_rows(s, d)[0]


def snapshot_check(s, d):
    return features.snapshot_check(*snapshot_rows(s, d), FOLLOW)


LINKS = """carrier_links AS (
  SELECT carrier_id AS source_id, carrier_type AS source_kind, 'C' || project_id AS target_id, 'project' AS target_kind, year, 1.0::DOUBLE AS weight, 'ordered_by' AS edge_type FROM carriers
  UNION ALL SELECT m.carrier_id, c.carrier_type, m.entity_id, 'entity', c.year, count(*)::DOUBLE, 'mentions' FROM raw_mentions m JOIN carriers c ON m.carrier_id = c.carrier_id GROUP BY ALL
  UNION ALL SELECT * FROM (SELECT carrier_id, carrier_type, lag(carrier_id) OVER w AS target_id, lag(carrier_type) OVER w, year, 1.0::DOUBLE, 'follows' FROM carriers
    WINDOW w AS (PARTITION BY project_id ORDER BY year, carrier_id::BIGINT)) WHERE target_id IS NOT NULL),
seen AS (
  SELECT source_id AS node_id, target_id AS neighbor_id, target_kind AS kind, year, weight, edge_type FROM carrier_links WHERE source_id IN (SELECT carrier_id FROM carriers)
  UNION ALL SELECT target_id, source_id, source_kind, year, weight, edge_type FROM carrier_links WHERE target_id IN (SELECT carrier_id FROM carriers)),
points(cutoff, split) AS (VALUES (1996, 'train'), (1997, 'validation'), (1998, 'test')),
node_structure AS (
  SELECT node_id, cutoff, count(*)::DOUBLE AS degree, sum(weight)::DOUBLE AS weighted_degree, count(DISTINCT neighbor_id)::DOUBLE AS unique_neighbor, count(DISTINCT edge_type)::DOUBLE AS edge_type_count,
    """ + ", ".join(f"count(*) FILTER (kind = '{k}')::DOUBLE AS {k}_neighbor" for k in KINDS) + """, 0::DOUBLE AS unknown_neighbor
  FROM seen JOIN points ON year <= cutoff GROUP BY ALL)"""
POOLED = f"""{LINKS}, held AS (SELECT unit_id, carrier_id, min(carrier_type) AS carrier_type, cutoff FROM unit_evidence JOIN points ON year <= cutoff GROUP BY unit_id, carrier_id, cutoff),
pooled_structure AS (
  SELECT h.unit_id, h.cutoff, count(*) AS structure_support_count, count(n.node_id) AS structure_coverage_count, round(count(n.node_id) / count(*), 6) AS structure_coverage_fraction,
    {", ".join(f"count(*) FILTER (carrier_type = '{m}') AS structure_support_{m}_count" for m in MODES)}, count(*) FILTER (carrier_type NOT IN ('base', 'patent', 'trial')) AS structure_support_other_count,
    {", ".join(f"round(avg(coalesce({m}, 0)), 6) AS structure_{m}_mean, max(coalesce({m}, 0)) AS structure_{m}_max, sum(coalesce({m}, 0)) AS structure_{m}_sum, round(stddev_pop(coalesce({m}, 0)), 5) AS structure_{m}_std" for m in structure.metrics(KINDS))}
  FROM held h LEFT JOIN node_structure n ON h.carrier_id = n.node_id AND h.cutoff = n.cutoff GROUP BY h.unit_id, h.cutoff)"""
_SUM = {"base": "base_carriers", "patent": "patent_carriers", "trial": "trial_carriers", "follow_up": "patent_carriers + trial_carriers", "total": "carriers"}
STATE = """state AS (
  SELECT unit_id, cutoff, """ + ", ".join(
    [f"coalesce(sum({c}) FILTER (year <= cutoff AND year > cutoff - 3), 0)::DOUBLE AS recent_{k}" for k, c in _SUM.items()]
    + [f"coalesce(sum({c}) FILTER (year <= cutoff), 0)::DOUBLE AS history_{k}" for k, c in _SUM.items()]
    + [f"coalesce(sum({_SUM[k]}) FILTER (year <= cutoff AND year > cutoff - 3), 0)::DOUBLE - coalesce(sum({_SUM[k]}) FILTER (year BETWEEN cutoff - 5 AND cutoff - 3), 0)::DOUBLE AS growth_{k}" for k in ("total", "base")]
) + """ FROM by_year CROSS JOIN points GROUP BY unit_id, cutoff)"""
_TOP = ", ".join(f"round(list_sum(list_reverse_sort(list({s}))[1:10]) / least(10, count(*)), 6) AS diffusion_top10_{s}_mean" for s in structure.TOP)
_STATES = ", ".join(f"round(avg({s}), 6) AS diffusion_{s}_mean, max({s}) AS diffusion_{s}_max, sum({s}) AS diffusion_{s}_sum, round(sum(edge_weight * {s}) / sum(edge_weight), 6) AS diffusion_{s}_weighted_mean" for s in structure.STATES)
DIFFUSED = f"""{STATE}, pooled_diffusion AS (
  SELECT src AS unit_id, cutoff, count(*)::DOUBLE AS diffusion_neighbor_count, count(*)::DOUBLE AS diffusion_active_neighbor_count, round(sum(edge_weight), 6) AS diffusion_neighbor_weight_sum,
    round(avg(shared), 6) AS diffusion_shared_entity_mean, max(shared)::DOUBLE AS diffusion_shared_entity_max,
    {", ".join(f"round(count(*) FILTER ({s} > 0) / count(*), 6) AS diffusion_{s}_any_fraction" for s in ("history_patent", "history_trial", "history_follow_up"))}, {_TOP}, {_STATES}
  FROM unit_edges JOIN state ON dst = unit_id WHERE history_total > 0 GROUP BY src, cutoff)"""
PATTERN = "coalesce(nullif(CASE WHEN base_count > 0 THEN 'P' ELSE '' END || CASE WHEN patent_count > 0 THEN 'A' ELSE '' END || CASE WHEN trial_count > 0 THEN 'T' ELSE '' END, ''), 'none')"
ALL = f"{EXAMPLES}, {POOLED}, {WIDE_EDGES}, {DIFFUSED}"
PARTLY = """partly AS (
  SELECT e.* REPLACE (CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN year END AS year) FROM unit_evidence e JOIN orders ON carrier_id = CAST(o_orderkey AS VARCHAR))"""


def _zero(columns: list[str], kind: str = "0") -> str:
    return ", ".join(f"coalesce({c}, {kind}) AS {c}" for c in columns)


def _nonzero(groups: tuple[str, ...]) -> str:
    columns = {"base": NUMERIC, "structure": STRUCTURE, "diffusion": DIFFUSION}
    return " + ".join(f"count(*) FILTER ({c} <> 0)" for g in groups for c in columns[g])


_EDGE_DERIVED = """unit_id, count(*) AS edge_rows, count(DISTINCT carrier_key) AS edge_carriers, count(year) AS dated_rows, count(*) - count(year) AS undated_rows,
  round(sum(pair_weight), 6) AS edge_weight_sum, round(avg(pair_weight), 6) AS edge_weight_mean, round(max(pair_weight), 6) AS edge_weight_max, min(year) AS first_edge_year, max(year) AS last_edge_year,
  """ + ", ".join(f"count(DISTINCT CASE WHEN carrier_type = '{m}' THEN carrier_key END) AS {m}_carriers_of_edges" for m in MODES) + """, round(count(year) / count(*), 6) AS dated_fraction, greatest(coalesce(max(year), 0) - coalesce(min(year), 0), 0) AS year_span"""
HUBS = """hub_degree AS (SELECT entity_id, units, (rank() OVER (ORDER BY units) + (count(*) OVER (PARTITION BY units) - 1) / 2) / count(*) OVER () AS percentile FROM (
  SELECT entity_id, count(DISTINCT unit_id) AS units FROM (SELECT entity_a AS entity_id, unit_id FROM units UNION ALL SELECT entity_b, unit_id FROM units) GROUP BY entity_id)),
hubs AS (SELECT unit_id, a.units AS hub_units_a, b.units AS hub_units_b, round(a.percentile, 6) AS hub_percentile_a, round(b.percentile, 6) AS hub_percentile_b, a.units + b.units AS hub_units_sum, greatest(a.units, b.units) AS hub_units_max,
  round(greatest(a.percentile, b.percentile), 6) AS hub_percentile_max, round(ln(1 + a.units) + ln(1 + b.units), 6) AS hub_log_sum FROM units JOIN hub_degree a ON entity_a = a.entity_id JOIN hub_degree b ON entity_b = b.entity_id)"""
SNAPSHOT = f"""labelled AS (SELECT unit_id, pair_type, {PATTERN} AS pattern, row_number() OVER (ORDER BY unit_id) - 1 AS node_idx FROM units),
snapshot AS (SELECT p.split, p.cutoff, l.node_idx, {", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in NUMERIC)},
  {", ".join(f"coalesce(heat_{t}, 0) AS heat_{t}, round(ln(1 + greatest(coalesce(heat_{t}, 0), 0)), 6) AS log_heat_{t}, coalesce(label_{t}, 0) AS label_{t}, coalesce(eligible_{t}, false) AS eligible_{t}" for t in FOLLOW)},
  CAST((SELECT count(DISTINCT pair_type) FROM labelled z WHERE z.pair_type <= l.pair_type) AS INTEGER) AS pair_type_code, CAST((SELECT count(DISTINCT pattern) FROM labelled z WHERE z.pattern <= l.pattern) AS INTEGER) AS pattern_code
  FROM labelled l CROSS JOIN (VALUES (1996, 'train'), (1997, 'validation'), (1998, 'test')) p(cutoff, split) LEFT JOIN examples x ON l.unit_id = x.unit_id AND x.cutoff = p.cutoff)"""
_LAGS = """firsts AS (SELECT *, first_patent_year - first_base_year AS lag_patent, first_trial_year - first_base_year AS lag_trial, least(first_patent_year, first_trial_year) AS first_follow_up, least(first_patent_year, first_trial_year) - first_base_year AS lag_follow_up
  FROM (SELECT unit_id, min(year) FILTER (base_carriers > 0) AS first_base_year, min(year) FILTER (patent_carriers > 0) AS first_patent_year, min(year) FILTER (trial_carriers > 0) AS first_trial_year FROM by_year GROUP BY unit_id))"""
_LAG_COLUMNS = ["first_base_year", "first_patent_year", "first_trial_year", "lag_patent", "lag_trial", "first_follow_up", "lag_follow_up"]

ORACLES = {
    "carrier_structure": (carrier_structure, sql("SELECT * FROM node_structure", LINKS)),
    "structural_features": (structural_features, sql(f"SELECT x.unit_id, x.cutoff, {_zero(STRUCTURE)} FROM examples x LEFT JOIN pooled_structure s ON x.unit_id = s.unit_id AND x.cutoff = s.cutoff", f"{EXAMPLES}, {POOLED}")),
    "diffusion_state": (diffusion_state, sql("SELECT unit_id, cutoff, " + ", ".join(structure.STATES) + " FROM state", f"{YEARLY}, points(cutoff, split) AS (VALUES (1996, 'train'), (1997, 'validation'), (1998, 'test')), {STATE}")),
    "diffusion_features": (
        diffusion_features,
        sql(f"SELECT x.unit_id, x.cutoff, {_zero(DIFFUSION)} FROM examples x LEFT JOIN pooled_diffusion s ON x.unit_id = s.unit_id AND x.cutoff = s.cutoff", f"{EXAMPLES}, points(cutoff, split) AS (VALUES (1996, 'train'), (1997, 'validation'), (1998, 'test')), {WIDE_EDGES}, {DIFFUSED}"),
    ),
    "feature_variants": (
        feature_variants,
        sql(
            " UNION ALL ".join(
                f"SELECT '{v}' AS variant, {sum(len({'base': NUMERIC, 'structure': STRUCTURE, 'diffusion': DIFFUSION}[g]) for g in groups)}::BIGINT AS numeric_features, {2 if 'base' in groups else 0}::BIGINT AS categorical_features, count(*) AS rows, {_nonzero(groups)} AS nonzero_values FROM wide"
                for v, groups in features.VARIANTS.items()
            ),
            f"{ALL}, wide AS MATERIALIZED (SELECT * FROM examples x LEFT JOIN pooled_structure s ON x.unit_id = s.unit_id AND x.cutoff = s.cutoff LEFT JOIN pooled_diffusion f ON x.unit_id = f.unit_id AND x.cutoff = f.cutoff)",
        ),
    ),
    "undated_evidence": (
        undated_evidence,
        sql(
            "SELECT unit_id, count(DISTINCT carrier_key) AS undated_carriers, round(sum(pair_weight), 6) AS undated_weight, "
            + ", ".join(f"count(DISTINCT CASE WHEN carrier_type = '{m}' THEN carrier_key END) AS {m}_undated_carriers, round(coalesce(sum(pair_weight) FILTER (carrier_type = '{m}'), 0), 6) AS {m}_undated_weight" for m in MODES)
            + " FROM partly WHERE year IS NULL GROUP BY unit_id",
            PARTLY,
        ),
    ),
    "edge_derived_features": (edge_derived, sql(f"SELECT {_EDGE_DERIVED} FROM partly GROUP BY unit_id", PARTLY)),
    "hub_covariates": (hub_covariates, sql("SELECT * FROM hubs", HUBS)),
    "static_features": (
        static_features,
        sql(
            f"""SELECT u.*, {PATTERN} AS pattern, base_count > 0 AS has_base, patent_count > 0 AS has_patent, trial_count > 0 AS has_trial, {_zero(_LAG_COLUMNS)}, e.* EXCLUDE (unit_id), h.* EXCLUDE (unit_id)
            FROM units u JOIN firsts f ON u.unit_id = f.unit_id JOIN (SELECT {_EDGE_DERIVED} FROM unit_evidence GROUP BY unit_id) e ON u.unit_id = e.unit_id JOIN hubs h ON u.unit_id = h.unit_id""",
            f"{YEARLY}, {_LAGS}, {HUBS}",
        ),
    ),
    "snapshots": (snapshots, sql("SELECT * FROM snapshot", f"{EXAMPLES}, {SNAPSHOT}")),
    "snapshot_check": (
        snapshot_check,
        sql(
            "SELECT split, cutoff, count(*) AS rows, " + ", ".join(f"count(*) FILTER (eligible_{t}) AS eligible_{t}, count(*) FILTER (eligible_{t} AND label_{t} = 1) AS positive_{t}" for t in FOLLOW)
            + ", (SELECT count(*) FROM units) AS nodes, count(*) = (SELECT count(*) FROM units) AND count(DISTINCT node_idx) = count(*) AND max(node_idx) = count(*) - 1 AS complete FROM snapshot GROUP BY split, cutoff",
            f"{EXAMPLES}, {SNAPSHOT}",
        ),
    ),
}
