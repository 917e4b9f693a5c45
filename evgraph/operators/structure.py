"""What a unit's carriers look like in the carrier graph, and what its neighbours in the unit graph did, at each cutoff.

Both are cutoff-safe: nothing after a cutoff enters its features. All cutoffs are made at once, from yearly sums that meet the few cutoffs
in a broadcast range join, so that raw edges are never multiplied by the number of cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_METRICS = ("degree", "weighted_degree", "unique_neighbor", "edge_type_count")
STATS = ("mean", "max", "sum", "std")
STATES = (
    "recent_base", "recent_patent", "recent_trial", "recent_follow_up", "recent_total", "history_patent", "history_trial", "history_follow_up", "history_total",
    "growth_total", "growth_base",
)
TOP = ("recent_follow_up", "recent_patent", "recent_trial")


def carrier_edges(links: DataFrame, carriers: DataFrame, kinds: list[str]) -> DataFrame:
    """Dated edges as each carrier sees them: node_id, neighbor_id, neighbor_kind, year, weight, edge_type.

    links: source_id, source_kind, target_id, target_kind, year, weight, edge_type; carriers: carrier_id. Each link is seen from those of its ends that
    are carriers; loops, links without an end and undated ones are left out; a missing weight counts 1, kinds other than the given ones are unknown.
    """
    dated = links.filter(F.col("year").isNotNull() & (F.col("source_id") != F.col("target_id")))
    side = lambda me, other: F.struct(F.col(f"{me}_id").alias("node_id"), F.col(f"{other}_id").alias("neighbor_id"), F.col(f"{other}_kind").alias("neighbor_kind"))
    seen = dated.select(F.explode(F.array(side("source", "target"), side("target", "source"))).alias("s"), "year", F.coalesce("weight", F.lit(1.0)).alias("weight"), "edge_type")
    seen = seen.select("s.node_id", "s.neighbor_id", F.when(F.col("s.neighbor_kind").isin(kinds), F.col("s.neighbor_kind")).otherwise("unknown").alias("neighbor_kind"), "year", "weight", "edge_type")
    # the one shuffle of edges: the join and node_structure work where it puts them
    return seen.repartition("node_id").join(carriers.select(F.col("carrier_id").alias("node_id")), "node_id", "left_semi")


def metrics(kinds: list[str]) -> list[str]:
    """Names of the metrics of a node: the general ones and the edges to neighbours of each kind."""
    return [*NODE_METRICS, *(f"{k}_neighbor" for k in (*kinds, "unknown"))]


def node_structure(edges: DataFrame, cutoffs: DataFrame, kinds: list[str]) -> DataFrame:
    """node_id, cutoff and the metrics of each node that has edges up to the cutoff.

    Neighbours and edge types count in the first year in which they are seen, so that distinct counts add up over the years. Edges that lie by node (carrier_edges) aren't shuffled again.
    """
    first = lambda column: (F.row_number().over(Window.partitionBy("node_id", column).orderBy("year")) == 1).cast("long")
    marked = edges.withColumn("new_neighbor", first("neighbor_id")).withColumn("new_type", first("edge_type"))
    rows = marked.groupBy("node_id", "year").agg(
        F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"), F.sum("new_neighbor").alias("unique_neighbor"), F.sum("new_type").alias("edge_type_count"),
        *(F.count_if(F.col("neighbor_kind") == k).alias(f"{k}_neighbor") for k in (*kinds, "unknown")),
    )
    upto = rows.join(F.broadcast(cutoffs.select("cutoff")), F.col("year") <= F.col("cutoff"))
    return upto.groupBy("node_id", "cutoff").agg(*(F.coalesce(F.sum(m), F.lit(0)).cast("double").alias(m) for m in metrics(kinds)))


def support(evidence: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """unit_id, carrier_id, carrier_type, cutoff: the carriers that a unit has up to each cutoff, each once."""
    first = evidence.filter(F.col("year").isNotNull()).groupBy("unit_id", "carrier_id").agg(F.min("year").alias("year"), F.min("carrier_type").alias("carrier_type"))
    return first.join(F.broadcast(cutoffs.select("cutoff")), F.col("year") <= F.col("cutoff")).drop("year")


def structure_columns(modalities: list[str], kinds: list[str]) -> list[str]:
    own = ["support_count", "coverage_count", "coverage_fraction", *(f"support_{m}_count" for m in (*modalities, "other"))]
    return [f"structure_{c}" for c in (*own, *(f"{m}_{s}" for m in metrics(kinds) for s in STATS))]


def pooled_structure(held: DataFrame, structure: DataFrame, modalities: list[str], kinds: list[str]) -> DataFrame:
    """Carriers and the mean, largest, sum and spread of their metrics, by unit and cutoff. Carriers without edges count as zeros, and lower the coverage."""
    rows = held.join(structure.withColumnRenamed("node_id", "carrier_id").withColumn("covered", F.lit(True)), ["carrier_id", "cutoff"], "left")
    covered, kind = F.count_if(F.col("covered")), F.coalesce("carrier_type", F.lit(""))
    aggs: list[Column] = [F.count("*").alias("structure_support_count"), covered.alias("structure_coverage_count"), F.round(covered / F.count("*"), 6).alias("structure_coverage_fraction")]
    aggs += [F.count_if(kind == m).alias(f"structure_support_{m}_count") for m in modalities] + [F.count_if(~kind.isin(modalities)).alias("structure_support_other_count")]
    for m in metrics(kinds):
        x = F.coalesce(m, F.lit(0.0))
        aggs += [F.round(F.avg(x), 6).alias(f"structure_{m}_mean"), F.max(x).alias(f"structure_{m}_max"), F.sum(x).alias(f"structure_{m}_sum"), F.round(F.stddev_pop(x), 5).alias(f"structure_{m}_std")]
    return rows.groupBy("unit_id", "cutoff").agg(*aggs)


def cutoff_state(by_year: DataFrame, cutoffs: DataFrame, follow_ups: list[str]) -> DataFrame:
    """unit_id, cutoff and STATES of every unit at every cutoff: carriers of the last three years, of all years, and growth against the three years before."""
    rows = by_year.join(F.broadcast(cutoffs.select("cutoff")))
    past, age = F.col("year") <= F.col("cutoff"), F.col("cutoff") - F.col("year")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, c)), F.lit(0)).cast("double")
    follow = sum((F.col(f"{m}_carriers") for m in follow_ups), F.lit(0))
    counted = {"base": F.col("base_carriers"), "follow_up": follow, "total": F.col("carriers")} | {m: F.col(f"{m}_carriers") for m in follow_ups}
    aggs = [total(c, past & (age < 3)).alias(f"recent_{k}") for k, c in counted.items()] + [total(c, past).alias(f"history_{k}") for k, c in counted.items()]
    before = [total(counted[k], age.between(3, 5)).alias(f"before_{k}") for k in ("total", "base")]
    out = rows.groupBy("unit_id", "cutoff").agg(*aggs, *before)
    growth = [(F.col(f"recent_{k}") - F.col(f"before_{k}")).alias(f"growth_{k}") for k in ("total", "base")]
    return out.select("unit_id", "cutoff", *(c for c in STATES if not c.startswith("growth")), *growth)


def diffusion_columns() -> list[str]:
    own = ["neighbor_count", "active_neighbor_count", "neighbor_weight_sum", "shared_entity_mean", "shared_entity_max"]
    own += [f"{s}_any_fraction" for s in ("history_patent", "history_trial", "history_follow_up")] + [f"top10_{s}_mean" for s in TOP]
    return [f"diffusion_{c}" for c in (*own, *(f"{s}_{x}" for s in STATES for x in ("mean", "max", "sum", "weighted_mean")))]


def is_active() -> Column:
    """Whether a state shows any evidence up to its cutoff."""
    return F.greatest("history_total", "recent_total", "history_patent", "history_trial", "history_follow_up") > 0


def diffusion_features(edges: DataFrame, state: DataFrame, inactive: bool = False) -> DataFrame:
    """Pooled STATES of a unit's neighbours at each cutoff, by unit and cutoff.

    edges: src, dst, edge_weight, shared, a bounded number for each src. Neighbours without any evidence up to the cutoff are left out unless inactive. The mean of the ten largest
    values doesn't depend on how ties are ranked, so it comes from the sorted values of a unit's bounded neighbourhood in the same aggregation.
    """
    rows = edges.join(state, edges["dst"] == state["unit_id"]).drop("unit_id").withColumn("active", is_active())
    rows = rows if inactive else rows.filter("active")
    aggs: list[Column] = [F.count("*").alias("neighbor_count"), F.count_if("active").alias("active_neighbor_count"), F.round(F.sum("edge_weight"), 6).alias("neighbor_weight_sum")]
    aggs += [F.round(F.avg("shared"), 6).alias("shared_entity_mean"), F.max("shared").alias("shared_entity_max")]
    aggs += [F.round(F.count_if(F.col(s) > 0) / F.count("*"), 6).alias(f"{s}_any_fraction") for s in ("history_patent", "history_trial", "history_follow_up")]
    for s in TOP:
        ten = F.slice(F.sort_array(F.collect_list(s), False), 1, 10)
        aggs.append(F.round(F.aggregate(ten, F.lit(0.0), lambda a, b: a + b) / F.size(ten), 6).alias(f"top10_{s}_mean"))
    for s in STATES:
        weighted = F.sum(F.col("edge_weight") * F.col(s)) / F.nullif(F.sum("edge_weight"), F.lit(0.0))
        aggs += [F.round(F.avg(s), 6).alias(f"{s}_mean"), F.max(s).alias(f"{s}_max"), F.sum(s).alias(f"{s}_sum"), F.round(weighted, 6).alias(f"{s}_weighted_mean")]
    out = rows.groupBy(F.col("src").alias("unit_id"), "cutoff").agg(*aggs)
    return out.select("unit_id", "cutoff", *(F.col(c.removeprefix("diffusion_")).cast("double").alias(c) for c in diffusion_columns()))


def diffusion_sums(sums: DataFrame) -> DataFrame:
    """diffusion_features from the pooled sums of active neighbours' STATES (neighbourhoods.pooled, with the ten largest values of TOP)."""
    n, weight = F.col("n"), F.col("weight")
    out = {"neighbor_count": n, "active_neighbor_count": n, "neighbor_weight_sum": F.round(weight, 6), "shared_entity_mean": F.round(F.col("shared") / n, 6), "shared_entity_max": F.col("shared_max")}
    out |= {f"{s}_any_fraction": F.round(F.col(f"{s}_any") / n, 6) for s in ("history_patent", "history_trial", "history_follow_up")}
    for s in TOP:
        out[f"top10_{s}_mean"] = F.round(F.aggregate(f"{s}_top", F.lit(0.0), lambda a, b: a + b) / F.size(f"{s}_top"), 6)
    for s in STATES:
        out |= {f"{s}_mean": F.round(F.col(f"{s}_sum") / n, 6), f"{s}_max": F.col(f"{s}_max"), f"{s}_sum": F.col(f"{s}_sum"), f"{s}_weighted_mean": F.round(F.col(f"{s}_weighted") / F.nullif(weight, F.lit(0.0)), 6)}
    return sums.select("unit_id", "cutoff", *(out[c.removeprefix("diffusion_")].cast("double").alias(c) for c in diffusion_columns()))
