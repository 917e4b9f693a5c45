"""Which carriers, projects and entities a domain's graph takes: expansion modes, year filters with accounts, project links."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.operators.audit import union_all
from evgraph.operators.graph import written

# which kinds are added, in order, from which kind's seeds or selected carriers; projects come last and never widen a conservative selection
EXPANSIONS = {
    "seed_only": [],
    "conservative": [
        ("patent", "base", "seeds"), ("base", "patent", "seeds"), ("base", "trial", "seeds"), ("trial", "base", "seeds"),
        ("project", "patent", "selected"), ("project", "base", "selected"), ("project", "trial", "selected"),
    ],
    "expanded": [
        ("patent", "base", "seeds"), ("patent", "project", "seeds"), ("base", "patent", "selected"), ("base", "trial", "seeds"), ("base", "project", "seeds"), ("trial", "base", "selected"),
        ("project", "patent", "selected"), ("project", "base", "selected"), ("project", "trial", "selected"),
    ],
}


def select_carriers(seeds: DataFrame, links: DataFrame, mode: str) -> DataFrame:
    """(kind, id) of the carriers and projects that a mode takes, each once.

    seeds: kind, id. links: source_kind, source_id, target_kind, target_id, followed both ways. Steps add one kind each: the ends of links that start at another
    kind's seeds, or at what was selected of it so far. The links both ways and each kind's selection are written to the shared folder.
    """
    if mode not in EXPANSIONS:
        raise ValueError(f"mode must be one of {', '.join(EXPANSIONS)}")
    kinds = ("base", "patent", "trial", "project")
    side = lambda me, other: F.struct(*(F.col(f"{x}_{y}").alias(f"{z}_{y}") for x, z in ((me, "from"), (other, "to")) for y in ("kind", "id")))
    both = written(links.select(F.explode(F.array(side("source", "target"), side("target", "source"))).alias("s")).select("s.*"), "links-both-ways")
    seeds = written(seeds.select("kind", "id").distinct(), "seeds")
    given = {k: seeds.filter(F.col("kind") == k).select("id") for k in kinds}
    selected = dict(given)
    for to, steps in groupby(EXPANSIONS[mode], key=lambda step: step[0]):
        found = [given[to]]
        for _, start, which in steps:
            known = (given if which == "seeds" else selected)[start]
            hops = both.filter((F.col("from_kind") == start) & (F.col("to_kind") == to)).join(known.select(F.col("id").alias("from_id")), "from_id", "left_semi")
            found.append(hops.select(F.col("to_id").alias("id")))
        # later kinds start from this one, so it is made once
        selected[to] = written(union_all(found).distinct(), f"selected-{to}")
    return union_all([selected[k].select(F.lit(k).alias("kind"), "id") for k in kinds])


def entities_of(mentions: DataFrame, carriers: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """entity_id of the selected carriers' mentions (carrier_id, entity_id), each once; with matched (entity_id) only those that a term matched."""
    held = mentions.join(carriers.select("carrier_id"), "carrier_id", "left_semi")
    held = held if matched is None else held.join(matched.select("entity_id"), "entity_id", "left_semi")
    return held.select("entity_id").distinct()


def filter_by_year(candidates: DataFrame, nodes: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, accounts, histogram) of the candidates (id) whose year in nodes (id, year) is within the window.

    kept: id, year. accounts, one row: candidates, those in the node table and not in it, kept ones, and node rows with a year in the window, outside of it, and without
    one. histogram: year, n of the rows in the window. Candidates that are null or repeat count once; node rows may repeat an id.
    """
    wanted = candidates.select("id").filter(F.col("id").isNotNull()).distinct()
    rows = wanted.join(nodes.select("id", "year", F.lit(True).alias("there")), "id", "left")
    inside = F.col("there") & F.col("year").between(first, last)
    accounts = rows.agg(
        F.count_distinct("id").alias("candidates"), F.count_distinct(F.when(F.col("there"), F.col("id"))).alias("in_node_table"), F.count_distinct(F.when(F.col("there").isNull(), F.col("id"))).alias("not_in_node_table"),
        F.count_distinct(F.when(inside, F.col("id"))).alias("kept"), F.count_if(inside).alias("rows_in_window"), F.count_if(F.col("there") & ~F.col("year").between(first, last)).alias("rows_out_of_window"),
        F.count_if(F.col("there") & F.col("year").isNull()).alias("rows_without_year"),
    )
    kept = rows.filter(inside).select("id", "year")
    return kept.dropDuplicates(["id"]), accounts, kept.groupBy("year").agg(F.count("*").alias("n"))


def project_links(links: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, years) of the links (kind, carrier_id, project_id, year) of the selected carriers (kind, id).

    summary, by kind: selected carriers, matched links, projects (blank ones don't count). years, by kind and year: matched links with a year.
    """
    chosen = selected.groupBy("kind").agg(F.count_distinct("id").alias("selected_carriers"))
    matched = links.join(selected.select("kind", F.col("id").alias("carrier_id")), ["kind", "carrier_id"], "left_semi")
    project = F.when(F.trim("project_id") != "", F.trim("project_id"))
    found = matched.groupBy("kind").agg(F.count("*").alias("matched_links"), F.count_distinct(project).alias("projects"))
    summary = chosen.join(found, "kind", "left").fillna(0, ["matched_links", "projects"])
    return summary, matched.filter(F.col("year").isNotNull()).groupBy("kind", "year").agg(F.count("*").alias("links"))


def dedup_context(edges: DataFrame, keys: list[str], year: str | None = None) -> DataFrame:
    """One row for each key: how many records it had, the range of their years, and the least value of every other column. Rows with a blank key are left out."""
    named = edges.select(*(F.nullif(F.trim(F.col(k).cast("string")), F.lit("")).alias(k) for k in keys), *(c for c in edges.columns if c not in keys))
    aggs = [F.count("*").alias("edge_record_count")]
    if year:
        aggs += [F.min(F.col(year).cast("long")).alias("min_record_year"), F.max(F.col(year).cast("long")).alias("max_record_year")]
    aggs += [F.min(c).alias(c) for c in edges.columns if c not in keys]
    return named.dropna(subset=keys).groupBy(keys).agg(*aggs)
