"""Feature tables for models: static covariates of units, groups and variants of features, and snapshots by cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.operators.metrics import midranks


def edge_derived(evidence: DataFrame, modalities: list[str], dealt: tuple[str, ...] = ()) -> DataFrame:
    """What a unit's evidence rows tell without a time limit: rows, carriers, dated share, weights, years, carriers of each modality. A carrier's rows are summed up first.

    dealt: columns that a unit has one value of and that the rows are dealt by; with them the sums need no shuffle.
    """
    own = lambda m: F.count_if((F.col("carrier_type") == m) & F.col("carrier_key").isNotNull()).alias(f"own_{m}")
    each = evidence.groupBy("unit_id", *dealt, "carrier_key").agg(
        F.count("*").alias("n"), F.count("year").alias("dated"), F.sum("pair_weight").alias("w"), F.count("pair_weight").alias("weights"), F.max("pair_weight").alias("most"),
        F.min("year").alias("low"), F.max("year").alias("high"), *(own(m) for m in modalities),
    )
    out = each.groupBy("unit_id", *dealt).agg(
        F.sum("n").alias("edge_rows"), F.count("carrier_key").alias("edge_carriers"), F.sum("dated").alias("dated_rows"), (F.sum("n") - F.sum("dated")).alias("undated_rows"),
        F.round(F.sum("w"), 6).alias("edge_weight_sum"), F.round(F.sum("w") / F.sum("weights"), 6).alias("edge_weight_mean"), F.round(F.max("most"), 6).alias("edge_weight_max"),
        F.min("low").alias("first_edge_year"), F.max("high").alias("last_edge_year"), *(F.count_if(F.col(f"own_{m}") > 0).alias(f"{m}_carriers_of_edges") for m in modalities),
    )
    span = F.greatest(F.coalesce("last_edge_year", F.lit(0)) - F.coalesce("first_edge_year", F.lit(0)), F.lit(0))
    return out.drop(*dealt).withColumn("dated_fraction", F.round(F.col("dated_rows") / F.col("edge_rows"), 6)).withColumn("year_span", span)


def hub_covariates(units: DataFrame) -> DataFrame:
    """How many units each of a unit's two entities has, and the share of entities with as few (average ranks): both sides, sums and maxima.

    Ranks come from the counts of each degree, of which there are far fewer than entities.
    """
    sides = units.select("unit_id", F.explode(F.array("entity_a", "entity_b")).alias("entity_id"))
    degree = sides.groupBy("entity_id").agg(F.count_distinct("unit_id").alias("units"))
    n = degree.agg(F.count("*").alias("n"))
    ranks = midranks(degree.withColumn("g", F.lit(1)), ["g"], "units").drop("g")
    ranked = degree.join(ranks, "units").join(F.broadcast(n), F.lit(True), "left").select("entity_id", "units", (F.col("midrank") / F.col("n")).alias("percentile"))
    out = units.select("unit_id", "entity_a", "entity_b")
    for x in "ab":
        out = out.join(ranked.select(F.col("entity_id").alias(f"entity_{x}"), F.col("units").alias(f"units_{x}"), F.col("percentile").alias(f"percentile_{x}")), f"entity_{x}", "left")
    a, b = F.coalesce("units_a", F.lit(0)), F.coalesce("units_b", F.lit(0))
    return out.select(
        "unit_id", a.alias("hub_units_a"), b.alias("hub_units_b"), F.round("percentile_a", 6).alias("hub_percentile_a"), F.round("percentile_b", 6).alias("hub_percentile_b"),
        (a + b).alias("hub_units_sum"), F.greatest(a, b).alias("hub_units_max"), F.round(F.greatest("percentile_a", "percentile_b"), 6).alias("hub_percentile_max"), F.round(F.log1p(a) + F.log1p(b), 6).alias("hub_log_sum"),
    )


def zero_filled(df: DataFrame) -> DataFrame:
    """Numbers that are missing become 0; other columns stay."""
    return df.fillna(0, [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte")])


def static_features(units: DataFrame, *more: DataFrame) -> DataFrame:
    """One row for each unit with the columns of all tables (each with one row for a unit_id at most); a column that is there already isn't taken again."""
    out = units
    for table in more:
        out = out.join(table.select("unit_id", *(c for c in table.columns if c not in out.columns)), "unit_id", "left")
    return zero_filled(out)


def with_groups(examples: DataFrame, *groups: DataFrame) -> DataFrame:
    """Examples (unit_id, cutoff, ...) with the columns of each group of features (unit_id, cutoff, ...); what a group lacks is 0."""
    out = examples
    for g in groups:
        out = out.join(g, ["unit_id", "cutoff"], "left").fillna(0, [c for c in g.columns if c not in ("unit_id", "cutoff")])
    return out


VARIANTS = {
    "base": ("base",),
    "base_structure": ("base", "structure"),
    "base_diffusion": ("base", "diffusion"),
    "base_structure_diffusion": ("base", "structure", "diffusion"),
    "structure_only": ("structure",),
    "diffusion_only": ("diffusion",),
}


def variant(df: DataFrame, name: str, numeric: dict[str, list[str]], categorical: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """The columns of a variant: the keys, then the numeric and categorical features of its groups."""
    groups = VARIANTS[name]
    return df.select(*keys, *(c for g in groups for c in numeric.get(g, [])), *(c for g in groups for c in categorical.get(g, [])))


def variant_summary(df: DataFrame, numeric: dict[str, list[str]], categorical: dict[str, list[str]]) -> DataFrame:
    """For each variant its numbers of features and how many values of the numeric ones aren't 0: one pass over the table."""
    columns = [c for g in numeric.values() for c in g]
    one = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c) != 0).alias(f"nonzero_{c}") for c in columns))
    rows = []
    for name, groups in VARIANTS.items():
        own = [c for g in groups for c in numeric.get(g, [])]
        n_own, n_kinds = len(own), sum(len(categorical.get(g, [])) for g in groups)
        nonzero = sum((F.col(f"nonzero_{c}") for c in own), F.lit(0).cast("long"))
        rows.append(F.struct(F.lit(name).alias("variant"), F.lit(n_own).cast("long").alias("numeric_features"), F.lit(n_kinds).cast("long").alias("categorical_features"), F.col("rows"), nonzero.alias("nonzero_values")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def index_by(df: DataFrame, key: str, width: int, name: str = "node_idx") -> DataFrame:
    """A dense number, from 0, in the order of a string key: rows are ranked among those with the same first `width` characters, and offset by the rows before.

    Keys whose first characters are spread evenly, like hashes, make even tasks; the prefixes' counts are the only thing that is ranked as a whole.
    """
    prefix = F.substring(key, 1, width)
    sizes = df.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"))
    before = sizes.select("prefix", F.coalesce(F.sum("n").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = df.withColumn("prefix", prefix).withColumn("place", F.row_number().over(Window.partitionBy("prefix").orderBy(key)) - 1)
    return ranked.join(before, "prefix").withColumn(name, F.col("before") + F.col("place")).drop("prefix", "place", "before")


def encoded(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <column>_code: the place of a value among the column's distinct ones in order, from 1; missing values are 0.

    Vocabularies are distinct values of categorical columns; only they are ranked as a whole.
    """
    for c in columns:
        words = df.select(F.col(c).cast("string").alias(c)).filter(F.col(c).isNotNull()).distinct()
        words = words.select(c, F.row_number().over(Window.orderBy(c)).alias(f"{c}_code"))
        df = df.join(words, c, "left").fillna(0, [f"{c}_code"])
    return df


def log_target(heat: str):
    """log1p of a target that is a logarithm already, without its negative part."""
    return F.log1p(F.greatest(F.coalesce(F.col(heat), F.lit(0.0)), F.lit(0.0)))


def snapshots(nodes: DataFrame, examples: DataFrame, cutoffs: DataFrame, numeric: list[str], categorical: list[str], tasks: list[str]) -> DataFrame:
    """One row for each node and cutoff: node_idx, numbers (missing ones 0), codes, and for each task heat, log target, label and mask.

    nodes: unit_id, node_idx and the categorical columns' codes; examples: unit_id, cutoff and the rest. Nodes without an example at a cutoff are all zeros and
    masked out, so that every cutoff has as many rows as there are nodes.
    """
    grid = nodes.select("unit_id", "node_idx", *(f"{c}_code" for c in categorical)).join(F.broadcast(cutoffs.select("cutoff", "split")))
    joined = grid.join(examples.drop("split"), ["unit_id", "cutoff"], "left")
    out = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric]
    for t in tasks:
        out += [F.coalesce(F.col(f"heat_{t}"), F.lit(0.0)).alias(f"heat_{t}"), F.round(log_target(f"heat_{t}"), 6).alias(f"log_heat_{t}")]
        out += [F.coalesce(F.col(f"label_{t}"), F.lit(0)).alias(f"label_{t}"), F.coalesce(F.col(f"eligible_{t}"), F.lit(False)).alias(f"eligible_{t}")]
    return joined.select("split", "cutoff", "node_idx", *out, *(f"{c}_code" for c in categorical))


def snapshot_check(rows: DataFrame, nodes: DataFrame, tasks: list[str]) -> DataFrame:
    """For each cutoff its rows, whether they are as many as the nodes and numbered without gaps, and each task's eligible rows and positives."""
    aggs = [F.count("*").alias("rows"), F.count_distinct("node_idx").alias("numbers"), F.max("node_idx").alias("last")]
    for t in tasks:
        aggs += [F.count_if(f"eligible_{t}").alias(f"eligible_{t}"), F.count_if(F.col(f"eligible_{t}") & (F.col(f"label_{t}") == 1)).alias(f"positive_{t}")]
    out = rows.groupBy("split", "cutoff").agg(*aggs).join(F.broadcast(nodes.agg(F.count("*").alias("nodes"))), F.lit(True), "left")
    return out.withColumn("complete", (F.col("rows") == F.col("nodes")) & (F.col("numbers") == F.col("nodes")) & (F.col("last") == F.col("nodes") - 1)).drop("numbers", "last")


def write_snapshots(rows: DataFrame, path: str) -> None:
    """Snapshots as Parquet in folders by split and cutoff."""
    rows.write.partitionBy("split", "cutoff").parquet(path)
