"""Entity-pair units: mentions of a carrier, pairs of allowed types, support, and the unit table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.functions import expr


def standardize(raw: DataFrame, carriers: DataFrame, entities: DataFrame, drop_types: list[str], keep_undated: bool = False) -> DataFrame:
    """Mention counts of (carrier, entity), with the carrier's type and year and the entity's type.

    Mentions of entities that aren't known go first. Those left meet their carriers, are counted and stay dealt by carrier_id, so that whatever
    a carrier's mentions are grouped for needs no further shuffle.
    """
    known = entities.filter(~F.col("entity_type").isin(drop_types)).select("entity_id", "entity_type")
    dated = carriers.select("carrier_id", "carrier_type", "year")
    dated = dated if keep_undated else dated.filter(F.col("year").isNotNull())
    met = raw.select("carrier_id", "entity_id").join(known, "entity_id").repartition("carrier_id").join(dated, "carrier_id")
    counted = met.groupBy("carrier_id", "carrier_type", "year", "entity_id", "entity_type").agg(F.count("*").alias("mention_count"))
    return counted.withColumn("carrier_key", F.concat_ws(":", "carrier_type", "carrier_id"))


def cap_entities(mentions: DataFrame, most: int) -> DataFrame:
    """The entities of each carrier with most mentions, ties by id."""
    order = Window.partitionBy("carrier_key").orderBy(F.desc("mention_count"), "entity_id")
    return mentions.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


def _sides(mentions: DataFrame, pair_types: list[tuple[str, str]]) -> DataFrame:
    """entity_a, type_a, first (its mention count, its carrier and year) of each mention that can be a pair's first, with those of its carrier and year that can be second (others).

    A carrier's mentions are one array, so that no row is made for a pair yet.
    """
    dated = mentions.filter(F.col("year").isNotNull() & F.col("entity_type").isin(*{t for p in pair_types for t in p}))
    held = dated.groupBy("carrier_id", "carrier_type", "year").agg(F.collect_list(F.struct("entity_id", "entity_type", "mention_count")).alias("held"))
    firsts, seconds = {x for x, _ in pair_types}, sorted({y for _, y in pair_types})
    of = lambda *types: F.filter("held", lambda e: e["entity_type"].isin(*types))
    each = held.withColumns({f"second_{y}": of(y) for y in seconds}).withColumn("a", F.explode(of(*firsts)))
    others = F.lit(None)
    for x in firsts:
        others = F.when(F.col("a.entity_type") == x, F.concat(*(f"second_{y}" for y in seconds if (x, y) in pair_types))).otherwise(others)
    first = F.struct(F.col("a.mention_count").alias("mention_count_a"), "carrier_type", "carrier_id", "year")
    return each.select(F.col("a.entity_id").alias("entity_a"), F.col("a.entity_type").alias("type_a"), first.alias("first"), others.alias("others")).filter(F.size("others") > 0)


def _met(sides: DataFrame, pair_types: list[tuple[str, str]]) -> DataFrame:
    """entity_a, kind (the pair type's number), first and second (entity_id, mention_count) of the pairs of all sides."""
    met = sides.select("entity_a", "type_a", "first", F.explode("others").alias("second"))
    a, b, kind = F.col("entity_a"), F.col("second.entity_id"), F.lit(None).cast("int")
    for i, (x, y) in reversed(list(enumerate(pair_types))):
        kind = F.when((F.col("type_a") == x) & (F.col("second.entity_type") == y) & ((a < b) if x == y else (a != b)), F.lit(i)).otherwise(kind)
    return met.withColumn("kind", kind).filter(F.col("kind").isNotNull()).drop("type_a")


def _flat(pairs: DataFrame) -> DataFrame:
    """entity_a, entity_b, kind, mention counts, carrier and year of pairs."""
    return pairs.select("entity_a", F.col("second.entity_id").alias("entity_b"), "kind", F.col("second.mention_count").alias("mention_count_b"), "first.*")


def _named(pairs: DataFrame, pair_types: list[tuple[str, str]], weight: str, algorithm: str) -> DataFrame:
    """Pairs with what follows from them: the pair type, the carrier's key, the weight and the unit's id."""
    pair_type = F.element_at(F.array(*(F.lit("-".join(p)) for p in pair_types)), F.col("kind") + 1)
    out = pairs.withColumn("pair_type", pair_type).drop("kind").withColumn("carrier_key", F.concat_ws(":", "carrier_type", "carrier_id"))
    return out.withColumn("pair_weight", expr.pair_weight(F.col("mention_count_a"), F.col("mention_count_b"), weight)).withColumn(
        "unit_id", expr.unit_id(F.col("pair_type"), F.col("entity_a"), F.col("entity_b"), algorithm=algorithm)
    )


def evidence(mentions: DataFrame, pair_types: list[tuple[str, str]], weight: str = "sqrt_product", algorithm: str = "md5") -> DataFrame:
    """All pairs of allowed types that a carrier mentions in a year, in the order of the pair type."""
    return _named(_flat(_met(_sides(mentions, pair_types), pair_types)), pair_types, weight, algorithm)


def supported_evidence(mentions: DataFrame, pair_types: list[tuple[str, str]], least: int, weight: str = "sqrt_product", algorithm: str = "md5") -> DataFrame:
    """The evidence of units that at least so many carriers hold: with_support(evidence(...), least) by one shuffle.

    A mention that can be a pair's first is dealt by its entity, once, with all that it meets in its carrier; pairs are made behind the shuffle. Most are of units with too few rows:
    they go by the count of a 64-bit hash of the pair, before anything else is made of them; units are told apart exactly among the rest. What is left stays dealt by entity_a.
    """
    near = F.xxhash64("entity_a", "second.entity_id", "kind")
    dealt = _met(_sides(mentions, pair_types).repartition("entity_a"), pair_types).withColumn("near", near)
    often = dealt.withColumn("n", F.count("*").over(Window.partitionBy("near", "entity_a"))).filter(F.col("n") >= least)
    unit = Window.partitionBy("entity_a", "entity_b", "kind")
    # a carrier may hold a unit in several rows, so carriers are numbered among the few rows that are left
    numbered = _flat(often).withColumn("n", F.dense_rank().over(unit.orderBy(F.concat_ws(":", "carrier_type", "carrier_id"))))
    kept = numbered.withColumn("n", F.max("n").over(unit)).filter(F.col("n") >= least).drop("n")
    return _named(kept, pair_types, weight, algorithm)


def master(rows: DataFrame, modalities: list[str]) -> DataFrame:
    """One row for each unit: support, weights, years, carriers of each modality. A carrier's rows are summed up first, so that distinct carriers are plain counts."""
    unit = ["unit_id", "pair_type", "entity_a", "entity_b"]
    own = lambda m: F.count_if((F.col("carrier_type") == m) & F.col("carrier_key").isNotNull())
    each = rows.groupBy(*unit, "carrier_key").agg(
        F.sum("pair_weight").alias("w"), F.count("pair_weight").alias("n"), F.max("pair_weight").alias("most"), F.min("year").alias("low"), F.max("year").alias("high"), *(own(m).alias(f"own_{m}") for m in modalities)
    )
    return each.groupBy(*unit).agg(
        F.count("carrier_key").alias("carrier_count"),
        F.round(F.sum("w"), 6).alias("total_weight"),
        F.round(F.sum("w") / F.sum("n"), 6).alias("mean_weight"),
        F.round(F.max("most"), 6).alias("max_weight"),
        F.min("low").alias("first_year"),
        F.max("high").alias("last_year"),
        *(F.count_if(F.col(f"own_{m}") > 0).alias(f"{m}_count") for m in modalities),
    )


def with_support(rows: DataFrame, least: int) -> DataFrame:
    """Evidence of units that at least so many carriers hold."""
    held = rows.groupBy("unit_id").agg(F.count_distinct("carrier_key").alias("n")).filter(F.col("n") >= least)
    return rows.join(held.select("unit_id"), "unit_id", "left_semi")


def support_sweep(units: DataFrame, thresholds: list[int]) -> DataFrame:
    """Units and evidence rows that stay at each threshold, from one pass over the units (unit_id, carrier_count, rows)."""
    each = units.withColumn("least", F.explode(F.array(*map(F.lit, thresholds)))).filter(F.col("carrier_count") >= F.col("least"))
    return each.groupBy("least").agg(F.count("*").alias("units"), F.sum("rows").alias("evidence_rows"))
