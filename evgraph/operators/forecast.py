"""Forecast examples: what a unit's history up to a cutoff tells about the years after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evgraph.operators import neighbourhoods


def cutoff_table(spark, cutoffs: list[tuple[int, str]], horizon: int, first_year: int) -> DataFrame:
    """cutoff, split, history_start, future_end: a handful of rows."""
    rows = F.array(*(F.struct(F.lit(c).alias("cutoff"), F.lit(s).alias("split")) for c, s in cutoffs))
    t = spark.range(1).select(F.explode(rows).alias("x")).select("x.*")
    return t.withColumn("history_start", F.lit(first_year)).withColumn("future_end", F.col("cutoff") + horizon)


def heat(n: Column) -> Column:
    """log10(1 + n)."""
    return F.log10(n + 1)


def examples(by_year: DataFrame, cutoffs: DataFrame, horizon: int, base: str, follow_ups: list[str], dealt: tuple[str, ...] = ()) -> DataFrame:
    """One row for each unit with history and each cutoff: counts of the past, targets of the next `horizon` years.

    Running totals are made once for each unit and looked up at cutoff, cutoff - 3, cutoff - 5 and cutoff + horizon
    by the years' ranges: one aggregation over the yearly rows joined to the few cutoffs, no cross product with raw evidence.
    dealt: columns that a unit has one value of and that the rows are dealt by; with them the aggregation needs no shuffle. They stay.
    """
    rows = by_year.join(F.broadcast(cutoffs), F.col("year") <= F.col("future_end"))
    past, future = F.col("year") <= F.col("cutoff"), (F.col("year") > F.col("cutoff"))

    def total(column: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(column))), F.lit(0)).cast("bigint")

    aggs = [
        total("carriers", past).alias("history_total"),
        total("carriers", past & (F.col("year") > F.col("cutoff") - 3)).alias("recent_3"),
        total("carriers", past & (F.col("year") > F.col("cutoff") - 5)).alias("recent_5"),
        total("carriers", past & F.col("year").between(F.col("cutoff") - 5, F.col("cutoff") - 3)).alias("previous_3"),
        F.count_if(past & (F.col("carriers") > 0)).alias("active_years"),
        F.min(F.when(past, F.col("year"))).alias("first_active"),
        F.max(F.when(past, F.col("year"))).alias("last_active"),
        total("carriers", future).alias("future_total"),
    ]
    for m in [base, *follow_ups]:
        aggs += [total(f"{m}_carriers", past).alias(f"history_{m}"), total(f"{m}_carriers", future).alias(f"future_{m}")]
    out = rows.groupBy("unit_id", *dealt, "cutoff", "split").agg(*aggs).filter(F.col("history_total") > 0)
    for m in follow_ups:
        out = out.withColumn(f"eligible_{m}", (F.col(f"history_{base}") > 0) & (F.col(f"history_{m}") == 0))
        out = out.withColumn(f"label_{m}", (F.col(f"future_{m}") > 0).cast("int"))
        out = out.withColumn(f"heat_{m}", F.round(heat(F.col(f"future_{m}")), 6))
    any_label = F.greatest(*(F.col(f"label_{m}") for m in follow_ups))
    none_yet = sum((F.col(f"history_{m}") for m in follow_ups), F.lit(0)) == 0
    out = out.withColumn("label_follow_up", any_label).withColumn("eligible_follow_up", (F.col(f"history_{base}") > 0) & none_yet)
    return out.withColumn("age", F.col("cutoff") - F.col("first_active")).withColumn("idle", F.col("cutoff") - F.col("last_active"))


def task(rows: DataFrame, name: str) -> DataFrame:
    """Examples that are eligible for a task, with its label."""
    return rows.filter(F.col(f"eligible_{name}")).withColumn("label", F.col(f"label_{name}"))


def tasks(rows: DataFrame, names: list[str]) -> DataFrame:
    """Each example once for every task that it is eligible for (task), with that task's label, by one pass."""
    each = F.array(*(F.struct(F.lit(n).alias("task"), F.col(f"eligible_{n}").alias("eligible"), F.col(f"label_{n}").alias("label")) for n in names))
    return rows.withColumn("t", F.explode(each)).filter("t.eligible").select(*rows.columns, "t.task", "t.label")


def leakage_audit(rows: DataFrame, follow_ups: list[str], splits: list[str]) -> DataFrame:
    """One row for each check with the number of rows that break it."""
    parts = sum((F.col(f"history_{m}") for m in follow_ups), F.lit(0)) + F.col("history_base")
    checks = {
        "history_after_cutoff": F.col("last_active") > F.col("cutoff"),
        "unknown_split": ~F.col("split").isin(splits),
        "counts_not_additive": F.col("history_total") != parts,
        "label_not_union": F.col("label_follow_up") != F.greatest(*(F.col(f"label_{m}") for m in follow_ups)),
        "eligible_without_base": F.col("eligible_follow_up") & (F.col("history_base") == 0),
        "eligible_with_follow_up": F.col("eligible_follow_up") & (sum((F.col(f"history_{m}") for m in follow_ups), F.lit(0)) > 0),
        "recent_over_history": F.col("recent_5") > F.col("history_total"),
        "negative_age": F.col("age") < 0,
    }
    one = rows.agg(*(F.count_if(c).alias(k) for k, c in checks.items()))
    return one.unpivot([], list(checks), "check", "violations").withColumn("passed", F.col("violations") == 0)


def shared_entity_edges(units: DataFrame, low: int, high: int, k: int, block: int = 256) -> DataFrame:
    """Links of units that share an entity, weighted by 1 / ln(1 + degree) of each shared one; the k heaviest of each unit.

    Entities with a degree outside of low to high are left out before the self-join, so no hub makes all its pairs. The units of
    a wide entity are dealt into blocks of about `block`, each joined to all of the entity's units, so no task makes all its pairs.
    """
    sides = units.select("unit_id", F.explode(F.array("entity_a", "entity_b")).alias("entity_id"))
    degree = sides.groupBy("entity_id").agg(F.count("*").alias("degree")).filter(F.col("degree").between(low, high))
    kept = sides.join(degree, "entity_id").withColumn("w", 1 / F.log(1 + F.col("degree"))).withColumn("blocks", F.ceil(F.col("degree") / block).cast("int"))
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("unit_id"), F.col("blocks").cast("long")).cast("int")).select("entity_id", "block", "unit_id", "w")
    others = kept.select("entity_id", F.col("unit_id").alias("dst"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = dealt.join(others, ["entity_id", "block"]).filter(F.col("unit_id") != F.col("dst"))
    weighed = pairs.groupBy(F.col("unit_id").alias("src"), "dst").agg(F.round(F.sum("w"), 6).alias("edge_weight"), F.count("*").alias("shared"))
    order = Window.partitionBy("src").orderBy(F.desc("edge_weight"), F.desc("shared"), "dst")
    return weighed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def neighbour_state(edges: DataFrame, state: DataFrame, columns: list[str], by: str = "cutoff") -> DataFrame:
    """Mean, largest, sum and weighted mean of the neighbours' state, all cutoffs at once."""
    joined = edges.join(state.select(F.col("unit_id").alias("dst"), by, *columns), "dst")
    aggs = [F.count("*").alias("neighbours"), F.round(F.sum("edge_weight"), 6).alias("weight_sum")]
    for c in columns:
        aggs += [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.sum(c).alias(f"{c}_sum")]
        aggs.append(F.round(F.sum(F.col("edge_weight") * F.col(c)) / F.sum("edge_weight"), 6).alias(f"{c}_wmean"))
    return joined.groupBy(F.col("src").alias("unit_id"), by).agg(*aggs)


def normalized(rows: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """(x - mean) / std with mean and std of the training rows alone; a std under 1e-6 counts as 1."""
    stats = rows.filter(train).agg(*(F.avg(c).alias(f"{c}__m") for c in columns), *(F.stddev_pop(c).alias(f"{c}__s") for c in columns))
    out = rows.join(F.broadcast(stats), F.lit(True), "left")
    scaled = {f"{c}_z": (F.col(c) - F.col(f"{c}__m")) / F.when(F.col(f"{c}__s") < 1e-6, 1.0).otherwise(F.col(f"{c}__s")) for c in columns}
    return out.withColumns(scaled).drop(*(f"{c}__{x}" for c in columns for x in "ms"))


def year_checks(by_year: DataFrame, cutoffs: DataFrame, first: int) -> DataFrame:
    """The years of the data against those that the cutoffs need: history from `first` on, futures up to the last future_end."""
    have = by_year.agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.count("*").alias("rows"), F.count_distinct("unit_id").alias("units"))
    need = cutoffs.agg(F.lit(first).alias("history_start"), F.max("future_end").alias("last_future_end"))
    out = have.join(F.broadcast(need), F.lit(True), "left")
    return out.withColumn("history_covered", F.coalesce(F.col("history_start") >= F.col("year_min"), F.lit(False))).withColumn("future_covered", F.coalesce(F.col("last_future_end") <= F.col("year_max"), F.lit(False)))


def top_shared_entity_edges(units: DataFrame, low: int, high: int, k: int) -> DataFrame:
    """The edges of shared_entity_edges, without making all pairs of an entity's units and without a shuffle of edges (see neighbourhoods)."""
    return neighbourhoods.top_edges(units, low, high, k)
