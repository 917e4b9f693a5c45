"""Joins by role. Physical strategies are left to the optimizer; only tables of a fixed small size are hinted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_known(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key is among the known ones."""
    return df.join(known.select(F.col(known_key).alias(key)), key, "left_semi")


def unmatched(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key is null or not among the known ones."""
    return df.join(known.select(F.col(known_key).alias(key)), key, "left_anti")


def induced(edges: DataFrame, nodes: DataFrame, source: str = "source_id", target: str = "target_id", node: str = "node_id") -> DataFrame:
    """Edges both of whose ends are nodes."""
    return keep_known(keep_known(edges, source, nodes, node), target, nodes, node)


def context(edges: DataFrame, nodes: DataFrame, source: str = "source_id", target: str = "target_id", node: str = "node_id") -> DataFrame:
    """Edges at least one of whose ends is a node, each once: those with a known source, and others with a known target."""
    by_source = keep_known(edges, source, nodes, node)
    by_target = unmatched(edges, source, nodes, node)
    return by_source.unionByName(keep_known(by_target, target, nodes, node))


def attach(df: DataFrame, more: DataFrame, on: list[str] | str, defaults: dict) -> DataFrame:
    """Left join with defaults for what is missing."""
    return df.join(more, on, "left").fillna(defaults)


def compare_counts(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Rows of each group before and after a step, groups that vanish or appear included."""
    b = before.groupBy(by).agg(F.count("*").alias("rows_before"))
    a = after.groupBy(by).agg(F.count("*").alias("rows_after"))
    out = b.join(a, by, "full_outer").fillna(0, ["rows_before", "rows_after"])
    return out.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def validated_merge(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One-to-one inner join that fails while it runs if a key of either side repeats or lacks its partner."""
    sides = [df.withColumn(f"__n{i}", F.lit(1)) for i, df in enumerate((left, right))]
    counted = sides[0].groupBy(on).agg(F.count("*").alias("l")).join(sides[1].groupBy(on).agg(F.count("*").alias("r")), on, "full_outer")
    bad = counted.agg(F.count_if(~(F.coalesce("l", F.lit(0)).eqNullSafe(F.lit(1)) & F.coalesce("r", F.lit(0)).eqNullSafe(F.lit(1)))).alias("bad"))
    checked = bad.select(F.when(F.col("bad") > 0, F.raise_error(F.concat(F.col("bad").cast("string"), F.lit(" keys don't match one to one")))).alias("__ok"))
    return left.join(right, on).join(F.broadcast(checked), F.col("__ok").isNull()).drop("__ok")
