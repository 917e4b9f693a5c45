"""Profiles and audits: each returns rows of findings, from one aggregation over each table where possible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evgraph.functions import expr


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def profile(df: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """One row for each column: type, kind, rows, nulls, distinct values, warnings. All columns are measured in one pass."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    flat = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct")]
    one = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(flat)), *(distinct(c).alias(f"d_{i}") for i, c in enumerate(flat)))
    types = dict(df.dtypes)
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("type"), F.col(f"n_{i}").alias("nulls"), F.col(f"d_{i}").alias("distinct_values")) for i, c in enumerate(flat)))
    out = one.select("n", F.explode(rows).alias("c")).select(F.lit(name).alias("table_name"), F.col("n").alias("rows"), "c.*")
    out = out.withColumn("kind", expr.column_kind(F.col("column_name"))).withColumn("null_fraction", F.round(F.col("nulls") / F.nullif("rows", F.lit(0)), 6))
    limit = F.when(F.col("kind") == "id", 0.5).when(F.col("kind").isin("date", "year"), 0.5).otherwise(0.9)
    return out.withColumn("warning", F.when(F.col("null_fraction") >= limit, F.concat(F.lit("mostly null "), F.col("kind"))))


def key_audit(df: DataFrame, name: str, key: Column) -> DataFrame:
    """Rows, missing, distinct and repeated keys of a node table."""
    k = expr.key(key)
    one = df.agg(F.count("*").alias("rows"), F.count_if(k.isNull()).alias("missing"), F.count_distinct(k).alias("distinct_keys"))
    repeated = F.col("rows") - F.col("missing") - F.col("distinct_keys")
    warn = F.concat_ws(";", F.when(F.col("rows") == 0, "empty"), F.when(F.col("missing") > 0, "missing keys"), F.when(repeated > 0, "repeated keys"))
    return one.select(F.lit(name).alias("table_name"), "*", repeated.alias("repeated"), warn.alias("warnings"))


def edge_audit(df: DataFrame, name: str, source: Column, target: Column) -> DataFrame:
    """Rows, missing ends, distinct ends and repeated pairs of an edge table."""
    s, t = expr.key(source), expr.key(target)
    return df.agg(
        F.count("*").alias("rows"), F.count_if(s.isNull()).alias("missing_sources"), F.count_if(t.isNull()).alias("missing_targets"),
        F.count_distinct(s).alias("sources"), F.count_distinct(t).alias("targets"), (F.count_if(s.isNotNull() & t.isNotNull()) - F.count_distinct(s, t)).alias("repeated_pairs"),
    ).select(F.lit(name).alias("table_name"), "*")


def coverage(child: DataFrame, key: Column, parent: DataFrame, parent_key: Column, name: str) -> DataFrame:
    """How many rows and distinct keys of a child table have a parent; under 95 % warns."""
    c = child.select(expr.key(key).alias("k")).filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    p = parent.select(expr.key(parent_key).alias("k")).filter("k is not null").distinct().withColumn("known", F.lit(1))
    j = c.join(p, "k", "left")
    out = j.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)), F.lit(0)).alias("matched_rows"),
        F.count("*").alias("keys"), F.count_if(F.col("known") == 1).alias("matched_keys"),
    )
    rate = F.round(F.col("matched_rows") / F.nullif("rows", F.lit(0)), 6)
    return out.select(F.lit(name).alias("relation"), "*", rate.alias("row_rate"), F.round(F.col("matched_keys") / F.nullif("keys", F.lit(0)), 6).alias("key_rate"), F.coalesce(rate < 0.95, F.lit(False)).alias("warns"))


def key_trial(child: DataFrame, key: Column, parent: DataFrame, parent_key: Column, modes: list[str]) -> DataFrame:
    """Coverage under each way to normalize the keys, and which is best (share of keys, then of rows, then the order given)."""
    tried = []
    for i, m in enumerate(modes):
        c = coverage(child, expr.project_key(key, m), parent, expr.project_key(parent_key, m), m).withColumn("priority", F.lit(i))
        tried.append(c)
    rows = union_all(tried)
    best = rows.agg(F.max_by("relation", F.struct("key_rate", "row_rate", -F.col("priority"))).alias("best"))
    return rows.join(F.broadcast(best), F.lit(True), "left").select(F.col("relation").alias("mode"), "matched_rows", "matched_keys", "row_rate", "key_rate", (F.col("relation") == F.col("best")).alias("best"))


def status(checks: DataFrame, errors: str = "violations") -> DataFrame:
    """Checks that fail and that pass, and the overall status."""
    out = checks.agg(F.count("*").alias("checks"), F.count_if(F.col(errors) > 0).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "FAIL").otherwise("PASS"))


def unit_checks(units: DataFrame, evidence: DataFrame, pair_types: list[str]) -> DataFrame:
    """One row for each sanity check of units and their evidence with the number of violations."""
    a = units.agg(
        F.count_if(~F.col("pair_type").isin(pair_types)).alias("unknown_pair_type"), (F.count("*") - F.count_distinct("unit_id")).alias("repeated_unit"),
        F.count_if(F.col("entity_a") == F.col("entity_b")).alias("self_pair"),
        (F.count("*") - F.count_distinct(expr.unordered_pair_key(F.col("pair_type"), F.col("entity_a"), F.col("entity_b")))).alias("reversed_pair"),
    )
    orphans = evidence.join(units.select("unit_id"), "unit_id", "left_anti").agg(F.count("*").alias("evidence_without_unit"))
    counted = evidence.groupBy("unit_id").agg(F.count_distinct("carrier_key").alias("n"))
    off = units.join(counted, "unit_id", "left").agg(F.count_if(~F.col("n").eqNullSafe(F.col("carrier_count"))).alias("count_mismatch"))
    parts = [x.unpivot([], x.columns, "check", "violations") for x in (a, orphans, off)]
    return union_all(parts).withColumn("passed", F.col("violations") == 0)


def link_profile(df: DataFrame, name: str) -> DataFrame | None:
    """Rows and repeated id tuples of a link table, with its id columns: the first half are likely sources, the others targets. None if it isn't one.

    A link table has "link" in its name or in a column's, or eight columns at most and two ids or more (columns that end in key or id).
    """
    ids = [c for c in df.columns if c.lower().endswith(("key", "id"))]
    if not (any("link" in x.lower() for x in (name, *df.columns)) or (len(df.columns) <= 8 and len(ids) >= 2)):
        return None
    half = max(1, len(ids) // 2)
    distinct = df.select(*ids).distinct().agg(F.count("*").alias("distinct_links")) if ids else df.limit(0).agg(F.count("*").alias("distinct_links"))
    return df.agg(F.count("*").alias("rows")).join(F.broadcast(distinct), F.lit(True), "left").select(
        F.lit(name).alias("table_name"), "rows", F.lit("|".join(ids)).alias("id_columns"), F.lit("|".join(ids[:half])).alias("likely_sources"), F.lit("|".join(ids[half:])).alias("likely_targets"),
        (F.col("rows") - F.col("distinct_links")).alias("duplicate_rows"),
    )


def normalization(df: DataFrame, column: str, name: str) -> DataFrame:
    """How many ids are missing, blank, not upper case, or hold a blank or a dash; a table without the column is a warning of its own."""
    if column not in df.columns:
        return df.sparkSession.range(1).select(F.lit(name).alias("check"), F.lit(None).cast("long").alias("rows"), F.lit(None).cast("long").alias("bad"), F.lit("missing column").alias("warning"))
    x = F.col(column).cast("string")
    bad = x.isNull() | (F.trim(x) == "") | (x != F.upper(x)) | x.contains(" ") | x.contains("-")
    one = df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("bad"))
    return one.select(F.lit(name).alias("check"), "rows", "bad", F.when(F.col("bad") > 0, "ids not fully normalized").otherwise("").alias("warning"))


def ungrounded(df: DataFrame, column: str, name: str, marker: str) -> DataFrame:
    """How many ids are the marker of an ungrounded entity, whatever their case."""
    if column not in df.columns:
        return df.sparkSession.range(1).select(F.lit(name).alias("check"), F.lit(None).cast("long").alias("rows"), F.lit(None).cast("long").alias("bad"), F.lit("missing column").alias("warning"))
    one = df.agg(F.count("*").alias("rows"), F.count_if(F.upper(F.trim(F.col(column).cast("string"))) == marker.upper()).alias("bad"))
    return one.select(F.lit(name).alias("check"), "rows", "bad", F.when(F.col("bad") > 0, "ungrounded ids present").otherwise("").alias("warning"))


def unmatched_by_type(links: DataFrame, known: DataFrame, marker: str, xrefs: list[str]) -> DataFrame:
    """Link rows (source_table, entity_type, entity_id, mention) whose entity isn't known (entity_id), by table and type: rows, ids, how many hold each cross reference, samples, a warning.

    A null entity counts as unmatched. Ids are counted exactly; samples are the least id and its least mention.
    """
    lost = links.withColumn("entity_id", expr.key(F.col("entity_id"))).join(known.select(expr.key(F.col("entity_id")).alias("entity_id")).filter("entity_id is not null").distinct(), "entity_id", "left_anti")
    out = lost.groupBy("source_table", F.coalesce("entity_type", F.lit("")).alias("entity_type")).agg(
        F.count("*").alias("row_count"), F.count_distinct("entity_id").alias("entity_ids"), *(F.count(x).alias(f"{x}_present") for x in xrefs),
        F.min("entity_id").alias("sample_entity_id"), F.min("mention").alias("sample_mention"), F.count_if(F.upper("entity_id").eqNullSafe(F.lit(marker.upper()))).alias("ungrounded_rows"),
    )
    warning = F.when(F.col("ungrounded_rows") == F.col("row_count"), "ungrounded mentions").when(F.col("ungrounded_rows") == 0, "ids missing from the dictionary").otherwise("both")
    return out.withColumn("warning", warning)


def unmatched_by_entity(links: DataFrame, known: DataFrame, marker: str, sample: int = 5) -> DataFrame:
    """Each unknown entity of a source table: rows, distinct mentions, its types, the first mentions by name, and what to do with it.

    A marker of ungrounded mentions would be the hottest key of all, so mentions are counted by (entity, type, mention) first and only their counts meet.
    """
    lost = links.withColumn("entity_id", expr.key(F.col("entity_id"))).join(known.select(expr.key(F.col("entity_id")).alias("entity_id")).filter("entity_id is not null").distinct(), "entity_id", "left_anti")
    each = lost.groupBy("source_table", "entity_id", "mention").agg(F.count("*").alias("n"), F.collect_set("entity_type").alias("types"))
    first = each.filter(F.col("mention").isNotNull()).withColumn("cut", F.substring(F.md5("mention"), 1, 2))
    # the first mentions of each of 256 cuts, then the first of those: no window holds all mentions of an entity
    for keys in (["source_table", "entity_id", "cut"], ["source_table", "entity_id"]):
        first = first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("mention"))).filter(F.col("place") <= sample)
    samples = first.groupBy("source_table", "entity_id").agg(F.array_join(F.sort_array(F.collect_list("mention")), "|").alias("sample_mentions"))
    out = each.groupBy("source_table", "entity_id").agg(
        F.sum("n").alias("row_count"), F.count("mention").alias("mentions"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))), "|").alias("entity_types"),
    )
    advice = F.when(F.upper(out["entity_id"]) == marker.upper(), "leave out, or count as ungrounded mentions").otherwise("review, or add to the dictionary")
    same = out["source_table"].eqNullSafe(samples["source_table"]) & out["entity_id"].eqNullSafe(samples["entity_id"])
    return out.join(samples, same, "left").select(out["source_table"], out["entity_id"], "row_count", "mentions", "entity_types", F.coalesce("sample_mentions", F.lit("")).alias("sample_mentions"), advice.alias("advice"))


def unmatched_decision(by_entity: DataFrame, marker: str) -> DataFrame:
    """One row for all unknown entities: rows, those of the marker and others, the marker's share, and which dictionary to use."""
    mark = F.upper("entity_id").eqNullSafe(F.lit(marker.upper()))
    one = by_entity.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("unmatched_rows"), F.coalesce(F.sum(F.when(mark, F.col("row_count"))), F.lit(0)).alias("ungrounded_rows"))
    out = one.withColumn("other_rows", F.col("unmatched_rows") - F.col("ungrounded_rows"))
    share = F.coalesce(F.col("ungrounded_rows") / F.nullif("unmatched_rows", F.lit(0)), F.lit(0.0))
    decision = (
        F.when(F.col("unmatched_rows") == 0, "dictionary covers all").when((share >= 0.99) & (F.col("other_rows") == 0), "leave out ungrounded, use the dictionary")
        .when(share >= 0.99, "leave out ungrounded, review few others").otherwise("review others, consider adding nodes")
    )
    return out.withColumn("ungrounded_share", F.round(share, 6)).withColumn("decision", decision)


def match_stats(raw: DataFrame, kept: DataFrame, name: str) -> DataFrame:
    """Rows of a link table before and after its ends were matched, and the rate."""
    both = raw.agg(F.count("*").alias("raw_rows")).join(kept.agg(F.count("*").alias("matched_rows")), F.lit(True), "left")
    return both.select(
        F.lit(name).alias("link_table"), "raw_rows", "matched_rows", (F.col("raw_rows") - F.col("matched_rows")).alias("unmatched_rows"), F.round(F.col("matched_rows") / F.nullif("raw_rows", F.lit(0)), 6).alias("match_rate"),
    )


def input_checks(tables: dict[str, DataFrame], required: dict[str, list[str]], keys: list[tuple[str, str, str, str]] = ()) -> DataFrame:
    """(check, table_name, violations, detail) of a step's inputs: tables that are missing, columns they lack, empty ones, and keys (child, column, parent, column) without a parent.

    A check whose table or column is missing isn't made; that is a violation of the check before it. Keys are compared as trimmed text, blank ones don't count.
    """
    some = next(iter(tables.values()))
    fixed, counted = [], []
    for name, columns in required.items():
        fixed.append(("table present", name, int(name not in tables), ""))
        if name in tables:
            lacking = [c for c in columns if c not in tables[name].columns]
            fixed.append(("required columns", name, len(lacking), ",".join(lacking)))
            rows = tables[name].limit(1).agg((1 - F.count("*")).alias("violations"))
            counted.append(rows.select(F.lit("not empty").alias("check"), F.lit(name).alias("table_name"), "violations", F.lit("").alias("detail")))
    for child, column, parent, parent_column in keys:
        if child in tables and parent in tables and column in tables[child].columns and parent_column in tables[parent].columns:
            lost = tables[child].select(expr.key(F.col(column)).alias("k")).filter("k is not null").join(tables[parent].select(expr.key(F.col(parent_column)).alias("k")), "k", "left_anti")
            counted.append(lost.agg(F.count("*").alias("violations")).select(F.lit("keys known").alias("check"), F.lit(child).alias("table_name"), "violations", F.lit(f"{column} in {parent}.{parent_column}").alias("detail")))
    rows = F.array(*(F.struct(F.lit(c).alias("check"), F.lit(t).alias("table_name"), F.lit(n).cast("long").alias("violations"), F.lit(d).alias("detail")) for c, t, n, d in fixed))
    return union_all([some.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*"), *counted])


def sanity(units: DataFrame, evidence: DataFrame, expected: list[str], forbidden_pairs: list[str], forbidden_entities: list[str], modalities: list[str], summary: DataFrame) -> DataFrame:
    """The checks of finished units with PASS, WARN or FAIL and the number behind it, for a unit table whose pair types are "a-b" of the entities' types.

    evidence: unit_id, carrier_key, carrier_type. summary, one row: unit_count, edge_count as the builder reported them. A missing expected pair type is a warning.
    Counts by modality (columns <modality>_count of units) must equal the evidence's distinct carriers of that type. Supports and cross-modal units are told with PASS.
    """
    side = lambda i: F.split("pair_type", "-")[i]
    supported = lambda *m: F.greatest(*(F.col(f"{x}_count") for x in m), F.lit(0)) > 0
    seen = sum((F.col(f"{m}_count") > 0).cast("int") for m in modalities)
    present = units.select("pair_type").distinct()
    a = units.agg(
        F.count_if(~F.col("pair_type").isin(expected)).alias("unexpected_pair_types"), F.count_if(F.col("pair_type").isin(forbidden_pairs)).alias("forbidden_pair_types"),
        F.count_if(side(0).isin(forbidden_entities) | side(1).isin(forbidden_entities)).alias("forbidden_entity_types"), F.count_if(F.col("entity_a") == F.col("entity_b")).alias("self_pairs"),
        (F.count("*") - F.count_distinct("unit_id")).alias("repeated_units"),
    )
    told = units.agg(F.count_if(seen >= 2).alias("cross_modal_units"), *(F.count_if(supported(m)).alias(f"{m}_supported_units") for m in modalities))
    lacking = units.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, expected))).alias("pair_type")).join(present, "pair_type", "left_anti").agg(F.count("*").alias("expected_pair_types_absent"))
    reversed_ = units.groupBy(expr.unordered_pair_key(F.col("pair_type"), F.col("entity_a"), F.col("entity_b")).alias("k")).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("reversed_pairs"))
    orphans = evidence.join(units.select("unit_id"), "unit_id", "left_anti").agg(F.count("*").alias("evidence_without_unit"))
    counted = evidence.groupBy("unit_id").agg(F.count_distinct("carrier_key").alias("__all"), *(F.count_distinct(F.when(F.col("carrier_type") == m, F.col("carrier_key"))).alias(f"__{m}") for m in modalities))
    differs = F.lit(False)
    for m, c in [("all", "carrier_count"), *((m, f"{m}_count") for m in modalities)]:
        differs = differs | (F.coalesce(f"__{m}", F.lit(0)) != F.col(c))
    off = units.join(counted, "unit_id", "left").agg(F.count_if(differs).alias("count_mismatches"))
    totals = units.agg(F.count("*").alias("u")).join(evidence.agg(F.count("*").alias("e")), F.lit(True), "left").join(summary, F.lit(True), "left")
    totals = totals.select(F.abs(F.coalesce("unit_count", F.lit(-1)) - F.col("u")).alias("summary_units_differ"), F.abs(F.coalesce("edge_count", F.lit(-1)) - F.col("e")).alias("summary_edges_differ"))
    parts = {"FAIL": [a, reversed_, orphans, off, totals], "WARN": [lacking], "PASS": [told]}
    rows = [x.select(*(F.col(c).cast("long").alias(c) for c in x.columns)).unpivot([], x.columns, "check", "n").withColumn("status", F.when(F.col("n") > 0, s).otherwise("PASS")) for s, xs in parts.items() for x in xs]
    return union_all(rows).select("check", "status", "n")
