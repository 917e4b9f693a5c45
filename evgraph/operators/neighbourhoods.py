"""Neighbourhoods in the graph of units that share an entity, met where an entity's units lie: no edge is ever shuffled.

All units of an entity are equally heavy neighbours through it alone, and ties go to the smaller id. So a unit's k heaviest neighbours are first its twins, the units that share both
entities, then a number of the smallest ids of its lighter entity, and then of the other one. Those numbers follow from degrees alone (`reaches`); only where both entities weigh
the same and have too many units, the ids of both sides are merged. What a unit takes through an entity is then known among that entity's units: edges are made there
(`top_edges`), and states are summed up there (`pooled`), so that a shuffle carries a row for each unit and entity and not one for each edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.operators.graph import written

CELLS = 1 << 21  # pairs of units that are looked at together


def _sides(units: DataFrame) -> DataFrame:
    return units.select("unit_id", F.explode(F.array("entity_a", "entity_b")).alias("entity_id"))


def reaches(units: DataFrame, low: int, high: int, k: int) -> DataFrame:
    """unit_id, entity_a, entity_b, w_a, w_b (rounded; null where an entity's degree isn't within the bounds), n_a, n_b (neighbours taken through each alone), twins and twin_weight: written."""
    degree = _sides(units).groupBy("entity_id").agg(F.count("*").alias("degree")).filter(F.col("degree").between(low, high))
    rows = units.select("unit_id", "entity_a", "entity_b")
    for x in "ab":
        rows = rows.join(degree.select(F.col("entity_id").alias(f"entity_{x}"), F.col("degree").alias(f"d_{x}")), f"entity_{x}", "left")
    x, y, both = F.least("entity_a", "entity_b"), F.greatest("entity_a", "entity_b"), F.col("d_a").isNotNull() & F.col("d_b").isNotNull()
    rows = written(rows.withColumns({"x": F.when(both, x), "y": F.when(both, y)}), "reaches")
    # pairs of entities that several units have; the first k + 1 ids tell all twins that a unit takes, and all there are if they are fewer than k
    groups = rows.filter("x is not null").groupBy("x", "y").agg(F.count("*").alias("g")).filter("g > 1")
    place = F.row_number().over(Window.partitionBy("x", "y").orderBy("unit_id"))
    first = rows.join(groups, ["x", "y"]).withColumn("place", place).filter(F.col("place") <= k + 1)
    groups = written(first.groupBy("x", "y", "g").agg(F.sort_array(F.collect_list("unit_id")).alias("ids")), "twins")
    if groups.isEmpty():
        rows = rows.withColumns({"t": F.lit(0).cast("long"), "twins": F.lit(None).cast("array<string>")})
    else:
        twins = F.slice(F.array_remove("ids", F.col("unit_id")), 1, k)
        rows = rows.join(groups, ["x", "y"], "left").withColumns({"t": F.coalesce(F.col("g") - 1, F.lit(0)), "twins": F.when(F.col("g") > 1, twins)})
    weight = {z: 1 / F.log(1 + F.col(f"d_{z}")) for z in "ab"}
    rows = rows.withColumns({f"w_{z}": F.round(w, 6) for z, w in weight.items()} | {"twin_weight": F.round(weight["a"] + weight["b"], 6)})
    left = F.greatest(F.lit(k) - F.col("t"), F.lit(0))
    there = {z: F.coalesce(F.col(f"d_{z}") - 1 - F.col("t"), F.lit(0)) for z in "ab"}
    ahead = F.coalesce(F.col("w_a"), F.lit(-1.0)) >= F.coalesce(F.col("w_b"), F.lit(-1.0))
    n_a = F.when(ahead, F.least(left, there["a"])).otherwise(F.least(there["a"], F.greatest(left - there["b"], F.lit(0))))
    columns = ["unit_id", "entity_a", "entity_b", "w_a", "w_b", "n_a", "n_b", "twins", "twin_weight"]
    plain = rows.withColumns({"n_a": n_a, "n_b": F.least(there["b"], left - n_a)})
    tied = F.coalesce((F.col("w_a") == F.col("w_b")) & (there["a"] + there["b"] > left), F.lit(False))
    mixed = rows.filter(tied)
    if mixed.isEmpty():
        return written(plain.select(columns), "reaches")
    own = _sides(rows).join(_sides(mixed), "entity_id", "left_semi")
    heads = own.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy("unit_id"))).filter(F.col("place") <= k + 1).groupBy("entity_id").agg(F.collect_list("unit_id").alias("ids"))
    for z in "ab":
        others = F.array_except(f"ids_{z}", F.concat(F.array("unit_id"), F.coalesce("twins", F.array().cast("array<string>"))))
        mixed = mixed.join(heads.select(F.col("entity_id").alias(f"entity_{z}"), F.col("ids").alias(f"ids_{z}")), f"entity_{z}").withColumn(f"ids_{z}", F.sort_array(others))
    taken = F.slice(F.sort_array(F.concat("ids_a", "ids_b")), F.lit(1), left.cast("int"))
    mixed = mixed.withColumn("n_a", F.size(F.array_intersect(taken, "ids_a")).cast("long")).withColumn("n_b", left - F.col("n_a"))
    return written(plain.filter(~tied).select(columns).unionByName(mixed.select(columns)), "reaches")


def _taking(reach: DataFrame, *more: str) -> DataFrame:
    """entity_id, unit_id, w, n, twins and `more` of each unit and each of its entities within the bounds."""
    side = lambda z: F.struct(F.col(f"entity_{z}").alias("entity_id"), F.col(f"w_{z}").alias("w"), F.col(f"n_{z}").alias("n"))
    rows = reach.select("unit_id", "twins", *more, F.explode(F.array(side("a"), side("b"))).alias("s")).filter("s.w is not null")
    return rows.select("s.entity_id", "unit_id", "s.w", "s.n", "twins", *more)


def _twin_edges(reach: DataFrame) -> DataFrame:
    return reach.select(F.col("unit_id").alias("src"), F.explode("twins").alias("dst"), F.col("twin_weight").alias("edge_weight"), F.lit(2).cast("long").alias("shared"))


def top_edges(units: DataFrame, low: int, high: int, k: int) -> DataFrame:
    """src, dst, edge_weight, shared: the k heaviest neighbours of each unit, ties by shared entities and id. Entities with a degree outside of low to high link nothing."""
    reach = reaches(units, low, high, k)
    kept = _taking(reach)
    line = kept.select("entity_id", F.col("unit_id").alias("dst")).withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy("dst"))).filter(F.col("place") <= k + 1)
    heads = line.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("place", "dst"))).alias("heads"))
    met = kept.filter("n > 0").join(heads, "entity_id").select("unit_id", "w", "n", "twins", F.explode("heads").alias("h"))
    dst, before = F.col("h.dst"), F.when(F.col("unit_id") < F.col("h.dst"), 1).otherwise(0)
    # a twin isn't taken through one entity, and those before leave their places to others
    twins = F.when(F.col("twins").isNull(), 0).otherwise(F.size(F.filter("twins", lambda t: t < dst)))
    taken = (F.col("unit_id") != dst) & (F.col("h.place") - before - twins <= F.col("n")) & ~F.coalesce(F.array_contains("twins", dst), F.lit(False))
    one = met.filter(taken).select(F.col("unit_id").alias("src"), dst.alias("dst"), F.col("w").alias("edge_weight"), F.lit(1).cast("long").alias("shared"))
    return one.unionByName(_twin_edges(reach))


def _masks(place: np.ndarray, n: np.ndarray, heads: int) -> np.ndarray:
    """[entities, units, heads]: which of the first units of an entity each of its units takes, where none has twins."""
    j = np.arange(heads)
    before = place[:, None] < j[None, :]
    return (j[None, None, :] - before[None] < n[:, :, None]) & (place[:, None] != j[None, :])[None]


def _with_twins(mask: np.ndarray, ids: list, n: np.ndarray, twins: list) -> None:
    """Corrects the rows of units with twins in one entity's mask [units, heads]."""
    for r, own in enumerate(twins):
        if own is not None:
            open_ = np.array([x != ids[r] and x not in own for x in ids[: mask.shape[1]]], dtype=bool)
            mask[r] = open_ & (np.cumsum(open_) <= n[r])


def _sums(points: list, columns: list[str], tops: list[str], k: int, incoming: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in the order of entity and unit become the partial sums of each unit at each of the points, entity by entity; entities of the same degree are summed up together."""
    at = {c: i for i, c in enumerate(columns)}

    def entity_groups(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        entity, ids = rows.column("entity_id").to_numpy(zero_copy_only=False), rows.column("unit_id").to_numpy(zero_copy_only=False)
        n, w, twins = rows.column("n").to_numpy(), rows.column("w").to_numpy(), rows.column("twins")
        linked = set(np.nonzero(np.asarray(twins.is_valid()))[0].tolist()) if twins.null_count < len(twins) else set()
        state = np.full((len(ids), len(points), len(columns)), np.nan)
        for p in range(len(points)):
            for c in range(len(columns)):
                state[:, p, c] = rows.column(f"s{p}_{c}").to_numpy(zero_copy_only=False).astype(float)
        starts = np.nonzero(np.r_[True, entity[1:] != entity[:-1]])[0]
        degree = np.diff(np.r_[starts, len(ids)])
        for d in np.unique(degree[degree > 1]):
            heads, same = min(int(d), k + 1), starts[degree == d]
            step = max(1, CELLS // (int(d) * heads))
            for i in range(0, len(same), step):
                index = same[i : i + step, None] + np.arange(d)[None, :]
                mask = _masks(np.arange(d), n[index], heads)
                if linked:
                    for e, own in enumerate(index):
                        if linked.intersection(own.tolist()):
                            _with_twins(mask[e], ids[own].tolist(), n[own], [twins[int(x)].as_py() for x in own])
                out, given = (index[:, :heads], index) if incoming else (index, index[:, :heads])
                mask = mask.transpose(0, 2, 1) if incoming else mask
                for p, point in enumerate(points):
                    yield from summed(mask, state[given, p], ids[out], w[out], point)

    def summed(mask: np.ndarray, s: np.ndarray, ids: np.ndarray, w: np.ndarray, point) -> Iterator[pa.RecordBatch]:
        there = mask & ~np.isnan(s[:, None, :, 0])
        count = there.sum(axis=2)
        some = count > 0
        if not some.any():
            return
        weights, values = there.astype(float), np.nan_to_num(s)
        total, positive = weights @ values, weights @ (values > 0).astype(float)
        arrays, names = [pa.array(ids[some]), pa.array(np.full(int(some.sum()), point)), pa.array(count[some]), pa.array(w[some])], ["unit_id", "point", "n", "w"]
        for c, i in at.items():
            most = np.where(there, values[:, None, :, i], -np.inf).max(axis=2)
            arrays += [pa.array(total[..., i][some]), pa.array(most[some]), pa.array(positive[..., i][some].astype(np.int64))]
            names += [f"{c}_sum", f"{c}_max", f"{c}_any"]
        for c in tops:
            all_ = np.where(there, values[:, None, :, at[c]], -np.inf)[some]
            width = min(10, all_.shape[1])
            best = -np.sort(-(all_ if all_.shape[1] <= 10 else np.partition(all_, all_.shape[1] - 10, axis=1)[:, -10:]), axis=1)
            sizes = np.minimum(count[some], width)
            flat = best[np.arange(best.shape[1])[None, :] < sizes[:, None]]
            arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat)))
            names.append(f"{c}_top")
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column("entity_id")[batch.num_rows - 1]
            names = batch.column("entity_id").to_numpy(zero_copy_only=False)
            cut = int(np.nonzero(names != last.as_py())[0][-1]) + 1 if (names != last.as_py()).any() else 0
            if held and (cut or held[-1].column("entity_id")[held[-1].num_rows - 1] != last):
                yield from entity_groups(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            elif cut:
                yield from entity_groups(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from entity_groups(pa.Table.from_batches(held).combine_chunks())

    return run


def pooled(units: DataFrame, state: DataFrame, points: list, columns: list[str], bounds: tuple[int, int, int], by: str = "cutoff", tops: list[str] | None = None, incoming: bool = False) -> DataFrame:
    """What the neighbours of each unit have in `state` (unit_id, by, columns without nulls, one row for a unit and point), by unit and point: n, weight, shared (sum), shared_max, and for each
    column its sum, max, weighted sum, how many are over 0 and, for `tops`, the ten largest. Edges are those of top_edges(units, *bounds); neighbours without a state aren't counted.

    points: the few values of `by`. incoming: a unit's neighbours are those whose edges lead to it.
    """
    low, high, k = bounds
    tops, reach = tops or [], reaches(units, low, high, k)
    flat = state.groupBy("unit_id").agg(*(F.max(F.when(F.col(by) == p, F.col(c).cast("double"))).alias(f"s{i}_{j}") for i, p in enumerate(points) for j, c in enumerate(columns)))
    names = [f"s{i}_{j}" for i in range(len(points)) for j in range(len(columns))]
    rows = _taking(reach.join(flat, "unit_id", "left"), *names)
    rows = rows.repartition("entity_id").sortWithinPartitions("entity_id", "unit_id")
    kind = state.schema[by].dataType.simpleString()
    each = ", ".join(f"{c}_sum double, {c}_max double, {c}_any long" for c in columns)
    schema = f"unit_id string, point {'long' if kind in ('int', 'bigint') else kind}, n long, w double, {each}" + "".join(f", {c}_top array<double>" for c in tops)
    parts = rows.mapInArrow(_sums(points, columns, tops, k, incoming), schema)
    parts = parts.withColumns({"shared": F.col("n"), "shared_max": F.lit(1).cast("long")})
    twins = _twin_edges(reach)
    if not twins.isEmpty():
        parts = parts.unionByName(_twin_sums(twins, state, columns, tops, by, parts.schema["point"].dataType, incoming))
    aggs = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("w")).alias("weight"), F.sum("shared").alias("shared"), F.max("shared_max").alias("shared_max")]
    for c in columns:
        aggs += [F.sum(f"{c}_sum").alias(f"{c}_sum"), F.max(f"{c}_max").alias(f"{c}_max"), F.sum(F.col("w") * F.col(f"{c}_sum")).alias(f"{c}_weighted"), F.sum(f"{c}_any").alias(f"{c}_any")]
    aggs += [F.slice(F.sort_array(F.flatten(F.collect_list(f"{c}_top")), False), 1, 10).alias(f"{c}_top") for c in tops]
    out = parts.groupBy("unit_id", "point").agg(*aggs)
    return out.withColumn(by, F.col("point").cast(state.schema[by].dataType)).drop("point")


def _twin_sums(twins: DataFrame, state: DataFrame, columns: list[str], tops: list[str], by: str, kind, incoming: bool) -> DataFrame:
    """The partial sums of single edges between twins."""
    me, other = ("dst", "src") if incoming else ("src", "dst")
    twins = twins.join(state.withColumnRenamed("unit_id", other), other)
    value = lambda c: F.col(c).cast("double")
    return twins.select(
        F.col(me).alias("unit_id"), F.col(by).cast(kind).alias("point"), F.lit(1).cast("long").alias("n"), F.col("edge_weight").alias("w"),
        *(x for c in columns for x in (value(c).alias(f"{c}_sum"), value(c).alias(f"{c}_max"), (F.col(c) > 0).cast("long").alias(f"{c}_any"))),
        *(F.array(value(c)).alias(f"{c}_top") for c in tops), "shared", F.col("shared").alias("shared_max"),
    )


def neighbour_state(sums: DataFrame, state: DataFrame, columns: list[str], by: str = "cutoff") -> DataFrame:
    """forecast.neighbour_state from pooled sums: mean, largest, sum and weighted mean of the neighbours' state."""
    out = [F.col("n").alias("neighbours"), F.round("weight", 6).alias("weight_sum")]
    for c in columns:
        kind = state.schema[c].dataType
        out += [F.round(F.col(f"{c}_sum") / F.col("n"), 6).alias(f"{c}_mean"), F.col(f"{c}_max").cast(kind).alias(f"{c}_max"), F.col(f"{c}_sum").cast("double" if kind.simpleString() in ("double", "float") else "long").alias(f"{c}_sum")]
        out.append(F.round(F.col(f"{c}_weighted") / F.col("weight"), 6).alias(f"{c}_wmean"))
    return sums.select("unit_id", by, *out)


def flux(sums: DataFrame, state: DataFrame, column: str) -> DataFrame:
    """graph.flux from sums over the edges that lead to each unit: the weighted mean of (u_src - u_dst)."""
    own = state.select("unit_id", F.col(column).alias("own"))
    return sums.join(own, "unit_id").select(F.col("unit_id").alias("node"), F.round((F.col(f"{column}_weighted") - F.col("weight") * F.col("own")) / F.col("weight"), 6).alias("flux"))


def neighbour_mean(sums: DataFrame, state: DataFrame, column: str) -> DataFrame:
    """graph.neighbour_mean with self loops from sums over the edges that lead to each unit."""
    both = sums.join(state.select("unit_id", F.col(column).alias("own")), "unit_id", "full_outer")
    zero, one = F.lit(0.0), F.when(F.col("own").isNull(), 0.0).otherwise(1.0)
    value = (F.coalesce(f"{column}_weighted", zero) + F.coalesce("own", zero)) / (F.coalesce("weight", zero) + one)
    return both.select(F.col("unit_id").alias("node"), F.round(value, 6).alias("mean"))
