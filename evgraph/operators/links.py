"""Link prediction: positives, splits, negatives, overlap features, vector scores."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evgraph.functions import expr
from evgraph.operators import first_pairs, first_pairs_jvm
from evgraph.operators.graph import written


def hash_order(*cs: Column, seed: int = 42) -> Column:
    """A pseudo-random order of rows that depends on the columns and the seed alone."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in cs)))


def split_by_rank(pairs: DataFrame, keys: list[str], train: float = 0.8, validation: float = 0.1, seed: int = 42, cells: int = 256) -> DataFrame:
    """Exact shares of the rows in hash order: train, validation and the rest as test.

    Rows are ranked within cells of hash space, and cells are offset by the counts before them, so no window spans the table.
    """
    h = pairs.withColumn("h", hash_order(*(F.col(k) for k in keys), seed=seed)).withColumn("cell", F.substring("h", 1, 2))
    sizes = h.groupBy("cell").agg(F.count("*").alias("n"))  # at most 256 rows
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("cell", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("h", *keys)) - 1
    r = h.withColumn("place", place).join(F.broadcast(offsets), "cell").withColumn("at", F.col("base") + F.col("place"))
    n_train, n_val = F.floor(F.col("total") * train), F.floor(F.col("total") * validation)
    split = F.when(F.col("at") < n_train, "train").when(F.col("at") < n_train + n_val, "validation").otherwise("test")
    return r.withColumn("split", split).select(*keys, "split")


def _dealt(ids: DataFrame, column: str, n: int, size: int) -> DataFrame:
    """n ids in lists of about `size` of id and text."""
    cell = F.pmod(F.xxhash64(column), F.lit(max(1, -(-n // size)))).alias("cell")
    return ids.groupBy(cell).agg(F.collect_list(F.struct(F.col(column).alias("id"), F.col(column).cast("string").alias("text"))).alias(f"{column}s")).drop("cell")


def negatives(sources: DataFrame, targets: DataFrame, positives: DataFrame, per_split: DataFrame, seed: int = 43, small: int = 5_000_000, block: int = 1 << 26, wide: int = 1 << 15, arrow: bool = False) -> DataFrame:
    """Pairs that aren't positive, as many for each split as per_split (split, n) says: the first ones of the whole space in hash order.

    Beyond `small` candidate pairs, lists of sources meet lists of targets (up to `wide`, about `block` pairs), and tasks hash all their pairs but make rows only of those under a
    bound of the hash: within the JVM, or in numpy where the session doesn't take the function or `arrow` is set. The bound is set by the pairs needed and raised until there are enough, so the rows are the same at any size. They are ranked within cells of hash
    space that are offset by the counts before them. Fewer rows come back only if the space has fewer.
    """
    s, t = sources.select("source"), targets.select("target")
    n_s, n_t = s.count(), t.count()
    pairs, need = n_s * n_t, per_split.agg(F.sum("n")).first()[0] or 0
    known = positives.select("source", "target").distinct()
    least = s.sparkSession.sparkContext.defaultParallelism
    share = 1.0 if pairs <= small else min(1.0, (need + 6 * need**0.5 + 100) / max(1, pairs - known.count()))
    many = max(1, min(block // max(1, min(n_t, wide)), n_s // (4 * least)))
    name = None if arrow or share == 1.0 else first_pairs_jvm.function(s.sparkSession)
    while True:
        bound = int(share * (1 << 52))
        if share == 1.0:
            space = s.repartition(max(least, -(-pairs // 1_000_000))).crossJoin(t)
        else:
            met = _dealt(s, "source", n_s, many).repartition(max(least, pairs // (16 * block))).crossJoin(_dealt(t, "target", n_t, wide))
            if name is None:
                space = met.mapInArrow(partial(first_pairs.below, seed=seed, bound=bound >> 20), s.join(t).schema)
            else:
                space = met.select(F.explode(first_pairs_jvm.below(name, "sources", "targets", seed, bound >> 20)).alias("pair")).select("pair.*")
        space = space.withColumn("h", hash_order(F.col("source"), F.col("target"), seed=seed))
        below = space if share == 1.0 else space.filter(F.col("h") < f"{bound:013x}")
        free = written(below.join(known, ["source", "target"], "left_anti"), "negatives")
        if share == 1.0 or free.count() >= need:
            break
        share = min(1.0, 2 * share)
    digits = next(k for k in range(1, 14) if 16**k * share >= max(256, need / 100_000))
    free = free.withColumn("cell", F.substring("h", 1, digits))
    sizes = free.groupBy("cell").agg(F.count("*").alias("size"))  # at most 16 times the cells asked for
    base = F.coalesce(F.sum("size").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("h", "source", "target"))
    offsets = sizes.select("cell", base.alias("base")).filter(F.col("base") < need)
    top = free.join(F.broadcast(offsets), "cell").withColumn("at", F.col("base") + place)
    bounds = per_split.withColumn("high", F.sum("n").over(Window.orderBy("split"))).withColumn("low", F.col("high") - F.col("n"))
    return top.join(F.broadcast(bounds), (F.col("at") > F.col("low")) & (F.col("at") <= F.col("high"))).select("source", "target", "split")


def overlap(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Shared entities of each pair's sides, with union, Jaccard, weighted minimum, weighted Jaccard and cosine.

    left: source, entity, w; right: target, entity, w. A source's entities carry the hashes of its targets to where the targets' entities lie, so that what is shuffled is a row
    for each entity of a source, and not for each of its pairs. Repeated pairs get equal figures.
    """
    ls = left.groupBy("source").agg(F.count("*").alias("ln"), F.sum("w").alias("lw"), F.sum(F.col("w") * F.col("w")).alias("lq"))
    rs = right.groupBy("target").agg(F.count("*").alias("rn"), F.sum("w").alias("rw"), F.sum(F.col("w") * F.col("w")).alias("rq"))
    wanted = pairs.select("source", "target").distinct().groupBy("source").agg(F.collect_list(F.hash("target")).alias("wanted"))
    met = left.join(wanted, "source").join(right.select("target", "entity", F.col("w").alias("v")), "entity")
    # a target whose hash only looks wanted makes a pair that no row of pairs takes up below
    both = met.filter(F.array_contains("wanted", F.hash("target")))
    shared = both.groupBy("source", "target").agg(F.count("*").alias("shared"), F.sum(F.least("w", "v")).alias("wmin"), F.sum(F.col("w") * F.col("v")).alias("wdot"))
    out = pairs.join(shared, ["source", "target"], "left").join(ls, "source", "left").join(rs, "target", "left").fillna(0, ["shared", "wmin", "wdot", "ln", "rn", "lw", "rw", "lq", "rq"])
    union = F.col("ln") + F.col("rn") - F.col("shared")
    safe = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0)), 6)
    return out.select(
        *pairs.columns, "shared", union.alias("union_size"), safe(F.col("shared"), union.cast("double")).alias("jaccard"), "wmin",
        safe(F.col("wmin"), F.col("lw") + F.col("rw") - F.col("wmin")).alias("weighted_jaccard"), safe(F.col("wdot"), F.sqrt(F.col("lq") * F.col("rq"))).alias("cosine"),
        (F.col("ln") * F.col("rn")).alias("degree_product"),
    )


def vector_scores(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Dot product, cosine, negative Euclidean and negative Manhattan distance of two vector columns."""
    x, y = F.col(a), F.col(b)
    d = F.zip_with(x, y, lambda p, q: p.cast("double") - q.cast("double"))
    return pairs.withColumns(
        {
            "dot": expr.dot(x, y),
            "cosine": expr.dot(x, y) / F.greatest(expr.norm(x) * expr.norm(y), F.lit(1e-12)),
            "neg_l2": -F.sqrt(expr.dot(d, d)),
            "neg_l1": -F.aggregate(d, F.lit(0.0), lambda s, v: s + F.abs(v)),
        }
    )


def pair_features(a: Column, b: Column) -> dict[str, Column]:
    """Hadamard product, absolute difference, square difference and the concatenation of both with the first two."""
    product = F.zip_with(a, b, lambda x, y: x * y)
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return {"hadamard": product, "l1": gap, "l2": F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), "concat": F.concat(a, b, gap, product)}


def fingerprint(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Row count and a digest of each group that doesn't depend on row order: xor and sum of 60 bits of each row's SHA-256."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.bit_xor(h).alias("digest_xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest_sum"))
