"""Link prediction between customers and suppliers, and scores of vector pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evgraph.functions import expr
from evgraph.operators import evaluation, links
from evgraph.operators.graph import written
from evgraph.plans.bindings import sql, table


def positives(s, d):
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return j.select(F.col("o_custkey").cast("string").alias("source"), F.col("l_suppkey").cast("string").alias("target")).distinct()


def ends(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("source")), table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("target"))


def split(s, d):
    return links.split_by_rank(positives(s, d), ["source", "target"])


def labeled(s, d):
    p = written(split(s, d), "positives")
    a, b = ends(s, d)
    n = links.negatives(a, b, p, p.groupBy("split").agg(F.count("*").alias("n")))
    return p.withColumn("label", F.lit(1)).unionByName(n.withColumn("label", F.lit(0)))


def split_summary(s, d):
    return labeled(s, d).groupBy("split", "label").agg(F.count("*").alias("pairs"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))


def candidate_space(s, d):
    a, b = ends(s, d)
    return a.agg(F.count("*").alias("sources")).join(b.agg(F.count("*").alias("targets")), how="full").join(positives(s, d).agg(F.count("*").alias("positives")), how="full").withColumn("candidates", F.col("sources") * F.col("targets"))


def _sides(s, d):
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    left = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_custkey").cast("string").alias("source"), F.col("l_partkey").alias("entity")).agg(F.count("*").cast("double").alias("w"))
    right = li.groupBy(F.col("l_suppkey").cast("string").alias("target"), F.col("l_partkey").alias("entity")).agg(F.count("*").cast("double").alias("w"))
    return left, right


def overlap(s, d):
    return links.overlap(positives(s, d), *_sides(s, d))


def random_baseline(s, d):
    x = labeled(s, d).withColumn("score", F.round(expr.unit_interval(F.col("source"), F.col("target"), seed=7), 9))
    return evaluation.areas(x, ["split"], spread=(0.0, 1.0))


def fingerprints(s, d):
    return links.fingerprint(labeled(s, d), ["split"], ["source", "target", "label"])


def vector_pairs(s, d):
    v = table(s, d, "embeddings")
    a = v.select(F.col("vec_id").alias("ia"), "label", F.col("embedding").alias("a"))
    b = v.select((F.col("vec_id") - 1).alias("ia"), F.col("label").alias("other"), F.col("embedding").alias("b"))
    return a.join(b, "ia").withColumn("same", (F.col("label") == F.col("other")).cast("int"))


def vector_scores(s, d):
    return links.vector_scores(vector_pairs(s, d)).select("ia", "same", *(F.round(c, 6).alias(c) for c in ("dot", "cosine", "neg_l2", "neg_l1")))


def pair_features(s, d):
    f = links.pair_features(F.col("a"), F.col("b"))
    x = vector_pairs(s, d).withColumns(f)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double")), 4)
    return x.select("ia", F.size("concat").cast("bigint").alias("width"), total("hadamard").alias("hadamard"), total("l1").alias("l1"), total("l2").alias("l2"), total("concat").alias("concat"))


def matrix_summary(s, d):
    v = table(s, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"))
    e = v.select(F.explode("x").alias("v")).agg(F.round(F.min("v"), 6).alias("least"), F.round(F.max("v"), 6).alias("most"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))
    n = v.select(expr.norm(F.col("x")).alias("n")).agg(F.count("*").alias("rows"), F.round(F.min("n"), 5).alias("norm_least"), F.round(F.max("n"), 5).alias("norm_most"), F.round(F.avg("n"), 5).alias("norm_mean"))
    return e.join(n, how="full")


def corrupted_triples(s, d):
    """Two corruptions of each (part, supplier) triple: head or tail by hash, replaced from the same type."""
    t = table(s, d, "lineitem").select(F.col("l_partkey").alias("head"), F.col("l_suppkey").alias("tail")).distinct()
    n = table(s, d, "part").agg(F.count("*").alias("parts")).join(table(s, d, "supplier").agg(F.count("*").alias("suppliers")), how="full")
    u = lambda k: expr.unit_interval(F.col("head"), F.col("tail"), F.col("i"), seed=k)
    x = t.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(2)))).join(F.broadcast(n), F.lit(True), "left")
    side = u(1) < 0.5
    new_head, new_tail = F.floor(u(2) * F.col("parts")), F.floor(u(2) * F.col("suppliers"))
    return x.select("i", F.when(side, "head").otherwise("tail").alias("side"), F.when(side, new_head).otherwise(F.col("head")).alias("new_head"), F.when(side, F.col("tail")).otherwise(new_tail).alias("new_tail")).groupBy("side", "i").agg(
        F.count("*").alias("rows"), F.count_distinct("new_head").alias("heads"), F.count_distinct("new_tail").alias("tails"), F.sum("new_head").alias("head_sum")
    )


LINKS = """positives AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS source, CAST(l_suppkey AS VARCHAR) AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ordered AS (SELECT source, target, row_number() OVER (ORDER BY md5('42|' || source || '|' || target), source, target) - 1 AS pos, count(*) OVER () AS n FROM positives),
split AS (SELECT source, target, CASE WHEN pos < floor(n * 0.8) THEN 'train' WHEN pos < floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM ordered),
sizes AS (SELECT split, count(*) AS n FROM split GROUP BY split),
bounds AS (SELECT split, sum(n) OVER (ORDER BY split) AS high, sum(n) OVER (ORDER BY split) - n AS low FROM sizes),
space AS (SELECT CAST(c_custkey AS VARCHAR) AS source, CAST(s_suppkey AS VARCHAR) AS target FROM customer CROSS JOIN supplier),
free AS (SELECT source, target, row_number() OVER (ORDER BY md5('43|' || source || '|' || target), source, target) AS pos FROM space ANTI JOIN positives USING (source, target)),
labeled AS (SELECT source, target, split, 1 AS label FROM split UNION ALL SELECT source, target, split, 0 FROM free JOIN bounds ON pos > low AND pos <= high)"""
SIDES = """ls AS (SELECT CAST(o_custkey AS VARCHAR) AS source, l_partkey AS entity, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
rs AS (SELECT CAST(l_suppkey AS VARCHAR) AS target, l_partkey AS entity, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY ALL),
lt AS (SELECT source, count(*) AS n, sum(w) AS w, sum(w * w) AS q FROM ls GROUP BY source), rt AS (SELECT target, count(*) AS n, sum(w) AS w, sum(w * w) AS q FROM rs GROUP BY target),
both_sides AS (SELECT source, target, count(*) AS shared, sum(least(ls.w, rs.w)) AS wmin, sum(ls.w * rs.w) AS wdot FROM positives JOIN ls USING (source) JOIN rs USING (target, entity) GROUP BY ALL)"""
PAIRS = "pairs AS (SELECT a.vec_id AS ia, CAST(a.label = b.label AS INTEGER) AS same, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _curve(rows, by):
    from evgraph.plans.metric_plans import curve

    return curve(rows, by)


ORACLES = {
    "link_split": (split, sql("SELECT * FROM split", LINKS)),
    "labeled_links": (labeled, sql("SELECT * FROM labeled", LINKS)),
    "link_split_summary": (split_summary, sql("SELECT split, label, count(*) AS pairs, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM labeled GROUP BY ALL", LINKS)),
    "candidate_space": (candidate_space, sql("SELECT *, sources * targets AS candidates FROM (SELECT (SELECT count(*) FROM customer) AS sources, (SELECT count(*) FROM supplier) AS targets, (SELECT count(*) FROM positives) AS positives)", LINKS)),
    "link_overlap": (
        overlap,
        sql(
            """SELECT source, target, coalesce(shared, 0) AS shared, lt.n + rt.n - coalesce(shared, 0) AS union_size, round(coalesce(coalesce(shared, 0) / nullif(lt.n + rt.n - coalesce(shared, 0), 0), 0), 6) AS jaccard, coalesce(wmin, 0) AS wmin,
            round(coalesce(coalesce(wmin, 0) / nullif(lt.w + rt.w - coalesce(wmin, 0), 0), 0), 6) AS weighted_jaccard, round(coalesce(coalesce(wdot, 0) / nullif(sqrt(lt.q * rt.q), 0), 0), 6) AS cosine, lt.n * rt.n AS degree_product
            FROM positives LEFT JOIN both_sides USING (source, target) LEFT JOIN lt USING (source) LEFT JOIN rt USING (target)""",
            LINKS + ", " + SIDES,
        ),
    ),
    "random_link_scores": (random_baseline, sql(_curve("SELECT split, label, round(CAST(CAST('0x' || substr(md5('7|' || source || '|' || target), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496, 9) AS score FROM labeled", "split"), LINKS)),
    "vector_scores": (
        vector_scores,
        f"WITH {PAIRS} SELECT ia, same, round(list_dot_product(a, b), 6) AS dot, round(list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 1e-12), 6) AS cosine, round(-list_distance(a, b), 6) AS neg_l2, round(-list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))), 6) AS neg_l1 FROM pairs",
    ),
    "embedding_summary": (
        matrix_summary,
        """SELECT * FROM (SELECT round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings)),
        (SELECT count(*) AS rows, round(min(n), 5) AS norm_least, round(max(n), 5) AS norm_most, round(avg(n), 5) AS norm_mean FROM (SELECT sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings))""",
    ),
    "split_fingerprint": (
        fingerprints,
        sql("SELECT split, count(*) AS rows, bit_xor(h) AS digest_xor, CAST(sum(h) AS VARCHAR) AS digest_sum FROM (SELECT split, CAST('0x' || substr(sha256(source || '|' || target || '|' || label), 1, 15) AS BIGINT) AS h FROM labeled) GROUP BY split", LINKS),
    ),
    "pair_features": (
        pair_features,
        """SELECT ia, CAST(2 * len(a) + len(h) + len(g) AS BIGINT) AS width, round(list_sum(h), 4) AS hadamard, round(list_sum(g), 4) AS l1, round(list_sum(q), 4) AS l2, round(list_sum(CAST(a AS DOUBLE[])) + list_sum(CAST(b AS DOUBLE[])) + list_sum(g) + list_sum(h), 4) AS concat
        FROM (SELECT ia, a, b, list_transform(range(1, 65), lambda i: CAST(a[i] * b[i] AS DOUBLE)) AS h, list_transform(range(1, 65), lambda i: CAST(abs(a[i] - b[i]) AS DOUBLE)) AS g, list_transform(range(1, 65), lambda i: CAST((a[i] - b[i]) * (a[i] - b[i]) AS DOUBLE)) AS q
        FROM (SELECT x.vec_id AS ia, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1))""",
    ),
    "corrupted_triples": (
        corrupted_triples,
        """SELECT CASE WHEN u1 < 0.5 THEN 'head' ELSE 'tail' END AS side, CAST(i AS INTEGER) AS i, count(*) AS rows, count(DISTINCT new_head) AS heads, count(DISTINCT new_tail) AS tails, CAST(sum(new_head) AS BIGINT) AS head_sum FROM (
        SELECT i, u1, CASE WHEN u1 < 0.5 THEN CAST(floor(u2 * parts) AS BIGINT) ELSE head END AS new_head, CASE WHEN u1 < 0.5 THEN tail ELSE CAST(floor(u2 * suppliers) AS BIGINT) END AS new_tail FROM (
        SELECT *, CAST(CAST('0x' || substr(md5('1|' || head || '|' || tail || '|' || i), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u1, CAST(CAST('0x' || substr(md5('2|' || head || '|' || tail || '|' || i), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u2
        FROM (SELECT DISTINCT l_partkey AS head, l_suppkey AS tail FROM lineitem) CROSS JOIN range(1, 3) r(i) CROSS JOIN (SELECT count(*) AS parts FROM part) CROSS JOIN (SELECT count(*) AS suppliers FROM supplier))) GROUP BY ALL""",
    ),
}
