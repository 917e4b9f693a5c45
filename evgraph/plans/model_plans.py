"""Models of forecasts and of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from evgraph.operators import links, metrics, models
from evgraph.operators.graph import written
from evgraph.plans import link_plans, unit_plans
from evgraph.plans.bindings import sql, table

NUMERIC = ["history_total", "recent_3", "recent_5", "previous_3", "active_years", "history_base", "age", "idle"]


def rows(s, d):
    """Eligible examples with their features, written once: fits and scores read them many times."""
    x = models.feature_matrix(unit_plans.typed_examples(s, d).filter("eligible_follow_up"), NUMERIC).withColumn("label", F.col("label_follow_up").cast("double")).withColumn("heat", F.greatest("heat_patent", "heat_trial"))
    return written(x, "model-rows")


def _classifier(kind, **params):
    def query(s, d):
        x = rows(s, d)
        train = models.balanced(x.filter("split = 'train'"), "label")
        model = models.fit(train, kind, NUMERIC, ["pair_type"], "label", "weight", **params)
        out = models.score(model, x.filter("split <> 'train'"), ["split", "unit_id", "label"])
        return metrics.classification(out.withColumn("label", F.col("label").cast("int")).withColumn("score", F.round("score", 6)), ["split"])

    return query


def heat_regression(s, d):
    x = rows(s, d)
    model = models.fit(x.filter("split = 'train'"), "linear_regression", NUMERIC, ["pair_type"], "heat", elasticNetParam=0.5, regParam=0.01)
    return metrics.regression(models.score(model, x.filter("split <> 'train'"), ["split", "heat"]), ["split"])


def coefficients(s, d):
    x = rows(s, d)
    model = models.fit(x.filter("split = 'train'"), "logistic", NUMERIC, ["pair_type"], "label", regParam=0.01)
    return models.coefficients(model, x)


def feature_subsets(s, d):
    """Metrics of models on several feature subsets."""
    x, out = rows(s, d), None
    for name in ("numeric_only", "raw_counts_only", "schema_only"):
        cols = models.select_features([*NUMERIC, "pair_type", "label_follow_up", "future_total"], name)
        numeric = [c for c in cols if c != "pair_type"]
        model = models.fit(x.filter("split = 'train'"), "logistic", numeric, [c for c in cols if c == "pair_type"], "label", regParam=0.01)
        m = metrics.classification(models.score(model, x.filter("split = 'test'"), ["split", "label"]).withColumn("label", F.col("label").cast("int")), ["split"]).withColumn("subset", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def pair_classifier(s, d):
    """Whether two vectors have one label, from the absolute difference and product of their components."""
    v = link_plans.vector_pairs(s, d).withColumns(links.pair_features(F.col("a"), F.col("b"))).withColumn("label", F.col("same").cast("double"))
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = v.withColumn("features", array_to_vector(F.col("concat"))).withColumn("split", F.when(F.pmod(F.xxhash64("ia"), F.lit(5)) == 0, "test").otherwise("train"))
    model = LogisticRegression(regParam=0.1, maxIter=50).fit(x.filter("split = 'train'"))
    from pyspark.ml.functions import vector_to_array

    return metrics.classification(model.transform(x).select("split", F.col("same").alias("label"), F.round(vector_to_array("probability")[1], 9).alias("score")), ["split"])


def stratified_sample(s, d):
    x = rows(s, d)
    return models.stratified_sample(x.select("unit_id", "cutoff", "label"), "label", ["unit_id", "cutoff"], 5000).groupBy("label").agg(F.count("*").alias("n"))


def mean_baseline(s, d):
    x = rows(s, d)
    out = models.mean_baseline(x.filter("split = 'train'"), x.filter("split <> 'train'"), "label", "heat")
    return out.groupBy("split").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("score"), F.round(F.max("predicted_heat"), 6).alias("heat"))


def calibrated_heuristic(s, d):
    x = table(s, d, "labels").join(table(s, d, "documents"), "doc_id").withColumn("n", F.col("n_chars").cast("double")).withColumn("train", F.col("doc_id") % 4 != 2)
    out = models.percentile_calibration(x.filter("train"), x.filter("not train"), "n", "quality", 20)
    return out.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.max("calibrated"), 6).alias("calibrated"), F.sum("quality").alias("good"))


def prediction_frame(s, d):
    x = rows(s, d)
    return x.filter("split = 'test'").select("unit_id", "cutoff", F.col("label").cast("int").alias("label"), "heat", F.round(F.log1p("recent_3"), 6).alias("score"))


ROWS = unit_plans.EXAMPLES + ", model_rows AS (SELECT *, CAST(label_follow_up AS DOUBLE) AS label, greatest(heat_patent, heat_trial) AS heat FROM examples WHERE eligible_follow_up)"
ORACLES = {
    "mean_baseline": (
        mean_baseline,
        sql("SELECT split, count(*) AS n, round(max(p), 6) AS score, round(max(h), 6) AS heat FROM model_rows, (SELECT avg(label) AS p, avg(heat) AS h FROM model_rows WHERE split = 'train') GROUP BY split HAVING split <> 'train'", ROWS),
    ),
    "stratified_sample": (
        stratified_sample,
        sql("SELECT label, CAST(ceil(count(*) * any_value(share)) AS BIGINT) AS n FROM model_rows, (SELECT least(1.0, 5000.0 / count(*)) AS share FROM model_rows) GROUP BY label", ROWS),
    ),
    "calibrated_heuristic": (
        calibrated_heuristic,
        """WITH x AS (SELECT d.doc_id, CAST(n_chars AS DOUBLE) AS n, quality, d.doc_id % 4 <> 2 AS train FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
        e AS (SELECT list_distinct(quantile_cont(n, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])) AS edges FROM x WHERE train),
        b AS (SELECT x.*, CAST(len(list_filter(edges, lambda v: v < n)) AS INTEGER) AS bin FROM x, e), m AS (SELECT bin, avg(quality) AS c FROM b WHERE train GROUP BY bin)
        SELECT b.bin, count(*) AS n, round(max(coalesce(m.c, (SELECT avg(quality) FROM x WHERE train))), 6) AS calibrated, CAST(sum(quality) AS BIGINT) AS good FROM b LEFT JOIN m ON b.bin = m.bin WHERE NOT train GROUP BY b.bin""",
    ),
    "prediction_frame": (prediction_frame, sql("SELECT unit_id, cutoff, label_follow_up AS label, heat, round(ln(1 + recent_3), 6) AS score FROM model_rows WHERE split = 'test'", ROWS)),
}
ROWS_ONLY = {
    "logistic_forecast": _classifier("logistic", regParam=0.01), "forest_forecast": _classifier("forest", numTrees=20, maxDepth=5, seed=1), "boosting_forecast": _classifier("boosting", maxIter=10, maxDepth=3, seed=1),
    "heat_regression": heat_regression, "model_coefficients": coefficients, "feature_subsets": feature_subsets, "vector_pair_classifier": pair_classifier,
}
