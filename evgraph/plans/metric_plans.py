"""Evaluation of scores: forecasts by history, and quality labels by text length."""

from __future__ import annotations

from pyspark.sql import functions as F

from evgraph.functions import expr
from evgraph.operators import metrics
from evgraph.operators.graph import written
from evgraph.plans import unit_plans
from evgraph.plans.bindings import sql, table

BY = ["split"]


def scored(s, d):
    """Eligible forecasts with a heuristic score: recent activity, with the units as tie-break. Written once, as metrics read them several times."""
    x = unit_plans._examples(s, d).filter("eligible_follow_up")
    x = x.select("unit_id", "split", "cutoff", "history_total", "recent_3", F.col("label_follow_up").alias("label"), F.round(F.log1p("recent_3") + F.log1p("history_total") * 0.25, 6).alias("score"), F.greatest("heat_patent", "heat_trial").alias("heat"))
    return written(x, "scored")


def classification(s, d):
    return metrics.classification(scored(s, d), BY)


def at_k(s, d):
    return metrics.at_k(metrics.ranked(scored(s, d), BY, "unit_id"), BY, [10, 100, 1000, 1000000])


def graded_ndcg(s, d):
    return metrics.graded_ndcg(scored(s, d), BY, 1000, "unit_id")


def reciprocal_rank(s, d):
    return metrics.reciprocal_rank(metrics.ranked(scored(s, d), BY, "unit_id"), BY)


def thresholded(s, d):
    return metrics.thresholded(scored(s, d), BY, 1.2)


def regression(s, d):
    return metrics.regression(scored(s, d), BY)


def stratified(s, d):
    rows = metrics.strata(scored(s, d), {"activity": expr.bucket(F.col("history_total"), [1, 2, 3], ["none", "one", "two", "more"]), "recent": expr.bucket(F.col("recent_3"), [1, 2], ["idle", "some", "many"])})
    return metrics.classification(rows, ["split", "stratification", "stratum"])


def slices(s, d):
    names = F.array_compact(F.array(F.when(F.col("split") == "validation", "validation"), F.when(F.col("cutoff") >= 1997, "late"), F.concat(F.lit("cutoff_"), F.col("cutoff").cast("string"))))
    return metrics.classification(scored(s, d).withColumn("slice", F.explode(names)), ["slice"])


def composition(s, d):
    rows = scored(s, d).withColumn("stratum", expr.bucket(F.col("history_total"), [1, 2, 3], ["none", "one", "two", "more"]))
    return metrics.top_composition(metrics.ranked(rows, BY, "unit_id"), ["split", "stratum"], 500)


def score_distribution(s, d):
    q = F.expr("percentile(score, array(0.25, 0.5, 0.75))")
    out = scored(s, d).groupBy("split", "label").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.avg("score"), 6).alias("mean"), q.alias("q"))
    return out.select("split", "label", "n", "least", "most", "mean", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))))


def rollup(s, d):
    """Macro and weighted mean of a metric over cutoffs, with spread."""
    m = metrics.classification(scored(s, d), ["cutoff"])
    return m.agg(F.round(F.avg("auroc"), 6).alias("macro"), F.round(F.sum(F.col("auroc") * F.col("rows")) / F.sum("rows"), 5).alias("weighted"), F.round(F.stddev_samp("auroc"), 5).alias("spread"), F.max("auroc").alias("most"), F.count("*").alias("cutoffs"))


def run_comparison(s, d):
    """Several heuristics over the same rows, ranked within each split."""
    x = scored(s, d)
    runs = {"recent": F.col("recent_3").cast("double"), "history": F.col("history_total").cast("double"), "mixed": F.col("score")}
    rows = x.withColumn("r", F.explode(F.array(*(F.struct(F.lit(k).alias("run"), c.alias("score")) for k, c in runs.items())))).select("split", "label", "r.run", "r.score")
    from pyspark.sql import Window

    m = metrics.classification(rows, ["split", "run"])
    return m.withColumn("place", F.row_number().over(Window.partitionBy("split").orderBy(F.desc("auroc"), "run")))


def quality_by_length(s, d):
    """Labels of documents against their length as score."""
    x = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score")), "doc_id").withColumn("label", F.col("quality").cast("int"))
    return metrics.classification(x, ["lang"])


def rank_of_predictions(s, d):
    return metrics.ranked(scored(s, d), BY, "unit_id").filter(F.col("rank") <= 20).select("split", "unit_id", "score", F.col("rank").cast("bigint").alias("rank"))


def binned(s, d):
    return metrics.binned(scored(s, d), BY, 64)


SCORED = unit_plans.EXAMPLES + """, scored AS (
  SELECT unit_id, split, cutoff, history_total, recent_3, label_follow_up AS label, round(ln(1 + recent_3) + ln(1 + history_total) * 0.25, 6) AS score, greatest(heat_patent, heat_trial) AS heat FROM examples WHERE eligible_follow_up)"""


def curve(rows: str, by: str) -> str:
    """AUROC and average precision by joining counts of distinct scores with those above them."""
    return f"""SELECT {by}, max(all_n) AS rows, max(all_p) AS positives, round(sum((n - p) * (cp - p) + 0.5 * (n - p) * p) / nullif(max(all_p) * (max(all_n) - max(all_p)), 0), 6) AS auroc, round(sum(p * cp / cn) / nullif(max(all_p), 0), 6) AS auprc
    FROM (SELECT *, CAST(sum(p) OVER w AS DOUBLE) AS cp, CAST(sum(n) OVER w AS DOUBLE) AS cn, CAST(sum(n) OVER g AS BIGINT) AS all_n, CAST(sum(p) OVER g AS BIGINT) AS all_p FROM (
      SELECT {by}, score, count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM ({rows}) GROUP BY ALL) WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY {by})) GROUP BY {by}"""


RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY score DESC, unit_id) AS rank, row_number() OVER (PARTITION BY split ORDER BY label DESC, unit_id) AS ideal_rank FROM scored)"""
ACTIVITY = "CASE WHEN history_total < 1 THEN 'none' WHEN history_total < 2 THEN 'one' WHEN history_total < 3 THEN 'two' ELSE 'more' END"
RECENT = "CASE WHEN recent_3 < 1 THEN 'idle' WHEN recent_3 < 2 THEN 'some' ELSE 'many' END"
MIDRANKS = """mid AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY score) + (count(*) OVER (PARTITION BY split, score) - 1) / 2 AS ra, rank() OVER (PARTITION BY split ORDER BY heat) + (count(*) OVER (PARTITION BY split, heat) - 1) / 2 AS rb FROM scored)"""

ORACLES = {
    "auroc_auprc": (classification, sql(curve("SELECT * FROM scored", "split"), SCORED)),
    "metrics_at_k": (
        at_k,
        sql(
            """SELECT split, CAST(k AS INTEGER) AS k, CAST(hits AS BIGINT) AS hits, round(hits / least(k, rows), 6) AS precision, round(hits / nullif(positives, 0), 6) AS recall, round(dcg / nullif(ideal, 0), 6) AS ndcg,
            round(hits / least(k, rows) / nullif(positives / rows, 0), 6) AS enrichment FROM (
            SELECT split, k, count(*) AS rows, sum(label) AS positives, sum(label) FILTER (rank <= k) AS hits, sum(label / log2(rank + 1)) FILTER (rank <= k) AS dcg, sum(label / log2(ideal_rank + 1)) FILTER (ideal_rank <= k) AS ideal
            FROM ranked CROSS JOIN (VALUES (10), (100), (1000), (1000000)) t(k) GROUP BY split, k)""",
            SCORED + ", " + RANKED,
        ),
    ),
    "graded_ndcg": (
        graded_ndcg,
        sql(
            """SELECT split, CASE WHEN max(score) > min(score) THEN round(sum(heat / log2(a + 1)) FILTER (a <= 1000) / nullif(sum(heat / log2(b + 1)) FILTER (b <= 1000), 0), 6) END AS ndcg FROM (
            SELECT *, row_number() OVER (PARTITION BY split ORDER BY score DESC, unit_id) AS a, row_number() OVER (PARTITION BY split ORDER BY heat DESC, unit_id) AS b FROM scored) GROUP BY split""",
            SCORED,
        ),
    ),
    "reciprocal_rank": (reciprocal_rank, sql("SELECT split, round(coalesce(1.0 / min(rank) FILTER (label = 1), 0.0), 6) AS mrr FROM ranked GROUP BY split", SCORED + ", " + RANKED)),
    "threshold_metrics": (
        thresholded,
        sql(
            """SELECT *, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1
            FROM (SELECT split, count(*) FILTER (score >= 1.2 AND label = 1) AS tp, count(*) FILTER (score >= 1.2 AND label = 0) AS fp, count(*) FILTER (score < 1.2 AND label = 1) AS fn, count(*) FILTER (score < 1.2 AND label = 0) AS tn FROM scored GROUP BY split)""",
            SCORED,
        ),
    ),
    "regression_metrics": (
        regression,
        sql("SELECT split, count(*) AS rows, round(avg(abs(score - heat)), 6) AS mae, round(sqrt(avg(pow(score - heat, 2))), 6) AS rmse, round(corr(score, heat), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM mid GROUP BY split", SCORED + ", " + MIDRANKS),
    ),
    "stratified_metrics": (
        stratified,
        sql(curve(f"SELECT split, 'overall' AS stratification, 'all' AS stratum, score, label FROM scored UNION ALL SELECT split, 'activity', {ACTIVITY}, score, label FROM scored UNION ALL SELECT split, 'recent', {RECENT}, score, label FROM scored", "split, stratification, stratum"), SCORED),
    ),
    "evaluation_slices": (
        slices,
        sql(curve("SELECT 'validation' AS slice, score, label FROM scored WHERE split = 'validation' UNION ALL SELECT 'late', score, label FROM scored WHERE cutoff >= 1997 UNION ALL SELECT 'cutoff_' || cutoff, score, label FROM scored", "slice"), SCORED),
    ),
    "top_composition": (
        composition,
        sql(
            f"""SELECT split, stratum, rows, positives, round(rows / sum(rows) OVER (PARTITION BY split), 6) AS share_of_top, round(positives / nullif(sum(positives) OVER (PARTITION BY split), 0), 6) AS share_of_positives, round(positives / rows, 6) AS precision
            FROM (SELECT split, {ACTIVITY} AS stratum, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives FROM ranked WHERE rank <= 500 GROUP BY ALL)""",
            SCORED + ", " + RANKED,
        ),
    ),
    "score_distribution": (
        score_distribution,
        sql("SELECT split, label, count(*) AS n, min(score) AS least, max(score) AS most, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.75), 6) AS q75 FROM scored GROUP BY ALL", SCORED),
    ),
    "metric_rollup": (
        rollup,
        sql(f"SELECT round(avg(auroc), 6) AS macro, round(sum(auroc * rows) / sum(rows), 5) AS weighted, round(stddev_samp(auroc), 5) AS spread, max(auroc) AS most, count(*) AS cutoffs FROM ({curve('SELECT * FROM scored', 'cutoff')})", SCORED),
    ),
    "run_comparison": (
        run_comparison,
        sql(
            f"""SELECT *, CAST(row_number() OVER (PARTITION BY split ORDER BY auroc DESC, run) AS INTEGER) AS place FROM ({curve("SELECT split, 'recent' AS run, CAST(recent_3 AS DOUBLE) AS score, label FROM scored UNION ALL SELECT split, 'history', CAST(history_total AS DOUBLE), label FROM scored UNION ALL SELECT split, 'mixed', score, label FROM scored", "split, run")})""",
            SCORED,
        ),
    ),
    "quality_by_length": (quality_by_length, curve("SELECT lang, CAST(n_chars AS DOUBLE) AS score, quality AS label FROM labels l JOIN documents d ON l.doc_id = d.doc_id", "lang")),
    "prediction_ranks": (rank_of_predictions, sql("SELECT split, unit_id, score, rank FROM ranked WHERE rank <= 20", SCORED + ", " + RANKED)),
    "binned_metrics": (
        binned,
        sql(
            f"""SELECT c.*, b.brier FROM ({curve("SELECT split, label, CASE WHEN hi > lo THEN floor((score - lo) / (hi - lo) * 63) ELSE 0 END AS score FROM (SELECT *, min(score) OVER (PARTITION BY split) AS lo, max(score) OVER (PARTITION BY split) AS hi FROM scored)", "split")}) c
            JOIN (SELECT split, round(avg(pow(score - label, 2)), 6) AS brier FROM scored GROUP BY split) b ON c.split = b.split""",
            SCORED,
        ),
    ),
}
