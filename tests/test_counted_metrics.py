"""Metrics of binned scores and of regressions work on counts: no window or join meets a group's rows."""

import re

from pyspark.sql import functions as F

from evgraph.operators import metrics


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_binned_has_no_window_over_rows(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 3 > 0, "a").alias("split"), (F.xxhash64("id") % 100 / 100.0).alias("score"), (F.xxhash64("id", F.lit(1)) % 3 == 0).cast("int").alias("label"))
    plan = plan_of(metrics.binned(rows, ["split"], 64))
    assert "array_repeat" not in plan and all("min(" not in w and "max(" not in w for w in re.findall(r"Window \[.*", plan))
    got = {r.split: r for r in metrics.binned(rows.filter("split = 'a'"), ["split"], 100000).collect()}
    want = {r.split: r for r in metrics.classification(rows.filter("split = 'a'"), ["split"]).collect()}
    assert (got["a"].auroc, got["a"].auprc, got["a"].rows) == (want["a"].auroc, want["a"].auprc, want["a"].rows)


def test_regression_meets_counts_and_not_rows(spark):
    rows = spark.range(400).select((F.col("id") % 2).alias("split"), (1e6 + F.xxhash64("id") % 5).alias("score"), (F.xxhash64("id", F.lit(1)) % 4 + F.xxhash64("id") % 5).cast("double").alias("heat"))
    got = {r.split: r for r in metrics.regression(rows, ["split"]).collect()}
    for r in rows.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("score") - F.col("heat"))).alias("mae"), F.corr("score", "heat").alias("pearson")).collect():
        assert got[r.split].rows == r.n and abs(got[r.split].mae - r.mae) < 1e-5 and abs(got[r.split].pearson - r.pearson) < 2e-6
    flat = metrics.regression(rows.withColumn("score", F.lit(1.0)), ["split"]).first()
    assert flat.pearson is None and flat.spearman is None
    plan = plan_of(metrics.regression(rows, ["split"]))
    joins = plan[plan.index("Join") :]
    assert plan.count("Range (0, 400") == joins.count("Range (0, 400") == len(re.findall(r"Aggregate \[split\S*, score\S*, heat\S*\]", joins))
