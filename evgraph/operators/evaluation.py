"""Reports of scored rows, in wide and long form, and tables that compare the reports of many runs.

No window spans all rows of a split (see `tops` for its bound): the first k rows are cut before they are shuffled, ranks of first positives are counted, and areas come from score ranges
with the counts above each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.operators import graph, metrics
from evgraph.operators.audit import union_all

KS = [10, 50, 100, 500, 1000]


def areas(rows: DataFrame, by: list[str], ranges: int = 256, spread: tuple[float, float] | None = None) -> DataFrame:
    """Rows, positives, AUROC (half for ties; null with one class) and average precision (null without positives) of each group, exact whatever the ranges.

    Distinct scores are counted, then dealt to ranges between quantiles of them; a range starts from the counts of all ranges above. At most `ranges` bounds are sent to the tasks.
    Scores known to lie evenly within `spread` are dealt to ranges of equal width instead, without looking for quantiles.
    """
    counted = rows.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("p"))
    if spread is not None:
        width = (spread[1] - spread[0]) / ranges
        ranged = counted.withColumn("range", F.least(F.greatest(F.floor((F.col("score") - spread[0]) / width), F.lit(0)), F.lit(ranges - 1)))
    else:
        steps = F.array(*(F.lit((i + 1) / ranges) for i in range(ranges - 1)))
        bounds = counted.agg(F.percentile_approx("score", steps, 10 * ranges).alias("bounds"))
        ranged = counted.join(F.broadcast(bounds), F.lit(True), "left").withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col("score")))).drop("bounds")
    sums = ranged.groupBy(*by, "range").agg(F.sum("n").alias("rn"), F.sum("p").alias("rp"))
    whole = Window.partitionBy(*by)
    above = whole.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    sums = sums.select(*by, "range", before("rn").alias("bn"), before("rp").alias("bp"), F.sum("rn").over(whole).alias("all_n"), F.sum("rp").over(whole).alias("all_p"))
    inside = Window.partitionBy(*by, "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    each = ranged.withColumns({"cn": F.sum("n").over(inside), "cp": F.sum("p").over(inside)}).join(sums, [*by, "range"])
    cn, cp, negatives = F.col("cn") + F.col("bn"), F.col("cp") + F.col("bp"), F.col("n") - F.col("p")
    out = each.groupBy(*by).agg(
        F.max("all_n").alias("rows"), F.max("all_p").alias("positives"), F.sum(negatives.cast("double") * (cp - F.col("p")) + 0.5 * negatives * F.col("p")).alias("won"), F.sum(F.col("p") * cp / cn).alias("area")
    )
    pairs = F.col("positives").cast("double") * (F.col("rows") - F.col("positives"))
    return out.select(*by, "rows", "positives", F.round(F.col("won") / F.nullif(pairs, F.lit(0.0)), 6).alias("auroc"), F.round(F.col("area") / F.nullif("positives", F.lit(0)), 6).alias("auprc"))


def first_hits(rows: DataFrame, by: list[str], tie: str) -> DataFrame:
    """(by, mrr): 1 / rank of each group's first positive, 0 without one. The rank is counted: rows with a higher score, and those of the same score before it by `tie`."""
    best = rows.groupBy(*by).agg(F.max(F.when(F.col("label") == 1, F.col("score"))).alias("best"))
    tied = rows.join(best, by).filter((F.col("label") == 1) & (F.col("score") == F.col("best"))).groupBy(*by).agg(F.first("best").alias("best"), F.min(tie).alias("first"))
    ahead = rows.join(tied, by).groupBy(*by).agg(F.count_if((F.col("score") > F.col("best")) | ((F.col("score") == F.col("best")) & (F.col(tie) < F.col("first")))).alias("ahead"))
    return best.select(*by).join(ahead, by, "left").select(*by, F.round(F.coalesce(1.0 / (F.col("ahead") + 1), F.lit(0.0)), 6).alias("mrr"))


def tops(rows: DataFrame, counts: DataFrame, by: list[str], tie: str, ks: list[int]) -> DataFrame:
    """Hits, precision, recall, NDCG and enrichment at each k, side by side: counts (by, example_count, positive_count) tells what a perfect order would reach.

    Rows past the largest k are cut before the shuffle if it is at most spark.sql.optimizer.windowGroupLimitThreshold (1000 by default); beyond it each group is sorted in one task.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), tie))
    first = rows.select(*by, "score", "label", tie).withColumn("rank", place).filter(F.col("rank") <= max(ks))
    hit = lambda k: (F.col("rank") <= k).cast("bigint") * F.col("label")
    sums = [x for k in ks for x in (F.sum(hit(k)).cast("bigint").alias(f"hits_at_{k}"), F.sum(hit(k) / F.log2(F.col("rank") + 1.0)).alias(f"dcg_{k}"))]
    out = counts.select(*by, "example_count", "positive_count").join(first.groupBy(*by).agg(*sums), by)
    columns = []
    for k in ks:
        hits = F.col(f"hits_at_{k}")
        precision = hits / F.least(F.lit(k), F.col("example_count"))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("positive_count").cast("int"))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
        columns += [
            hits, F.round(precision, 6).alias(f"precision_at_{k}"), F.round(hits / F.nullif("positive_count", F.lit(0)), 6).alias(f"recall_at_{k}"),
            F.when(F.col("positive_count") > 0, F.round(F.col(f"dcg_{k}") / ideal, 6)).alias(f"ndcg_at_{k}"),
            F.round(precision / F.nullif(F.col("positive_count") / F.col("example_count"), F.lit(0.0)), 6).alias(f"enrichment_at_{k}"),
        ]
    return out.select(*by, *columns)


def report(rows: DataFrame, by: list[str], tie: str, ks: list[int] = KS, threshold: float | None = None) -> DataFrame:
    """One row for each group of (score, label 0 or 1): counts, the range and mean of scores, AUROC, average precision, MRR, and precision, recall, hits, NDCG and enrichment at each k.

    With a threshold also confusion counts, accuracy, precision, recall, specificity and F1. Ties are ranked by `tie`; AUROC and average precision give tied scores one place. A null
    label or score is an error, as is a null in a column of `by`; an empty table gives no rows. The rows are written to the shared folder first.
    """
    error = F.raise_error(F.lit("rows need a group, a score that is a number and a label of 0 or 1"))
    bad = F.col("label").isNull() | F.col("score").isNull() | F.isnan("score") | ~F.col("label").isin(0, 1)
    checked = rows.withColumn("label", F.when(bad, error).otherwise(F.col("label")).cast("int"))
    # joins by the group would leave nulls out before anything is checked, so the group checks itself
    checked = checked.withColumns({c: F.when(F.col(c).isNull(), error).otherwise(F.col(c)) for c in by})
    # five aggregations read these rows
    checked = graph.written(checked.select(*by, tie, "score", "label"), "report-rows")
    counts = checked.groupBy(*by).agg(
        F.count("*").alias("example_count"), F.sum("label").cast("bigint").alias("positive_count"), F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.round(F.avg("score"), 6).alias("score_mean"),
    )
    counts = counts.withColumn("negative_count", F.col("example_count") - F.col("positive_count")).withColumn("positive_ratio", F.round(F.col("positive_count") / F.col("example_count"), 6))
    out = counts.join(areas(checked, by).drop("rows", "positives"), by).join(first_hits(checked, by, tie), by).join(tops(checked, counts, by, tie, ks), by)
    if threshold is not None:
        out = out.join(metrics.thresholded(checked, by, threshold), by)
    return out


def long(wide: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, value) for each metric of a report; a metric without a value is null."""
    values = [c for c in wide.columns if c not in by]
    return wide.select(*by, *(F.col(c).cast("double").alias(c) for c in values)).unpivot(by, values, "metric", "value")


def selected(rows: DataFrame, by: list[str], chosen: list[str]) -> DataFrame:
    """The chosen metrics of a long report side by side, those that are missing null."""
    return rows.groupBy(*by).pivot("metric", chosen).agg(F.max("value"))


def write_run(rows: DataFrame, root: str, dataset: str, run: str) -> None:
    """A run's long report (split, metric, value) as CSV with a header, under root/dataset/run."""
    rows.select("split", "metric", F.col("value").cast("string").alias("value")).write.mode("overwrite").option("header", True).csv(f"{root}/{dataset}/{run}")


def collect_runs(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, run, split, metric, value) of all reports under root: dataset and run are the folders above each file; a value that doesn't read as a number is null."""
    read = spark.read.option("header", True).schema("split string, metric string, value string").csv(f"{root}/*/*")
    path = F.split(F.col("_metadata.file_path"), "/")
    folder = lambda back: F.url_decode(F.element_at(path, -back))
    return read.select(folder(3).alias("dataset"), folder(2).alias("run"), "split", "metric", F.expr("try_cast(value as double)").alias("value"))


def leaderboard(rows: DataFrame, lower: tuple[str, ...] = ("mae", "rmse", "brier")) -> DataFrame:
    """The runs of each dataset, split and metric with their place: highest value first, lowest for metrics in `lower`, missing ones last, ties by name; and the gap to the best."""
    better = F.when(F.col("metric").isin(*lower), -F.col("value")).otherwise(F.col("value"))
    each = Window.partitionBy("dataset", "split", "metric")
    place = F.row_number().over(each.orderBy(F.desc_nulls_last("__better"), "run"))
    return rows.withColumn("__better", better).select("dataset", "split", "metric", "run", "value", place.alias("place"), F.round(F.max("__better").over(each) - F.col("__better"), 6).alias("behind_best"))


def per_task(rows: DataFrame, tasks: dict[str, tuple[str, str]], by: list[str], tie: str, ks: list[int] = KS) -> DataFrame:
    """A long report for each task: {name: (column that tells which rows are eligible, label column)}; all tasks share one pass of each metric."""
    parts = [rows.filter(F.col(ok)).select(*by, tie, "score", F.col(label).alias("label"), F.lit(name).alias("task")) for name, (ok, label) in tasks.items()]
    groups = ["task", *by]
    return long(report(union_all(parts), groups, tie, ks), groups)
