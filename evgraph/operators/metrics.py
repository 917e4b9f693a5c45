"""Ranking and classification metrics of (group, score, label) rows, exact under ties.

Scores are counted before any window, so windows run over distinct scores; every metric comes for all groups at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_score(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows and positives of each distinct score, with those of all higher ones and of the group."""
    return _with_above(rows.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("p")), by)


def _with_above(counted: DataFrame, by: list[str]) -> DataFrame:
    """by_score of rows that are counted already: by, score, n, p."""
    above = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return counted.withColumns({"cn": F.sum("n").over(above), "cp": F.sum("p").over(above), "all_n": F.sum("n").over(whole), "all_p": F.sum("p").over(whole)})


def classification(rows: DataFrame, by: list[str]) -> DataFrame:
    """AUROC (half for ties; null with one class) and average precision (null without positives) of each group."""
    return _areas(by_score(rows, by), by)


def _areas(s: DataFrame, by: list[str]) -> DataFrame:
    negatives = F.col("n") - F.col("p")
    won = F.sum(negatives.cast("double") * (F.col("cp") - F.col("p")) + 0.5 * negatives * F.col("p"))
    out = s.groupBy(*by).agg(
        F.max("all_n").alias("rows"), F.max("all_p").alias("positives"), won.alias("won"), F.sum(F.col("p") * F.col("cp") / F.col("cn")).alias("area")
    )
    pairs = F.col("positives").cast("double") * (F.col("rows") - F.col("positives"))
    return out.withColumn("auroc", F.round(F.col("won") / F.nullif(pairs, F.lit(0.0)), 6)).withColumn("auprc", F.round(F.col("area") / F.nullif(F.col("positives"), F.lit(0)), 6)).drop("won", "area")


def ranked(rows: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Rows with their rank by falling score, ties by `tie`, and the rank that perfect scores would give."""
    w = Window.partitionBy(*by)
    return rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), tie))).withColumn("ideal_rank", F.row_number().over(w.orderBy(F.desc("label"), tie)))


def at_k(ranks: DataFrame, by: list[str], ks: list[int]) -> DataFrame:
    """Precision, recall, hits, NDCG and enrichment of the first k of each group; k is cut at the group's size."""
    each = ranks.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = (F.col("rank") <= F.col("k")).cast("bigint") * F.col("label")
    gain = lambda r: F.when(F.col(r) <= F.col("k"), F.col("label") / F.log2(F.col(r) + 1.0)).otherwise(0.0)
    out = each.groupBy(*by, "k").agg(
        F.count("*").alias("rows"), F.sum("label").cast("bigint").alias("positives"), F.sum(hit).cast("bigint").alias("hits"), F.sum(gain("rank")).alias("dcg"), F.sum(gain("ideal_rank")).alias("ideal")
    )
    size = F.least("k", "rows")
    precision = F.col("hits") / size
    return out.select(
        *by, "k", "hits", F.round(precision, 6).alias("precision"), F.round(F.col("hits") / F.nullif("positives", F.lit(0)), 6).alias("recall"),
        F.round(F.col("dcg") / F.nullif(F.col("ideal"), F.lit(0.0)), 6).alias("ndcg"),
        F.round(precision / F.nullif(F.col("positives") / F.col("rows"), F.lit(0.0)), 6).alias("enrichment"),
    )


def graded_ndcg(rows: DataFrame, by: list[str], k: int, tie: str) -> DataFrame:
    """NDCG of the first k with the heat as gain; null if all scores are equal or no heat is positive."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), tie))).withColumn("best", F.row_number().over(w.orderBy(F.desc("heat"), tie)))
    gain = lambda c: F.sum(F.when(F.col(c) <= k, F.col("heat") / F.log2(F.col(c) + 1.0)).otherwise(0.0))
    out = r.groupBy(*by).agg(gain("rank").alias("dcg"), gain("best").alias("ideal"), (F.max("score") > F.min("score")).alias("varies"))
    return out.select(*by, F.when(F.col("varies"), F.round(F.col("dcg") / F.nullif(F.col("ideal"), F.lit(0.0)), 6)).alias("ndcg"))


def reciprocal_rank(ranks: DataFrame, by: list[str]) -> DataFrame:
    """1 / rank of the first positive of each group; 0 without one."""
    return ranks.groupBy(*by).agg(F.round(F.coalesce(1.0 / F.min(F.when(F.col("label") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"))


def thresholded(rows: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Confusion counts at a threshold, and what follows from them."""
    yes, pos = F.col("score") >= threshold, F.col("label") == 1
    out = rows.groupBy(*by).agg(F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"), F.count_if(~yes & ~pos).alias("tn"))

    def share(a: Column, b: Column) -> Column:
        return F.round(a / F.nullif(b, F.lit(0)), 6)

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns(
        {"accuracy": share(tp + tn, tp + fp + fn + tn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "specificity": share(tn, tn + fp), "f1": share(2 * tp, 2 * tp + fp + fn)}
    )


def midranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, midrank) of each distinct value: the mean of the ranks that its rows take."""
    return _midranks(rows.groupBy(*by, value).agg(F.count("*").alias("n")), by, value)


def _midranks(counted: DataFrame, by: list[str], value: str) -> DataFrame:
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("midrank", F.sum("n").over(upto) - (F.col("n") - 1) / 2).drop("n")


def regression(rows: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE, Pearson and Spearman (by midranks) of score against heat; rows that aren't finite are left out.

    Rows are counted by their two values first, and all sums are of these counts. Midranks need one task for each group's distinct values, not for its rows.
    """
    finite = rows.filter(F.col("score").isNotNull() & F.col("heat").isNotNull() & ~F.isnan("score") & ~F.isnan("heat"))
    counted = finite.groupBy(*by, "score", "heat").agg(F.count("*").alias("n"))
    a, b = (_midranks(counted.groupBy(*by, c).agg(F.sum("n").alias("n")), by, c).withColumnRenamed("midrank", r) for c, r in (("score", "ra"), ("heat", "rb")))
    met = counted.join(a, [*by, "score"]).join(b, [*by, "heat"])
    # products are of distances to the means, so that large values lose no digits
    mean = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"{c}_mean")
    met = met.join(counted.groupBy(*by).agg(mean("score"), mean("heat"), ((F.sum("n") + 1) / 2).alias("rank_mean")), by)
    total = lambda x: F.sum(F.col("n") * x)
    diff, off = F.col("score") - F.col("heat"), lambda c, m=None: F.col(c) - F.col(m or f"{c}_mean")

    def corr(x: Column, y: Column) -> Column:
        return F.round(total(x * y) / F.nullif(F.sqrt(total(x * x) * total(y * y)), F.lit(0.0)), 6)

    return met.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.round(total(F.abs(diff)) / F.sum("n"), 6).alias("mae"), F.round(F.sqrt(total(diff * diff) / F.sum("n")), 6).alias("rmse"),
        corr(off("score"), off("heat")).alias("pearson"), corr(off("ra", "rank_mean"), off("rb", "rank_mean")).alias("spearman"),
    )


def strata(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Each row once for every stratification and once for all rows together."""
    each = [F.struct(F.lit("overall").alias("stratification"), F.lit("all").alias("stratum"))]
    each += [F.struct(F.lit(k).alias("stratification"), c.alias("stratum")) for k, c in columns.items()]
    return rows.withColumn("s", F.explode(F.array(*each))).select("*", "s.*").drop("s")


def top_composition(ranks: DataFrame, by: list[str], k: int) -> DataFrame:
    """Shares of each stratum among the first k rows and their positives, and precision inside; strata are set before ranking."""
    top = ranks.filter(F.col("rank") <= k)
    groups = [c for c in by if c != "stratum"]
    counted = top.groupBy(*by).agg(F.count("*").alias("rows"), F.sum("label").cast("bigint").alias("positives"))
    w = Window.partitionBy(*groups)
    return counted.withColumns(
        {
            "share_of_top": F.round(F.col("rows") / F.sum("rows").over(w), 6),
            "share_of_positives": F.round(F.col("positives") / F.nullif(F.sum("positives").over(w), F.lit(0)), 6),
            "precision": F.round(F.col("positives") / F.col("rows"), 6),
        }
    )


def binned(rows: DataFrame, by: list[str], bins: int = 4096) -> DataFrame:
    """AUROC and AUPRC from equal-width bins of the score, and the Brier score; the curve starts at the origin.

    Each group's range of scores is one row, which its rows meet; only the counts of bins are put in order.
    """
    ranges = rows.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    low, high = F.col("low"), F.col("high")
    spot = F.when(high > low, F.floor((F.col("score") - low) / (high - low) * (bins - 1))).otherwise(F.lit(0))
    placed = rows.join(F.broadcast(ranges), same).withColumn("bin", spot)
    b = placed.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("p"), F.sum(F.pow(F.col("score") - F.col("label"), 2)).alias("sq"))
    areas = _areas(_with_above(b.filter(F.col("p").isNotNull()).select(*by, F.col("bin").alias("score"), "n", "p"), by), by)
    brier = b.groupBy(*by).agg(F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))
    return areas.join(brier, by)
