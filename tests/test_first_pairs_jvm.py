"""Pairs that are hashed within the JVM are those that numpy finds, and no Python worker meets the space."""

import hashlib

from pyspark.sql import functions as F

from evgraph.operators import evaluation, first_pairs_jvm, links, metrics


def test_pairs_found_in_the_jvm_are_those_below_the_bound(spark):
    name = first_pairs_jvm.function(spark)
    assert name is not None
    left = [f"s{'é' * (i % 9)}{i}" for i in range(40)] + ["s" * 70, "s" * 53, "", None]
    right = [f"{10 ** (i % 7)}{i}" for i in range(1100)] + ["t" * 80, "中", "", None]  # more than one block
    met = spark.createDataFrame([([(x, x) for x in left], [(x, x) for x in right])], "sources array<struct<id: string, text: string>>, targets array<struct<id: string, text: string>>")
    rows = met.select(F.explode(first_pairs_jvm.below(name, "sources", "targets", 43, 1 << 24)).alias("p")).select("p.*").collect()
    low = lambda s, t: s is None or t is None or len(f"43|{s}|{t}".encode()) > 55 or int(hashlib.md5(f"43|{s}|{t}".encode()).hexdigest()[:8], 16) <= 1 << 24
    assert sorted(map(tuple, rows), key=repr) == sorted(((s, t) for s in left for t in right if low(s, t)), key=repr)


def test_negatives_are_the_same_with_and_without_python(spark):
    s, t = spark.range(90).selectExpr("id as source"), spark.range(80).selectExpr("id as target")
    pos = s.crossJoin(t).filter("(source + target) % 2 = 0")
    want = spark.createDataFrame([("train", 2900), ("validation", 300), ("test", 360)], "split string, n long")
    rows = [{tuple(r) for r in links.negatives(s, t, pos, want, small=1, **k).collect()} for k in ({}, {"arrow": True}, {"block": 200, "wide": 9})]
    assert len(rows[0]) == 3560 and rows[0] == rows[1] == rows[2]


def test_areas_by_ranges_are_those_of_whole_groups(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("split"), (F.xxhash64("id") % 50 / 10.0).alias("score"), (F.xxhash64("id", F.lit(1)) % 4 == 0).cast("int").alias("label"))
    plain = lambda df: sorted(map(tuple, df.select("split", "rows", "positives", "auroc", "auprc").collect()))
    want = plain(metrics.classification(rows, ["split"]))
    assert plain(evaluation.areas(rows, ["split"])) == want
    for spread in ((-5.0, 5.0), (0.0, 1.0), (2.0, 2.5)):  # scores beyond the spread count in its first or last range
        assert plain(evaluation.areas(rows, ["split"], spread=spread)) == want


def test_random_scores_sort_no_split_in_one_task(spark):
    from evgraph.plans import link_plans

    plan = link_plans.random_baseline(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # windows over scores run within ranges of them; the sums of all ranges may be one task's
    assert "range" in plan and not any("Window" in x and "score" in x and "range" not in x for x in plan.splitlines())
