"""The scan against brute force: what it abandons and what it finds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evgraph.llm import adaptive_scan as scan_


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(100, dim))
    x = centres[rng.integers(0, 100, n)] + 0.5 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_scan_abandons_most_columns_and_finds_neighbours():
    x = clustered(20_000, 64)
    index = scan_.fit(x[:5000], None, len(x))
    placed = index.place(x, False)
    assert np.allclose(np.linalg.norm(placed, axis=1), np.linalg.norm(x, axis=1))
    own = index.nearest(placed, 1)[:, 0]
    blocks = [np.ascontiguousarray(placed[:, i : i + 16]) for i in range(0, 64, 16)]
    read = full = found = 0
    for q in range(0, 2000, 20):
        lists = index.nearest(placed[q : q + 1], len(index.centres))[0]
        parts = [np.flatnonzero(own == n) for n in lists]
        at, cells = scan_.scan(placed[q], blocks, parts, 21)
        best = np.argsort(-(x @ x[q]), kind="stable")[:21]
        found += len(set(best.tolist()) & set(at.tolist()))
        read, full = read + cells, full + x.size
        assert len(at) < 200
    assert found >= 0.97 * 21 * 100
    assert read < 0.5 * full


def test_a_known_distance_saves_more():
    x = clustered(4000, 32, 1)
    blocks = [x[:, :16], x[:, 16:]]
    parts = [np.arange(len(x))]
    d = ((x - x[5]) ** 2).sum(axis=1)
    near = float(np.partition(d, 20)[20])
    _, alone = scan_.scan(x[5], blocks, parts, 21)
    rows, told = scan_.scan(x[5], blocks, parts, 21, near)
    assert told <= alone and set(np.flatnonzero(d <= near * 0.8)) <= set(rows.tolist())


@pytest.mark.parametrize("lengths", [False, True])
def test_recall_of_the_operator(spark, lengths):
    x = clustered(3000, 24, 2)
    if lengths:  # inner products then differ from distances
        x = x * np.random.default_rng(3).uniform(0.5, 2, (len(x), 1))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in scan_.neighbours(v, v.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == list(range(0, 3000, 20))
    found = 0
    for i, rows in got.items():
        s = x @ x[i]
        s[i] = -math.inf
        found += len({r.vec_id for r in rows} & set(np.argsort(-s, kind="stable")[:20].tolist()))
        assert len(rows) == 20 and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in rows)
    assert found >= 0.9 * 20 * len(got)


def test_repeated_vec_id_counts_once(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.2, 0.8]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    rows = scan_.neighbours(v, v.filter("vec_id = 0")).collect()
    assert [(r["rank"], r.vec_id) for r in rows] == [(1, 2), (2, 1)]
