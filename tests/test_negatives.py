"""Negatives are the first pairs of the whole space in hash order, at any size."""

import hashlib

from evgraph.operators import links


def test_negatives_are_the_same_rows_at_any_size(spark):
    s, t = spark.range(90).selectExpr("id as source"), spark.range(80).selectExpr("id as target")
    pos = s.crossJoin(t).filter("(source + target) % 2 = 0")  # half of the space
    want = spark.createDataFrame([("train", 2900), ("validation", 300), ("test", 360)], "split string, n long")
    rows = [{tuple(r) for r in links.negatives(s, t, pos, want, **k).collect()} for k in ({}, {"small": 1}, {"small": 1, "block": 50})]
    assert len(rows[0]) == 3560 and rows[0] == rows[1] == rows[2]
    few = spark.createDataFrame([("test", 10), ("train", 25)], "split string, n long")
    every = sorted((hashlib.md5(f"43|{i}|{j}".encode()).hexdigest(), i, j) for i in range(90) for j in range(80) if (i + j) % 2)
    got = {tuple(r) for r in links.negatives(s, t, pos, few, small=1).collect()}
    assert got == {(i, j, "test" if k < 10 else "train") for k, (_, i, j) in enumerate(every[:35])}


def test_many_hashes_at_once_find_the_first_pairs_of_any_ids(spark):
    from evgraph.operators import first_pairs

    heads, tails = [b"43|a\xc3\xa9|", b"43|xyz|"], [b"", b"7", b"12345678", b"\xe4\xb8\xad", b"t" * 40]
    want = [[int(hashlib.md5(h + t).hexdigest()[:8], 16) for t in tails] for h in heads]
    assert first_pairs.first_words(heads, first_pairs.Tails(tails)).tolist() == want
    # ids of many lengths, some too long for one block of MD5, repeated and beyond ASCII; lists of a few targets each
    left, right = [f"s{'é' * (i % 9)}{i}" for i in range(60)] + ["s" * 70, "s" * 53], [f"{10**(i % 7)}{i}" for i in range(50)] + ["t" * 80, "中"]
    s, t = spark.createDataFrame([(x,) for x in left], "source string"), spark.createDataFrame([(x,) for x in right], "target string")
    pos = s.crossJoin(t).filter("source like '%3' or target like '%7'")
    known = {tuple(r) for r in pos.collect()}
    every = sorted((hashlib.md5(f"43|{i}|{j}".encode()).hexdigest(), i, j) for i in left for j in right if (i, j) not in known)
    n = spark.createDataFrame([("test", 40), ("train", 200)], "split string, n long")
    got = [{tuple(r) for r in links.negatives(s, t, pos, n, small=1, **k).collect()} for k in ({}, {"wide": 7, "block": 100})]
    assert got[0] == got[1] == {(i, j, "test" if k < 40 else "train") for k, (_, i, j) in enumerate(every[:240])}
    space = s.crossJoin(t).count()
    met = spark.createDataFrame([([(x, x) for x in left], [(x, x) for x in right])], "sources array<struct<id: string, text: string>>, targets array<struct<id: string, text: string>>")
    rows = met.mapInArrow(lambda b: first_pairs.below(b, 43, 1 << 28), "source string, target string").count()
    assert rows < space / 4  # only pairs under the bound become rows, before: all of the space
