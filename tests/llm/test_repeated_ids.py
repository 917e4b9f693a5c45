"""Rows that repeat a doc_id with another text are documents of their own."""

import random

import pytest

import corpus_pipeline
from evgraph.llm import ngram_join, substring_dedup, suffix_dedup


def texts(seed, *words):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)) for n in words]


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_suffix_dedup_judges_each_text(make):
    a, b, c = texts(1, 60, 60, 60)
    rows = {(r.doc_id, r.n_bytes, bytes(r.kept).decode()): r.n_removed for r in suffix_dedup.suffix_dedup(make([(1, a), (1, b), (2, a), (3, c)])).collect()}
    assert rows == {(1, len(a), ""): len(a), (1, len(b), b): 0, (2, len(a), ""): len(a), (3, len(c), c): 0}


def test_substring_dedup_orders_texts_of_an_id(make):
    a, b = texts(2, 60, 60)
    got = sorted((r.doc_id, r.text == "") for r in substring_dedup.substring_dedup(make([(3, b), (5, a), (5, b), (7, a)])).collect())
    assert got == [(3, False), (5, False), (5, True), (7, True)]


def test_ngram_join_loses_no_link(make):
    a, b = texts(3, 60, 60)
    rows = ngram_join.ngram_jaccard(make([(5, a), (5, b), (7, b + " zz"), (9, a + " yy"), (5, a)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(5, 5), (5, 5), (5, 5), (7, 5), (9, 5)]
    assert len({r.group_id for r in rows}) == 2


def test_near_duplicates_keep_each_text(spark, make):
    a, b = texts(4, 60, 60)
    kept = corpus_pipeline.near_duplicates(spark, make([(5, a), (5, b), (7, b + " zz"), (5, a), (8, ""), (9, ""), (8, "")]), "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, a), (5, b), (8, ""), (8, ""), (9, "")])


def test_a_large_group_of_near_copies_is_one_class(spark, monkeypatch):
    """More near copies than a tile holds, some linked to no representative but through others."""
    monkeypatch.setattr(ngram_join, "BLOCK", 256)
    rng = random.Random(5)
    base = texts(6, 80)[0].split()
    rows = []
    for i in range(1500):
        words = list(base)
        for _ in range(rng.randint(0, 1)):
            words[rng.randrange(80)] = f"w{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    got = ngram_join.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}
