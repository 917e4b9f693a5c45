"""The quality model on votes whose rates are known, and against expectation-maximisation over single documents."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evgraph.llm import quality_rules

NAMES = [r for rules in quality_rules.FAMILIES.values() for r in rules]
KIND = [k for k, rules in enumerate(quality_rules.FAMILIES.values(), 1) for _ in rules]
SHARES = [0.8, 0.09, 0.06, 0.05]


def planted(n, seed):
    """Documents of known class, and the rates of bad votes by which they were drawn: on other text and on the rule's own kind."""
    rng = random.Random(seed)
    rates = [(0.01 + 0.04 * (r % 3), 0.95 - 0.12 * (r % 4)) for r in range(len(NAMES))]
    docs = []
    for _ in range(n):
        z = rng.choices(range(4), SHARES)[0]
        docs.append((z, tuple(0 if rng.random() < 0.1 else -1 if rng.random() < rates[r][KIND[r] == z] else 1 for r in range(len(NAMES)))))
    return docs, rates


def test_planted_rates_and_accuracies_are_recovered():
    docs, rates = planted(30_000, 1)
    found = quality_rules.fit(sorted(Counter(v for _, v in docs).items()))
    for r, (on_good, on_bad) in enumerate(rates):
        assert abs(found.on_good[r] - on_good) < 0.02 and abs(found.on_bad[r] - on_bad) < 0.05
        cast = [(z == KIND[r]) == (v[r] < 0) for z, v in docs if v[r]]
        assert abs(found.accuracies[NAMES[r]] - sum(cast) / len(cast)) < 0.05
    assert all(abs(a - b) < 0.02 for a, b in zip(found.shares, SHARES, strict=True))


def test_one_weak_bad_vote_does_not_decide():
    docs, _ = planted(30_000, 2)
    counts = sorted(Counter(v for _, v in docs).items())
    found = quality_rules.fit(counts)
    good = found.posterior(np.array([p for p, _ in counts]))[:, 0]
    kept_with_bad_vote = sum(n for g, (p, n) in zip(good, counts, strict=True) if g >= 0.5 and min(p) < 0)
    dropped = sum(n for g, (p, n) in zip(good, counts, strict=True) if g < 0.5)
    assert kept_with_bad_vote > 1000 and dropped > 4000


def test_fit_is_stable_under_resampling():
    docs, _ = planted(20_000, 3)
    rng = random.Random(4)
    fits = [quality_rules.fit(sorted(Counter(v for _, v in rng.choices(docs, k=len(docs))).items())) for _ in range(4)]
    for r in range(len(NAMES)):
        assert max(f.on_bad[r] for f in fits) - min(f.on_bad[r] for f in fits) < 0.08
        assert max(f.accuracies[NAMES[r]] for f in fits) - min(f.accuracies[NAMES[r]] for f in fits) < 0.02


def posterior(votes, shares, on_good, on_bad):
    x = [shares[0]]
    for k in range(1, 4):
        p = shares[k]
        for r, v in enumerate(votes):
            if KIND[r] == k and v:
                p *= on_bad[r] / on_good[r] if v < 0 else (1 - on_bad[r]) / (1 - on_good[r])
        x.append(p)
    return [p / sum(x) for p in x]


def test_same_as_single_documents():
    docs = [v for _, v in planted(300, 5)[0]]
    z = []
    for v in docs:
        share = [sum(x < 0 for x, k in zip(v, KIND, strict=True) if k == j) / max(1, sum(x != 0 for x, k in zip(v, KIND, strict=True) if k == j)) for j in (1, 2, 3)]
        top = max(share)
        z.append([0.2 if top >= 0.5 else 1.0] + [0.8 if top >= 0.5 and share.index(top) == j else 0.0 for j in range(3)])
    for _ in range(400):
        shares = [(sum(p[k] for p in z) + 1) / (len(docs) + 4) for k in range(4)]
        on_good, on_bad = [], []
        for r, k in enumerate(KIND):
            own = [(p[k], v[r]) for p, v in zip(z, docs, strict=True) if v[r]]
            on_bad.append((sum(p for p, v in own if v < 0) + 5) / (sum(p for p, _ in own) + 10))
            on_good.append((sum(1 - p for p, v in own if v < 0) + 0.5) / (sum(1 - p for p, _ in own) + 10))
        z = [posterior(v, shares, on_good, on_bad) for v in docs]
    found = quality_rules.fit(sorted(Counter(docs).items()))
    got = found.posterior(np.array(docs))
    assert all(math.isclose(a, b, abs_tol=1e-5) for x, y in zip(got.tolist(), z, strict=True) for a, b in zip(x, y, strict=True))


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(rng.randint(120, 200))]
        if i % 10 == 1:
            words = [w + "###" for w in words]
        if i % 10 == 2:
            words = words[:10] * 15
        if i % 10 == 3:
            words = words[:25]  # short, and nothing else
        for j in range(0, len(words), 12):
            words[j] += "."
        rows.append((i, " ".join(words)))
    return quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string")).persist()


def test_posterior_of_rows_is_that_of_the_model(judged):
    found = quality_rules.fitted(judged)
    for r in judged.collect():
        p = posterior([r[f"vote_{n}"] for n in NAMES], found.shares, found.on_good, found.on_bad)[0]
        assert math.isclose(p, r.p_good, abs_tol=1e-9) and r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_kept_is_not_all_must_pass(judged):
    bad = F.least(*(F.col(f"vote_{n}") for n in NAMES)) < 0
    assert judged.filter(bad & F.col("kept")).count() >= 50  # a short text alone isn't a bad one
    assert judged.filter("doc_id % 10 in (1, 2) and kept").count() == 0
    assert judged.filter("doc_id % 10 in (0, 4, 5, 6, 7, 8, 9) and not kept").count() == 0
