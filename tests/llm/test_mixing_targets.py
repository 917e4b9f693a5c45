"""Targets of the mixture where one source is hot and languages are rare."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from evgraph.llm import mixing

POWERS = (("mix_source", 0.7), ("mix_lang", 0.7), ("mix_topic", 0.9))


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the documents from one source, 200 sources by Zipf's law, languages of 90, 9 and 1 %."""
    rng = random.Random(5)
    names, law = [f"s{i}" for i in range(200)], [1 / (i + 1) for i in range(200)]
    rows = []
    for i in range(6000):
        source = "hot" if rng.random() < 1 / 3 else rng.choices(names, law)[0]
        lang = rng.choices(["en", "de", "is"], [90, 9, 1])[0]
        rows.append((i, " ".join(f"longwords{chr(97 + rng.randint(0, 15))}" for _ in range(rng.randint(5, 15))), lang, source))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").persist()


def margins(rows, column, amount):
    out = Counter()
    for r in rows:
        out[r[column]] += r.mix_tokens * amount(r)
    total = sum(out.values())
    return {k: x / total for k, x in out.items()}


def worst(rows, column, power, amount):
    """The largest gap of a value's share of the sample from its target, and the largest as a share of the target."""
    plain, got = margins(rows, column, lambda r: 1), margins(rows, column, amount)
    goal = {k: n**power for k, n in plain.items()}
    goal = {k: x / sum(goal.values()) for k, x in goal.items()}
    return max(abs(got[k] - goal[k]) for k in goal), max(abs(got[k] / goal[k] - 1) for k in goal)


@pytest.mark.parametrize("budget", [0.7, 1.5])
def test_expected_tokens_meet_targets_and_budget(hot, budget):
    rows = mixing.mix(hot, budget=budget).collect()
    tokens = sum(r.mix_tokens for r in rows)
    for column, power in POWERS:
        assert worst(rows, column, power, lambda r: r.keep_p)[0] < 1e-5
    assert abs(sum(r.mix_tokens * r.keep_p for r in rows) / tokens - budget) < 1e-6
    assert max(r.keep_p for r in rows) > 1


def test_given_targets_are_met_and_infeasible_ones_told(hot):
    plain = margins(hot_rows := mixing.mix(hot).collect(), "mix_lang", lambda r: 1)
    assert len(plain) == 3 and hot_rows[0].mix_gap < 1e-5
    rows = mixing.mix(hot, targets={"source": {"hot": 0.1, "s0": 0.2}, "lang": {"en": 0.5, "de": 0.3, "is": 0.2}}).collect()
    by_source, by_lang = margins(rows, "mix_source", lambda r: r.keep_p), margins(rows, "mix_lang", lambda r: r.keep_p)
    assert abs(by_source["hot"] - 0.1) < 1e-5 and abs(by_source["s0"] - 0.2) < 1e-5
    assert all(abs(by_lang[k] - x) < 1e-5 for k, x in (("en", 0.5), ("de", 0.3), ("is", 0.2))) and rows[0].mix_gap < 1e-5
    lost = mixing.mix(hot, targets={"lang": {"xx": 0.25}}).first()
    assert abs(lost.mix_gap - 0.25) < 0.26 and lost.mix_gap > 0.1


def test_raking_twin(hot):
    """The factors are those of plain raking over the cells."""
    rows = mixing.mix(hot).collect()
    cells = Counter()
    for r in rows:
        cells[(r.mix_source, r.mix_lang, r.mix_topic)] += r.mix_tokens
    total, w = sum(cells.values()), {k: float(n) for k, n in cells.items()}
    goals = []
    for at, (_, power) in enumerate(POWERS):
        plain = Counter()
        for k, n in cells.items():
            plain[k[at]] += n
        raised = {k: n**power for k, n in plain.items()}
        goals.append({k: x / sum(raised.values()) * total for k, x in raised.items()})
    for _ in range(300):
        for at in (1, 2, 0):
            now = Counter()
            for k, x in w.items():
                now[k[at]] += x
            w = {k: x * goals[at][k[at]] / now[k[at]] for k, x in w.items()}
    assert all(abs(r.weight - w[(r.mix_source, r.mix_lang, r.mix_topic)] / cells[(r.mix_source, r.mix_lang, r.mix_topic)]) < 1e-3 for r in rows)


def test_copies_follow_expectation(spark, hot):
    rows = mixing.mix(hot).collect()
    assert all(int(r.keep_p) <= r.copies <= int(r.keep_p) + 1 and r.kept == (r.copies > 0) for r in rows)
    assert abs(sum(r.mix_tokens * r.copies for r in rows) / sum(r.mix_tokens for r in rows) - 0.7) < 0.02
    assert worst(rows, "mix_lang", 0.7, lambda r: r.copies)[0] < 0.01
    drawn = Counter(r.doc_id for r in corpus_pipeline.mixture(spark, hot, "").collect())
    assert drawn == Counter({r.doc_id: r.copies for r in rows if r.copies})
