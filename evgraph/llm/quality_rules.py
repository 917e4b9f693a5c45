"""Text quality by weak supervision, in DataFrame operations.

Rules vote good, vote bad or abstain on each document. They form families that look at one kind of bad text each (characters,
repetition, form). A document is good or bad of one kind; a kind changes the votes of its own family's rules alone, so rules of a family are
modelled together, and good votes of other families don't outweigh them. Expectation-maximisation over the counts of vote
patterns (at most 3**rules rows, from all documents) estimates how often each rule votes which way on good text and on its kind
of bad text; the posterior probability of good text decides, instead of a test that all rules pass.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.shared import store

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENDS = ".!?"
CLUTTER = "0123456789\"'()[]{}~_=+/\\@^`-:;,.!?" + SYMBOLS
FAMILIES = {
    "characters": ("word_length", "symbols", "clutter"),
    "repetition": ("lines", "repeats", "variety"),
    "form": ("length", "capitals", "sentences", "line_words"),
}
# pseudo-votes that each rate starts from, and the rate of bad votes that they stand for on good text and on a kind of bad text
PRIOR_VOTES, PRIOR_GOOD, PRIOR_BAD = 10.0, 0.05, 0.5


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, window: int) -> Column:
    """Words that lie in windows of the given length found twice or more in the array, the first one included."""

    def covered(hashes: Column) -> Column:
        def places(ordered: Column) -> Column:
            def twin(e: Column, j: Column) -> Column:
                same = lambda k: F.coalesce(F.get(ordered, k)["h"] == e["h"], F.lit(False))
                return same(j - 1) | same(j + 1)

            return F.sort_array(F.transform(F.filter(ordered, twin), lambda e: e["i"]))

        def total(at: Column) -> Column:
            widths = F.transform(at, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - p, F.lit(window))))
            return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = let(let(ordered, places), total)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), some).otherwise(F.lit(0).cast("long"))

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashed) - (window - 1)), lambda i: F.xxhash64(F.slice(hashed, i, window)))

    long_enough = let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), covered)
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(long_enough)


def features(docs: DataFrame) -> DataFrame:
    """Counts over whole texts; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    base = docs.select(
        F.col("doc_id"),
        text.alias("text"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"),
        lines.alias("lines"),
    )
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _without(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), 8).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _without(F.col("text"), UPPER).cast("long").alias("n_upper"),
        _without(F.col("text"), ENDS).cast("long").alias("n_ends"),
        _without(F.col("text"), CLUTTER).cast("long").alias("n_clutter"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    c = F.col
    n, chars = c("n_words"), c("word_chars")
    return {
        "word_length": rule((chars < 3 * n) | (chars > 8 * n), (chars >= 4 * n) & (2 * chars <= 13 * n) & (n > 0)),
        "symbols": rule(10 * c("n_symbols") > n, (100 * c("n_symbols") <= n) & (n > 0)),
        "clutter": rule(100 * c("n_clutter") > 15 * chars, (100 * c("n_clutter") <= 8 * chars) & (n > 0)),
        "lines": rule(10 * c("n_dup_lines") > 3 * c("n_lines"), (c("n_dup_lines") == 0) & (c("n_lines") > 1)),
        "repeats": rule(5 * c("n_repeat_words") > n, (c("n_repeat_words") == 0) & (n >= 8)),
        "variety": rule(10 * c("n_distinct") < 3 * n, (2 * c("n_distinct") > n) & (n >= 20)),
        "length": rule(n < 30, n >= 100),
        "capitals": rule(10 * c("n_upper") > 3 * chars, (10 * c("n_upper") <= chars) & (n > 0)),
        "sentences": rule((60 * c("n_ends") < n) | (2 * c("n_ends") > n), (30 * c("n_ends") >= n) & (4 * c("n_ends") <= n) & (n > 0)),
        "line_words": rule(n < 3 * c("n_lines"), (n >= 8 * c("n_lines")) & (n > 0)),
    }


class Fit:
    """Rates of bad votes and shares of classes; all rules in the order of names, class 0 is good text and class k the k-th family's kind."""

    def __init__(self, names: list[str], family: np.ndarray, shares: np.ndarray, on_good: np.ndarray, on_bad: np.ndarray, accuracy: np.ndarray):
        self.names, self.family, self.shares, self.on_good, self.on_bad = names, family, shares, on_good, on_bad
        self.accuracies = dict(zip(names, accuracy.tolist(), strict=True))

    def adds(self) -> tuple[np.ndarray, np.ndarray]:
        """What a bad and a good vote of each rule add to the log-odds of its own kind of bad text against good text."""
        return np.log(self.on_bad / self.on_good), np.log((1 - self.on_bad) / (1 - self.on_good))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of each class for each row of votes."""
        bad, good = self.adds()
        x = np.tile(np.log(self.shares), (len(patterns), 1))
        for k in range(1, len(self.shares)):
            own = self.family == k
            x[:, k] += (patterns[:, own] < 0) @ bad[own] + (patterns[:, own] > 0) @ good[own]
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def fit(counts: list[tuple[tuple[int, ...], int]], families: dict[str, tuple[str, ...]] = FAMILIES, rounds: int = 1000, tolerance: float = 1e-9) -> Fit:
    """Expectation-maximisation from (votes, documents) rows; votes follow the order of the families' rules.

    On text that isn't of its own kind, a rule's bad votes have one rate, whatever the text is; on its own kind they have another.
    Abstaining tells nothing. Each rate starts from PRIOR_VOTES pseudo-votes, which tell the direction of a rule and little more once
    it has voted a thousand times. At the start a document is taken for the kind whose rules mostly vote bad, and for good without such a kind.
    The accuracy of a rule is the expected share of its votes that are right about its own kind.
    """
    names = [r for rules in families.values() for r in rules]
    family = np.array([k for k, rules in enumerate(families.values(), 1) for _ in rules])
    kinds, rules = len(families), range(len(names))
    patterns = np.array([p for p, _ in counts], np.int64).reshape(-1, len(names))
    n = np.array([m for _, m in counts], np.float64)
    bad, votes_ = (patterns < 0).astype(np.float64), (patterns != 0).astype(np.float64)
    shares = np.stack([bad[:, family == k].sum(axis=1) / np.maximum(1, votes_[:, family == k].sum(axis=1)) for k in range(1, kinds + 1)], axis=1)
    z = np.zeros((len(n), kinds + 1))
    sure = shares.max(axis=1, initial=0) >= 0.5
    z[:, 0] = np.where(sure, 0.2, 1.0)
    z[np.flatnonzero(sure), shares.argmax(axis=1)[sure] + 1] = 0.8
    out = None
    for _ in range(rounds):
        on_good, on_bad, accuracy = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
        for r in rules:
            own = z[:, family[r]] * n
            rest = n - own
            bad_own, all_own, bad_rest, all_rest = own @ bad[:, r], own @ votes_[:, r], rest @ bad[:, r], rest @ votes_[:, r]
            on_good[r] = (bad_rest + PRIOR_GOOD * PRIOR_VOTES) / (all_rest + PRIOR_VOTES)
            on_bad[r] = (bad_own + PRIOR_BAD * PRIOR_VOTES) / (all_own + PRIOR_VOTES)
            accuracy[r] = (bad_own + all_rest - bad_rest + (1 - PRIOR_GOOD) * PRIOR_VOTES) / (all_own + all_rest + PRIOR_VOTES)
        out = Fit(names, family, (n @ z + 1) / (n.sum() + kinds + 1), on_good, on_bad, accuracy)
        before, z = z, out.posterior(patterns)
        if np.abs(z - before).max(initial=0) <= tolerance:
            break
    return out


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Posterior probability that each text is good, from the votes of all rules.

    docs: doc_id, text; other columns are ignored. Returns doc_id, the counts of features(), one column vote_<rule>
    for each rule, p_good double, base_failed boolean (under 20 words, or over 30 % in repeated windows) and kept boolean
    (p_good >= threshold and not base_failed). A null or empty text has no words and fails the base. Each row is judged
    alone, so repeated rows get equal results, also rows that repeat a doc_id with another text; an empty table gives no rows.
    """
    rules = votes()
    counted = store(features(docs).withColumns({f"vote_{k}": v for k, v in rules.items()}), "quality")
    found = fitted(counted)
    bad, good = found.adds()
    odds = F.lit(0.0)
    for k in range(1, len(found.shares)):
        x = F.lit(math.log(found.shares[k] / found.shares[0]))
        for r in np.flatnonzero(found.family == k):
            vote = F.col(f"vote_{found.names[r]}")
            x = x + F.when(vote < 0, float(bad[r])).when(vote > 0, float(good[r])).otherwise(0.0)
        odds = odds + F.exp(x)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = counted.withColumn("p_good", 1 / (1 + odds)).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def fitted(counted: DataFrame) -> Fit:
    """The model of all rows of counted (columns vote_<rule>); only the counts of vote patterns reach the driver."""
    names = [f"vote_{r}" for rules in FAMILIES.values() for r in rules]
    rows = counted.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    return fit([(tuple(r[n] for n in names), r["n"]) for r in rows])


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))
