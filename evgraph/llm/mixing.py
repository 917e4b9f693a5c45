"""Mixing sources to target weights by iterative proportional fitting (raking).

Token counts of (source, language, topic) cells are raked until their marginals match the targets. Language and topic have few
values, so their factors are short vectors on the driver; there may be any number of sources, so their factors stay in a table, and
every round is one aggregation of it to a language by topic matrix. A cell's factor times the budget is the number of copies that
each of its documents is expected to have in the sample. It may exceed one: whole copies are certain and the rest is drawn, so
targets and budget hold for expected tokens however rare a value is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.shared import store

TOPICS = 8
OTHER = "und"


def topic(text: Column, topics: int = TOPICS) -> Column:
    """The hash bucket that most of the text's long lower-case words fall in; the first of equals, and 0 without such words."""
    buckets = F.transform(F.regexp_extract_all(text, F.lit("[a-z]{9,}"), F.lit(0)), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(topics)).cast("int"))

    def held(b: Column, k: int) -> Column:
        return F.size(F.filter(b, lambda x: x == k))

    def fullest(b: Column) -> Column:
        sizes = F.array(*(held(b, k) for k in range(topics)))
        return F.transform(F.array(sizes), lambda n: F.array_position(n, F.array_max(n)) - 1)[0]

    return F.transform(F.array(buckets), fullest)[0].cast("int")


def described(docs: DataFrame) -> DataFrame:
    """docs with mix_source, mix_lang, mix_topic and mix_tokens (words of the whole text; none if null)."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    return docs.withColumns(
        {
            "mix_source": F.coalesce("source", F.lit(OTHER)),
            "mix_lang": F.coalesce("lang", F.lit(OTHER)),
            "mix_topic": topic(text),
            "mix_tokens": words.cast("long"),
        }
    )


def shares(tokens: dict, power: float, given: dict | None = None) -> dict:
    """Target shares: those given, and what they leave for the other values in proportion to tokens ** power.

    Values without tokens get none of the rest; a given value that isn't in the table keeps its share, which can't be met.
    """
    given = given or {}
    raised = {k: n**power for k, n in tokens.items() if n > 0 and k not in given}
    rest, total = max(0.0, 1 - sum(given.values())), sum(raised.values())
    over = max(1.0, sum(given.values())) if total or not given else sum(given.values())
    out = dict.fromkeys(tokens, 0.0) | {k: x / total * rest for k, x in raised.items()}
    return out | {k: x / over for k, x in given.items()}


def _factor(column: str, factors: dict) -> Column:
    """A short table of factors as one expression."""
    return F.element_at(_map(factors), F.col(column)) if factors else F.lit(0.0)


def _map(factors: dict) -> Column:
    """The table as one literal, whatever its length."""
    return F.map_from_arrays(F.lit(list(factors)), F.lit([float(x) for x in factors.values()]))


class Mixture:
    """Raked factors: of sources in a table (mix_source, a), of languages and topics in dicts; and the copies per weight."""

    def __init__(self, sources: DataFrame, languages: dict, topics: dict, scale: float, gap: float):
        self.sources, self.languages, self.topics, self.scale, self.gap = sources, languages, topics, scale, gap

    def sample(self, described_docs: DataFrame, seed: int = 11) -> DataFrame:
        """Adds weight (raked tokens per token), keep_p (expected copies), copies and kept (any copy).

        floor(keep_p) copies are certain; one more is drawn by a hash of doc_id and text, so a rerun agrees.
        """
        docs = described_docs.join(self.sources, "mix_source", "left")
        weight = F.coalesce(F.col("a") * _factor("mix_lang", self.languages) * _factor("mix_topic", self.topics), F.lit(0.0))
        place = F.xxhash64(F.lit(seed), "doc_id", "text")
        u = F.shiftrightunsigned(place, 11).cast("double") / F.lit(float(1 << 53))
        docs = docs.withColumn("weight", weight).drop("a")
        docs = docs.withColumn("keep_p", F.col("weight") * self.scale)
        whole = F.floor("keep_p")
        docs = docs.withColumn("copies", whole + (u < F.col("keep_p") - whole).cast("long"))
        return docs.withColumn("kept", F.col("copies") > 0)


def rake(cells: DataFrame, budget: float, source_power: float, lang_power: float, topic_power: float, rounds: int = 100, tolerance: float = 1e-6, targets: dict[str, dict] | None = None) -> Mixture:
    """Rake cells (mix_source, mix_lang, mix_topic, tokens) to the given targets, and others in proportion to powers of the marginals.

    Rounds end when no language or topic is off by more than tolerance of all tokens (sources match exactly in each round), or
    after `rounds`; gap tells how far the last was off, and so whether the targets can be met together. targets: shares by "source", "lang" and "topic". budget: the tokens of the sample, copies included, as a share of all tokens.
    """
    by_source = cells.groupBy("mix_source").agg(F.sum("tokens").alias("n"), F.collect_list(F.struct("mix_lang", "mix_topic", "tokens")).alias("cells"))
    by_source = store(by_source, "mixture")
    flat = by_source.select("mix_source", "n", F.explode("cells").alias("c")).select("mix_source", "n", "c.*")
    matrix = {(r.mix_lang, r.mix_topic): r.w for r in flat.groupBy("mix_lang", "mix_topic").agg(F.sum("tokens").alias("w")).collect()}
    given = targets or {}
    named = {k: float(x) for k, x in given.get("source", {}).items()}
    raised = F.pow(F.when(F.col("mix_source").isin(list(named)) | (F.col("n") == 0), None).otherwise(F.col("n")), F.lit(source_power))
    held = F.sum(F.when(F.col("mix_source").isin(list(named)) & (F.col("n") > 0), F.element_at(_map(named), F.col("mix_source")))) if named else F.lit(None)
    total = by_source.agg(F.sum("n"), F.sum(raised), held).first()
    tokens, others = total[0] or 0, total[1] or 0.0
    lang_n, topic_n = {}, {}
    for (lang, at), w in matrix.items():
        lang_n[lang] = lang_n.get(lang, 0) + w
        topic_n[at] = topic_n.get(at, 0) + w
    lang_goal, topic_goal = shares(lang_n, lang_power, given.get("lang")), shares(topic_n, topic_power, given.get("topic"))
    languages, topics = dict.fromkeys(lang_n, 1.0), dict.fromkeys(topic_n, 1.0)
    if not tokens:
        return Mixture(by_source.select("mix_source", F.lit(0.0).alias("a")), languages, topics, 0.0, 0.0)
    # what the table lacks of its targets counts in the gap, and the sample keeps its size
    rest = max(0.0, 1 - sum(named.values())) if others else 0.0
    present = (total[2] or 0.0) + rest
    missing = max(1 - present, 0.0) if named else 0.0
    share = (F.coalesce(raised / (others or 1.0) * rest, F.lit(0.0)) + (F.coalesce(F.element_at(_map(named), F.col("mix_source")), F.lit(0.0)) if named else F.lit(0.0))) / (present or 1.0) * tokens

    def source_factors() -> Column:
        each = F.transform("cells", lambda c: c["tokens"] * F.element_at(lang_map, c["mix_lang"]) * F.element_at(topic_map, c["mix_topic"]))
        mass = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
        return F.when(mass > 0, share / mass).otherwise(0.0)

    gaps = []
    for _ in range(rounds):
        lang_map, topic_map = _map(languages), _map(topics)
        scaled = by_source.select(source_factors().alias("a"), F.explode("cells").alias("c"))
        rows = scaled.groupBy("c.mix_lang", "c.mix_topic").agg(F.sum(F.col("a") * F.col("c.tokens")).alias("w")).collect()
        m = {(r.mix_lang, r.mix_topic): r.w for r in rows}
        lang_sum, topic_sum = dict.fromkeys(languages, 0.0), dict.fromkeys(topics, 0.0)
        for (lang, at), w in m.items():
            lang_sum[lang] += w * languages[lang] * topics[at]
            topic_sum[at] += w * languages[lang] * topics[at]
        off = [lang_sum.get(k, 0.0) - x * tokens for k, x in lang_goal.items()] + [topic_sum.get(k, 0.0) - x * tokens for k, x in topic_goal.items()]
        gaps.append(max([abs(x) / tokens for x in off] + [missing]))
        # targets that can't be met together come no nearer
        if gaps[-1] <= tolerance or (len(gaps) > 10 and gaps[-1] > 0.98 * gaps[-11]):
            break
        # the matrix of this round serves both short vectors until they agree with it
        for _ in range(20):
            held = dict.fromkeys(languages, 0.0)
            for (g, k), w in m.items():
                held[g] += w * topics[k]
            languages = {g: lang_goal[g] * tokens / x if x else 0.0 for g, x in held.items()}
            held = dict.fromkeys(topics, 0.0)
            for (g, k), w in m.items():
                held[k] += w * languages[g]
            topics = {k: topic_goal[k] * tokens / x if x else 0.0 for k, x in held.items()}
    sources = store(by_source.select("mix_source", source_factors().alias("a")), "mixture-factors")
    # the last step met the sources' targets, which add up to all tokens
    return Mixture(sources, languages, topics, budget, gaps[-1])


def mix(docs: DataFrame, budget: float = 0.7, source_power: float = 0.7, lang_power: float = 0.7, topic_power: float = 0.9, targets: dict[str, dict] | None = None) -> DataFrame:
    """docs with mix_source, mix_lang, mix_topic, mix_tokens, weight, keep_p, copies, kept and mix_gap.

    docs: doc_id, text, lang, source and any other columns (columns of the names above are replaced). targets: shares of tokens by value, as
    {"source": {...}, "lang": {...}, "topic": {...}}; values that aren't named share the rest in proportion to their tokens to the given power, and so do
    all values of a margin without targets. mix_gap double: the largest difference of a margin from its target, as a share of all tokens; it
    stays above 1e-6 where targets can't be met together, or name values that have no tokens. A null source or language is a value
    of its own, `und`. The driver holds one
    number for each pair of language and topic. Texts without words have no tokens: they weigh nothing in the margins, and get the expected copies of
    their cell (none, if no text with words shares it). Rows with equal doc_id and text share one fate. An empty table gives no rows.
    """
    clash = ["mix_source", "mix_lang", "mix_topic", "mix_tokens", "weight", "keep_p", "copies", "kept", "mix_gap", "a"]
    rows = described(docs.drop(*clash))
    # tasks add up their own cells before they send, so a hot source costs no more than others
    cells = rows.groupBy("mix_source", "mix_lang", "mix_topic").agg(F.sum("mix_tokens").alias("tokens"))
    mixture = rake(cells, budget, source_power, lang_power, topic_power, targets=targets)
    return mixture.sample(rows).withColumn("mix_gap", F.lit(float(mixture.gap)))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", F.round("weight", 6).alias("weight"), F.round("keep_p", 6).alias("keep_p"), "copies", "kept")
