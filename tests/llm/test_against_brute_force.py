"""The ten operators and the pipeline against plain Python on small tables, and on rows that are odd in every way."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evgraph.llm import adaptive_scan, bpe_chunks, components, language_id, mixing, ngram_join, quality_rules, registry, ring_sharding, substring_dedup, suffix_dedup, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
WORD = rb"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").persist()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, shared passages, special tokens, columns with clashing names."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdéfß") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, other = text(90), text(70)
    texts = [None, "", " \n\t ", "ab", "a " * 4000, "x" * 3000, "x" * 3000, shared, shared, f"{text(30)} {shared} {text(25)}", f"{text(10)}\n{shared}", other, other + " z", "y " + other, "日本語 " * 80, "1 2 3", f"a <|endoftext|> b {shared}", text(30_000)]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None) for i, t in enumerate(texts)]
    rows += [rows[7], rows[4], (None, shared, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ["key", "h1", "bucket", "n", "score", "windows", "a", "weight", "shard", "rank", "rest", "parts", "component", "kept", "toxic"]
    return df.withColumns({c: F.lit("clash") for c in clash}).withColumn("n_chars", F.length("text").cast("long")).persist()


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def distinct_docs(df):
    """Texts by id; rows that repeat one count once, and a null id is one below all others."""
    out = {}
    for i, t in rows_of(df):
        out[-1 if i is None else i] = t or out.get(-1 if i is None else i) or ""
    return out


@pytest.fixture(params=["docs", "odd"])
def table(request):
    df = request.getfixturevalue(request.param)
    return df if request.param == "docs" else df.filter("doc_id is not null")


def test_substring_dedup(table):
    got, seen = by_id(substring_dedup.substring_dedup(table)), set()
    for i, text in sorted(distinct_docs(table).items()):
        words = re.findall(WORD, text.encode())
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            if (k := tuple(words[s : s + 20])) in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        assert (got[i].n_words, got[i].n_removed, got[i].text) == (len(words), sum(gone), kept)


@pytest.mark.parametrize("hot", [False, True])
def test_suffix_dedup(table, hot, monkeypatch):
    if hot:  # every suffix group is dealt window by window
        monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 1)
    got, texts = by_id(suffix_dedup.suffix_dedup(table)), {i: t.encode() for i, t in distinct_docs(table).items()}
    seen = Counter(b[x : x + 200] for b in texts.values() for x in range(len(b) - 199))
    for i, b in texts.items():
        gone = np.zeros(len(b) + 1, int)
        for x in range(len(b) - 199):
            if seen[b[x : x + 200]] > 1:
                gone[x : x + 200] = 1
        kept = bytes(np.frombuffer(b, np.uint8)[gone[:-1] == 0])
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept) == (len(b), gone.sum(), kept)
        assert got[i].n_spans == int((np.diff(np.r_[0, gone[:-1]]) == 1).sum())


def test_suffix_dedup_keeps_characters_and_columns(odd):
    out = suffix_dedup.suffix_dedup(odd, whole_characters=True, keep=["lang", "rest", "windows"])
    assert all(bytes(r.kept).decode() is not None and r.rest == "clash" for r in out.collect()) and out.count() == odd.count()


def test_ngram_jaccard(table):
    got, texts = ngram_join.ngram_jaccard(table), distinct_docs(table)
    sets = {}
    for i, t in texts.items():
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t).encode())
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    rows = got.collect()
    assert len(rows) == table.count()
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root(r.doc_id)) for r in rows)


def test_ngram_blocks(docs, monkeypatch):
    """Groups that are larger than a tile give the same classes, however many rounds of representatives they have."""
    want = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard(docs).collect()}
    for block, rounds in ((2, 4), (3, 0), (4, 1)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        assert {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard(docs).collect()} == want


def test_parity_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.r_[a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
        x, y = (np.frombuffer(ngram_join.bitmap(s), np.uint8) for s in (a, b))
        width = min(len(x), len(y))
        differ = int(np.bitwise_count(ngram_join.fold(x, width) ^ ngram_join.fold(y, width)).sum())
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) // 2


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: root(i) for a, b in pairs if a != b for i in (a, b)}


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_bpe(docs, odd, vocabulary):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    for table in (docs, odd):
        rows = bpe_chunks.bpe_encode(table, vocabulary).collect()
        assert len(rows) == table.count()
        texts = distinct_docs(table.filter("doc_id is not null"))
        for r in rows:
            if r.doc_id is None:
                continue
            ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_joins_are_exact(vocabulary):
    """Any cut into chunks joins to the ids of the whole."""
    code, rng = bpe_chunks.bpe(vocabulary), random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", "  ", "\n", "'s", "'", "ll", "é", "1", ".", "日", "the ", "re", "\t", " ", "!"]) for _ in range(rng.randint(1, 80)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randint(0, 5))))
        parts = [text[a:b].encode() for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if a < b]
        ids = bpe_chunks.join_chunks(code, parts, [bpe_chunks.core(code, p) for p in parts])
        assert ids.tolist() == code.full(text.encode()).tolist() and code.decode(ids) == text


def test_quality(docs, odd):
    for table in (docs, odd.filter("doc_id is not null")):
        got, texts = by_id(quality_rules.quality(table)), distinct_docs(table)
        for i, t in texts.items():
            words = re.findall(r"[^\x20\x09-\x0D]+", t)
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            seen = Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
            cover = [0] * len(words)
            for j in range(len(words) - 7):
                if seen[tuple(words[j : j + 8])] > 1:
                    cover[j : j + 8] = [1] * 8
            failed = len(words) < 20 or 100 * sum(cover) > 30 * len(words)
            r = got[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(cover), failed)
            assert not (r.kept and failed)


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_ring(docs, odd, slack):
    for table in (docs, odd, docs.limit(0), docs.limit(3)):
        rows = ring_sharding.ring_shards(table, slack=slack).collect()
        n = table.count()
        assert len(rows) == n
        sizes = Counter(r.shard for r in rows)
        for s, m in sizes.items():
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(m))
        if slack == 0:
            assert all(m in (n // 8, n // 8 + 1) for m in sizes.values())
        else:
            assert max(sizes.values(), default=0) <= n * 1.25 / 8 + 2
        want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows_of(table))
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_ring_moves_little(docs):
    a = {r.doc_id: r.shard for r in ring_sharding.ring_shards(docs, 8, slack=0.25).collect()}
    b = {r.doc_id: r.shard for r in ring_sharding.ring_shards(docs, 9, slack=0.25).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.5 * len(a)


def test_mixing_meets_targets(docs, odd):
    rows = mixing.mix(docs, budget=0.5).collect()
    total = sum(r.mix_tokens for r in rows)
    for column, power in (("mix_source", 0.7), ("mix_lang", 0.7), ("mix_topic", 0.9)):
        plain, raked = Counter(), Counter()
        for r in rows:
            plain[r[column]] += r.mix_tokens
            raked[r[column]] += r.mix_tokens * r.weight
        goal = {k: n**power for k, n in plain.items()}
        assert all(abs(raked[k] / total - goal[k] / sum(goal.values())) < 2e-3 for k in plain)
    assert abs(sum(r.mix_tokens * r.keep_p for r in rows) / total - 0.5) < 0.01
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(docs.limit(0)).count() == 0


def test_language(docs, odd):
    rows = language_id.language_id(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held) and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in language_id.language_id(odd).collect()}
    assert len(got) == odd.select("doc_id").distinct().count()
    assert all(got[i].lang_pred == "und" for i in (0, 1, 2, 15)) and got[7].lang_pred == "en"
    assert language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0
    assert language_id.language_id(docs.limit(0)).count() == 0


def test_temperature_and_penalty():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    logits = np.c_[1 - y, y] * 6.0 + rng.normal(size=(4000, 2)) * 6
    t = language_id.temperature(logits, y)
    assert t > 2
    rows = [(np.array([int(c), 5]), np.array([1.0, 0.1], np.float32), int(c)) for c in rng.integers(0, 2, 500)]
    w, _ = language_id.ftrl(rows, 2, 16)
    assert (w[6:] == 0).all() and w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]


def test_toxicity(spark, docs, odd):
    # the smallest tables hold few toxic labels, so toxic words are planted
    rng = random.Random(4)
    bad = ["wretchful", "scumble", "vilefoot", "grimetongue"]
    rows = []
    for i, (_, t) in enumerate(rows_of(docs) * 3):
        words, toxic = (t or "").split()[:200], i % 4 == 0
        for _ in range(6 if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, df).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert sum(got[i].predicted == y for i, _, y in held) > 0.9 * len(held)
    none = df.select("doc_id", F.lit(None).cast("int").alias("toxic"))
    assert toxicity.toxicity(odd, none).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(odd, df).count() == odd.count() and toxicity.toxicity(df.limit(0), df).count() == 0


def test_neighbours(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = v.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in adaptive_scan.neighbours(v, v.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append(r)
    found = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        mine = sorted(got[ids[i]], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - s[list(ids).index(r.vec_id)]) < 1e-9 for r in mine)
        found += len({r.vec_id for r in mine} & set(want.tolist()))
    assert found >= 0.9 * 20 * len(got)


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (None, [1.0, 1.0])] + [(20 + i, [0.5, 0.5]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "list", "shard", "n")})
    out = adaptive_scan.neighbours(v, v.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(by) == [0, 20, 40, 60] and by[0] == list(range(20, 40)) and by[20] == [0, *range(21, 40)] and by[60] == [0, *range(20, 39)]
    assert adaptive_scan.neighbours(v.limit(0), v.limit(0)).count() == 0


def test_empty_tables(docs, vocabulary):
    none = docs.limit(0)
    for f in (substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, ngram_join.ngram_jaccard, quality_rules.quality, lambda d: bpe_chunks.bpe_encode(d, vocabulary)):
        assert f(none).count() == 0


def test_null_ids_stay(odd, vocabulary):
    nulls = odd.filter("doc_id is null").count()
    for f in (substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, ngram_join.ngram_jaccard, quality_rules.quality, ring_sharding.ring_shards, lambda d: bpe_chunks.bpe_encode(d, vocabulary)):
        assert f(odd).filter("doc_id is null").count() == nulls


def test_pipeline_stages(spark, odd, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert labels.count()
    for table in (docs, odd.select(docs.columns), docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, DATA).persist()
            if name != "encoding":
                assert out.columns == docs.columns
                now = out
            if name == "near_duplicates":
                assert ngram_join.ngram_jaccard(out).filter("component_id <> doc_id").count() == 0
            if name == "repeated_strings":
                assert out.filter("n_chars <> length(text)").count() == 0
        assert out.count() == now.count()


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and all(len(r.ids) == 2 * r.n_tokens for r in rows)


def test_registry():
    assert [k.split("_")[0] for k in registry.queries()] == [f"op{i}" for i in range(1, 14)]


def test_chunks_depend_on_their_document_alone(docs, odd):
    """The same text is cut alike alone and among others; else chunks asked for and chunks encoded differ."""
    import pyarrow as pa

    from evgraph.llm.text import slices

    texts = [t or "" for _, t in rows_of(docs)] + [t or "" for _, t in rows_of(odd)]

    def cut(batch, **limit):
        out = []
        for s in slices(pa.array(batch), **limit):
            a, b, doc = bpe_chunks.chunk_edges(s)
            for i in range(s.rows):
                mine = doc == i
                assert b"".join(s.data[x:y].tobytes() for x, y in zip(a[mine], b[mine], strict=True)) == s.text(i)
                out.append([(x - s.offsets[i], y - s.offsets[i]) for x, y in zip(a[mine].tolist(), b[mine].tolist(), strict=True)])
        return out

    assert cut(texts) == cut(texts, limit=1) == cut(texts[::-1])[::-1]
