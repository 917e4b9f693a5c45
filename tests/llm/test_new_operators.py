"""Token alignment, periodic runs and SimHash classes against plain Python, on the smallest tables and on odd rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evgraph.llm import periodic_runs, registry, simhash_partitions, token_alignment

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
WORD = rb"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").persist()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, periodic words, special tokens, columns with clashing names."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdéfß") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(200).split()
    near = [" ".join(w if rng.random() > 0.01 else word() for w in base) for _ in range(40)]
    loops = [" ".join(rng.choice("ab") for _ in range(n)) for n in range(1, 60)]
    loops += [" ".join((rng.choices("abc", k=q) * 9)[: rng.randint(3 * q, 9 * q)] + [word()] + rng.choices("xy", k=4) * 5) for q in range(1, 30)]
    texts = [None, "", " \n\t ", "ab", "a " * 4000, "x" * 3000, "A b  C\n", "a B c", "a▁b", "日本語 " * 80, "a <|endoftext|> </s> <s> b", "<0x41> \x00 \x7f", "é ﬁ   　 z", text(20_000), *near, *loops]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[20], (7, "another text of the same id", None, None), (None, texts[20], None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = ["key", "words", "g", "a", "p", "runs", "n", "fingerprint", "component", "node", "label", "least", "a_ids", "pair", "best"]
    return df.withColumns({c: F.lit("clash") for c in clash}).persist()


@pytest.fixture(params=["docs", "odd"])
def table(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


def words_of(text):
    return [w.decode() for w in re.findall(WORD, (text or "").encode())]


def test_token_alignment(table, paths, spark):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a_model.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    as_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

    def ends(tokens):
        return np.cumsum([len(t) for t in tokens]).tolist()

    found, count = [], Counter()
    for i, text in rows_of(table):
        groups = []
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False)
            a_ids, a_bytes = a.ids, [bytes(as_byte[c] for c in a_model.id_to_token(k)) for k in a.ids]
            b_ids = b_model.encode(text)
            b_bytes = [bytes([int(b_model.id_to_piece(k)[3:5], 16)]) if b_model.is_byte(k) else b_model.id_to_piece(k).replace("▁", " ").encode() for k in b_ids]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                end_a, end_b = ends(a_bytes), ends(b_bytes)
                both, x, y = sorted(set(end_a) & set(end_b)), 0, 0
                for e in both:
                    x2, y2 = end_a.index(e, x) + 1, end_b.index(e, y) + 1
                    groups.append((a_ids[x:x2], b_ids[y:y2]))
                    x, y = x2, y2
                assert (x, y) == (len(a_ids), len(b_ids))
        links = [(g[0][-1], g[1][-1]) for g in groups]
        count.update(links)
        found.append((i, groups, links))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = Counter()
    for i, groups, links in found:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        n_a, n_b = sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        want[(i, n_a, n_b, len(groups), len(links), n_a + n_b - len(groups), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest)] += 1
    aligned = token_alignment.align(table, *paths).persist()
    got = token_alignment.link_digests(aligned, *paths)
    assert multiset(got) == want
    pairs = {(r.a_id, r.b_id): (r.n, r.best) for r in token_alignment.pair_counts(aligned, *paths).collect()}
    assert pairs == {k: (n, n == most[k[1]]) for k, n in count.items()}


def test_gallop_and_ranges():
    rng = np.random.default_rng(1)
    for n, m in ((0, 0), (0, 5), (5, 0), (1, 1), (3, 900), (900, 3), (400, 500)):
        a, b = (np.sort(rng.choice(2000, k, replace=False)) + 1 for k in (n, m))
        if n and m:
            a[-1] = b[-1] = 3000
        low = np.zeros(n, np.int64)
        assert (token_alignment.gallop(a, b, low, low + m) == np.searchsorted(b, a)).all()
        x, y = token_alignment.common_ends(a, b, np.array([0, n]), np.array([0, m]))
        assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        if n and m:
            first, after = token_alignment.overlap_ranges(a, b)
            spans_b = list(zip([0, *b[:-1].tolist()], b.tolist(), strict=True))
            for k, (s, e) in enumerate(zip([0, *a[:-1].tolist()], a.tolist(), strict=True)):
                hit = [j for j, (u, v) in enumerate(spans_b) if u < e and s < v]
                assert (first[k], after[k]) == (hit[0], hit[-1] + 1)


def brute_runs(words, least=6, times=4):
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(least, times * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(words, found):
    gone = set()
    for s, length, q in found:
        gone.update(range(s + q, s + length))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_periodic_runs(table):
    want = Counter()
    for i, text in rows_of(table):
        words = words_of(text)
        found = brute_runs(words) if len(words) < 3000 else [(0, 4000, 1)] if words[0] == "a" else []
        want[(i, len(words), tuple(found), brute_kept(words, found))] += 1
    got = periodic_runs.periodic_runs(table)
    assert Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.text) for r in got.collect()) == want


def test_short_words_have_many_runs(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices("ab", k=rng.randint(0, 120)))) for k in range(300)] + [(k, " ".join((rng.choices("ab", k=rng.randint(1, 9)) * 40)[: rng.randint(5, 80)])) for k in range(300, 500)]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == brute_runs(t.split()) for k, t in rows) and sum(map(len, got.values())) > 300
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), times=3)


def test_planted_runs(spark):
    want = {}
    for i, text in rows_of(spark.read.parquet(f"{DATA}/documents.parquet")):
        words = words_of(text)
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        found = brute_runs(words)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        row = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want[i] = (i, len(found), *row, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(brute_kept(words, found).encode()).hexdigest())
    got = {r.doc_id: tuple(r) for r in periodic_runs.op12_periodic_runs(spark, DATA).collect()}
    assert got == want and sum(r[1] > 0 for r in want.values()) > 5


def test_planting_odd_rows(odd):
    rows = periodic_runs.planted(odd.select("doc_id", "text", "g", "words", "a", "p")).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in rows_of(odd))
    texts = dict(r for r in rows_of(odd) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10)
    assert all(texts[r.doc_id] == r.text for r in rows if r.doc_id in texts and r.doc_id != 7)


def brute_simhash(text):
    from xxhash import xxh64_intdigest

    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    """The number of each fingerprint's component."""
    fps, label = np.array(sorted(fps), np.uint64), {}
    left = list(range(len(fps)))
    while left:
        front, name = [left.pop(0)], len(label)
        while front:
            i = front.pop()
            label[int(fps[i])] = name
            near = [j for j in left if int(np.bitwise_count(fps[i] ^ fps[j])) <= radius]
            left = [j for j in left if j not in set(near)]
            front += near
    return label


@pytest.mark.parametrize("cell, block", [(256, 2048), (1, 2048), (1, 3), (2, 8)])
def test_simhash(table, cell, block, monkeypatch):
    monkeypatch.setattr(simhash_partitions, "CELL", cell)
    monkeypatch.setattr(simhash_partitions, "BLOCK", block)
    rows = [(i, brute_simhash(t)) for i, t in rows_of(table)]
    label, least = brute_components({f for _, f in rows}), {}
    for i, f in rows:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    want = Counter((i, f - (1 << 64) if f >> 63 else f, least.get(label[f])) for i, f in rows)
    assert multiset(simhash_partitions.simhash_near_duplicates(table)) == want


@pytest.mark.parametrize("cell, block, radius", [(256, 2048, 4), (4, 2048, 4), (4, 16, 4), (256, 2048, 1), (8, 32, 6)])
def test_hamming_classes_of_correlated_bits(spark, cell, block, radius, monkeypatch):
    """Bits that copy one another, clusters of near values and scattered ones."""
    monkeypatch.setattr(simhash_partitions, "CELL", cell)
    monkeypatch.setattr(simhash_partitions, "BLOCK", block)
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(12):
        centre = int(rng.integers(0, 1 << 63)) & ~0xFFFF | (0xFFFF if rng.random() < 0.5 else 0)
        for _ in range(40):
            fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)))
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 300)} | {0, (1 << 64) - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.fingerprint: r.label for r in simhash_partitions.hamming_classes(spark.createDataFrame([(f,) for f in signed], "fingerprint long"), radius).collect()}
    want = brute_components(fps, radius)
    by_label = {}
    for f, s in zip(fps, signed, strict=True):
        by_label.setdefault(got[s], set()).add(want[f])
    assert len(got) == len(fps) and all(len(x) == 1 for x in by_label.values()) and len(by_label) == len(set(want.values()))


def test_thresholds_cover_the_radius():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    for m in range(2, 6):
        groups = simhash_partitions.group_bits(simhash_partitions._bits(fp).astype(np.int64).T @ simhash_partitions._bits(fp).astype(np.int64), 500, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        histograms = [[np.bincount(simhash_partitions.project(fp, part).astype(np.int64), minlength=256) for part in simhash_partitions.eights(g)] for g in groups]
        layout = simhash_partitions.Layout(groups, histograms, 4)
        thresholds, work = layout.allocate(fp)
        cost = layout.costs(fp)
        assert (thresholds.sum(axis=0) == 4 - m + 1).all() and (thresholds >= -1).all()
        assert np.allclose(work, sum(cost[g, thresholds[g] + 1, np.arange(500)] for g in range(m)))


def test_empty_tables(docs, paths):
    none = docs.limit(0)
    assert simhash_partitions.simhash_near_duplicates(none).count() == 0
    assert periodic_runs.periodic_runs(none).count() == 0
    assert token_alignment.link_digests(token_alignment.align(none, *paths), *paths).count() == 0


def test_registered(spark):
    known = registry.queries()
    assert [k.split("_")[0] for k in known] == [f"op{i}" for i in range(1, 14)]
    rows = known["op13_simhash_partitions"](spark, DATA).collect()
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id <= r.doc_id for r in rows)
    digests = known["op11_token_alignment"](spark, DATA).collect()
    assert len(digests) == len(rows) and all(r.n_links == r.n_groups and r.n_best <= r.n_links for r in digests)
