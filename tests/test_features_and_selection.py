"""Features, selections, audits and walks against plain Python on small tables with nulls, repeats and ties."""

import random
import statistics
import tempfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evgraph.operators import audit, features, forecast, panel, selection, structure, walks

KINDS = ["base", "patent", "trial"]


def sets(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def cutoffs(spark):
    return forecast.cutoff_table(spark, [(2001, "train"), (2003, "test")], 2, 1999)


@pytest.mark.parametrize("k", [1, 3, 100])
def test_pruned_unit_graph_equals_all_pairs(spark, k):
    rng = random.Random(k)
    rows = [(f"u{i:03d}", f"a{rng.randint(0, 9)}", rng.choice([f"b{rng.randint(0, 9)}", f"a{rng.randint(0, 9)}x"])) for i in range(220)]
    rows += [(f"t{i}", "a1", "b1") for i in range(9)] + [("s1", "b1", "a1")]
    units = spark.createDataFrame(rows, "unit_id string, entity_a string, entity_b string")
    for low, high in ((2, 2000), (2, 18), (5, 25)):
        assert sets(forecast.top_shared_entity_edges(units, low, high, k)) == sets(forecast.shared_entity_edges(units, low, high, k))


def test_selection_modes(spark):
    rng = random.Random(1)
    ids = {k: [f"{k[0]}{i}" for i in range(12)] for k in ("base", "patent", "trial", "project")}
    pairs = [("patent", "base"), ("base", "trial"), ("patent", "project"), ("base", "project"), ("trial", "project")]
    links = [(a, rng.choice(ids[a]), b, rng.choice(ids[b])) for a, b in pairs for _ in range(14)]
    seeds = [(k, x) for k in ids for x in ids[k][:2]] + [("base", "b0"), (None, "z"), ("trial", None)]
    near = defaultdict(set)
    for a, x, b, y in links:
        near[a, x, b].add(y)
        near[b, y, a].add(x)
    given = {k: {x for kind, x in seeds if kind == k and x} for k in ids}
    step = lambda start, kind, to: {y for x in start for y in near[kind, x, to]}
    conservative = {
        "patent": given["patent"] | step(given["base"], "base", "patent"), "base": given["base"] | step(given["patent"], "patent", "base") | step(given["trial"], "trial", "base"),
        "trial": given["trial"] | step(given["base"], "base", "trial"),
    }
    wide = {"patent": given["patent"] | step(given["base"], "base", "patent") | step(given["project"], "project", "patent")}
    wide["base"] = given["base"] | step(wide["patent"], "patent", "base") | step(given["trial"], "trial", "base") | step(given["project"], "project", "base")
    wide["trial"] = given["trial"] | step(wide["base"], "base", "trial")
    for chosen in (conservative, wide):
        chosen["project"] = given["project"].union(*(step(chosen[k], k, "project") for k in ("patent", "base", "trial")))
    df = spark.createDataFrame(links, "source_kind string, source_id string, target_kind string, target_id string")
    start = spark.createDataFrame(seeds, "kind string, id string")
    for mode, want in (("seed_only", given), ("conservative", conservative), ("expanded", wide)):
        got = selection.select_carriers(start, df, mode).filter("id is not null").collect()
        assert sorted((r.kind, r.id) for r in got) == sorted((k, x) for k in want for x in want[k])
    with pytest.raises(ValueError):
        selection.select_carriers(start, df, "all")
    assert selection.select_carriers(start.limit(0), df.limit(0), "expanded").count() == 0


def test_year_filter_counts_each_case(spark):
    candidates = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), ("e",), (None,)], "id string")
    nodes = spark.createDataFrame([("a", 2000), ("a", 2001), ("b", None), ("c", 1990), ("d", 2002), ("x", 2000), (None, 2000)], "id string, year int")
    kept, accounts, histogram = selection.filter_by_year(candidates, nodes, 2000, 2001)
    assert {r.id for r in kept.collect()} == {"a"} and kept.count() == 1
    assert tuple(accounts.first()) == (5, 4, 1, 1, 2, 2, 1)
    assert sets(histogram) == {(2000, 1), (2001, 1)}


def test_project_links(spark):
    links = spark.createDataFrame([("base", "1", "P1", 2000), ("base", "1", " P1 ", None), ("base", "2", " ", 2001), ("trial", "1", "P2", 2001), ("base", "9", "P9", 2000)], "kind string, carrier_id string, project_id string, year int")
    selected = spark.createDataFrame([("base", "1"), ("base", "2"), ("base", "2"), ("patent", "1")], "kind string, id string")
    summary, years = selection.project_links(links, selected)
    assert sets(summary) == {("base", 2, 3, 1), ("patent", 1, 0, 0)} and sets(years) == {("base", 2000, 1), ("base", 2001, 1)}


def test_context_dedup(spark):
    e = spark.createDataFrame([("1", "x", 2000, "b"), (" 1 ", "x", 1990, "a"), ("1", "", 2000, "a"), (None, "x", 2000, "a"), ("2", "y", None, None)], "s string, t string, y int, other string")
    assert sets(selection.dedup_context(e, ["s", "t"], "y")) == {("1", "x", 2, 1990, 2000, 1990, "a"), ("2", "y", 1, None, None, None, None)}


def test_year_ranges(spark, cutoffs):
    rows = spark.createDataFrame([("u", 1999), ("u", 2005), ("v", None)], "unit_id string, year int")
    assert panel.year_range(rows) == (1999, 2005) and panel.year_range(rows, first=2001) == (2001, 2005) and panel.year_range(rows, 1, 2) == (1, 2)
    for bad in (lambda: panel.year_range(rows.filter("year is null")), lambda: panel.year_range(rows, first=2010)):
        with pytest.raises(ValueError):
            bad()
    r = forecast.year_checks(rows, cutoffs, 1999).first()
    assert (r.history_covered, r.future_covered, r.last_future_end) == (True, True, 2005)
    r = forecast.year_checks(rows, cutoffs, 1990).first()
    assert not r.history_covered


def test_carrier_structure(spark, cutoffs):
    rng = random.Random(5)
    node = lambda: rng.choice([*(f"c{i}" for i in range(8)), *(f"e{i}" for i in range(5)), None])
    kind = lambda x: None if x is None else ("odd" if x == "e0" else "entity" if x[0] == "e" else KINDS[int(x[1]) % 3])
    rows = [(a, kind(a), b, kind(b), rng.choice([None, *range(1998, 2006)]), rng.choice([None, 0.5, 2.0]), rng.choice("xyz")) for a, b in ((node(), node()) for _ in range(150))]
    links = spark.createDataFrame(rows, "source_id string, source_kind string, target_id string, target_kind string, year int, weight double, edge_type string")
    carriers = spark.createDataFrame([(f"c{i}",) for i in range(7)], "carrier_id string")
    kinds = [*KINDS, "entity"]
    got = {(r.node_id, r.cutoff): r.asDict() for r in structure.node_structure(structure.carrier_edges(links, carriers, kinds), cutoffs, kinds).collect()}
    seen = [(a, b, kb, y, w, t) for a, ka, b, kb, y, w, t in rows] + [(b, a, ka, y, w, t) for a, ka, b, kb, y, w, t in rows]
    want = {}
    for c in (2001, 2003):
        for n in {f"c{i}" for i in range(7)}:
            mine = [s for s in seen if s[0] == n and s[1] and s[1] != n and s[3] and s[3] <= c]
            if mine:
                count = Counter(s[2] if s[2] in kinds else "unknown" for s in mine)
                want[n, c] = [len(mine), sum(1.0 if s[4] is None else s[4] for s in mine), len({s[1] for s in mine}), len({s[5] for s in mine}), *(count[k] for k in (*kinds, "unknown"))]
    assert {k: [r[m] for m in structure.metrics(kinds)] for k, r in got.items()} == want
    evidence = spark.createDataFrame([("u", "c1", "base", 2000), ("u", "c1", "base", 2002), ("u", "c2", "trial", 2003), ("u", "c7", None, 2001), ("u", "c3", "base", None)], "unit_id string, carrier_id string, carrier_type string, year int")
    pooled = {r.cutoff: r for r in structure.pooled_structure(structure.support(evidence, cutoffs), structure.node_structure(structure.carrier_edges(links, carriers, kinds), cutoffs, kinds), KINDS, kinds).collect()}
    for c, held in ((2001, ["c1", "c7"]), (2003, ["c1", "c2", "c7"])):
        degree = [want.get((x, c), [0])[0] for x in held]
        r = pooled[c]
        assert (r.structure_support_count, r.structure_degree_sum, r.structure_degree_max, r.structure_support_other_count) == (len(held), sum(degree), max(degree), 1)
        assert r.structure_degree_std == pytest.approx(statistics.pstdev(degree), abs=1e-4) and r.structure_coverage_count == sum((x, c) in want for x in held)
    assert set(pooled[2001].asDict()) == {"unit_id", "cutoff", *structure.structure_columns(KINDS, kinds)}


def test_diffusion(spark, cutoffs):
    years = [(f"n{i:02d}", 2000, i + 1) for i in range(15)] + [("late", 2003, 50), ("n00", 2001, 4), ("n01", 1996, 7)]
    by_year = spark.createDataFrame([(u, y, 2 * n, n, n, 0) for u, y, n in years], "unit_id string, year int, carriers long, base_carriers long, patent_carriers long, trial_carriers long")
    state = structure.cutoff_state(by_year, cutoffs, ["patent", "trial"])
    got = {(r.unit_id, r.cutoff): r for r in state.collect()}
    assert len(got) == 16 * 2 and (got["late", 2001].history_total, got["late", 2003].recent_total) == (0, 100)
    assert (got["n00", 2003].recent_total, got["n00", 2003].growth_total, got["n01", 2001].growth_base) == (8, 6, 2 - 7)
    edges = spark.createDataFrame([("u", f"n{i:02d}", 1.0 + i, 1) for i in range(15)] + [("u", "late", 3.0, 2), ("u", "stranger", 1.0, 1)], "src string, dst string, edge_weight double, shared long")
    r = {x.cutoff: x for x in structure.diffusion_features(edges, state).collect()}
    recent = [i + 1 for i in range(15)]
    recent[0] += 4
    assert r[2001].diffusion_neighbor_count == 15 and r[2001].diffusion_recent_patent_sum == sum(recent)
    assert r[2001].diffusion_top10_recent_patent_mean == pytest.approx(statistics.mean(sorted(recent)[-10:])) and r[2001].diffusion_history_trial_any_fraction == 0
    assert r[2001].diffusion_recent_patent_weighted_mean == pytest.approx(sum((1 + i) * x for i, x in enumerate(recent)) / sum(range(1, 16)), abs=1e-6)
    both = {x.cutoff: x for x in structure.diffusion_features(edges, state, inactive=True).collect()}
    assert (both[2001].diffusion_neighbor_count, both[2001].diffusion_active_neighbor_count) == (16, 15) and r[2003].diffusion_neighbor_count == 16


def test_undated_and_edge_derived(spark):
    rows = [("u", "k1", "base", 2000, 1.0), ("u", "k2", "trial", None, 2.0), ("u", "k2", "trial", None, 0.5), ("v", "k3", "base", 2001, 4.0)]
    e = spark.createDataFrame(rows, "unit_id string, carrier_key string, carrier_type string, year int, pair_weight double")
    assert sets(panel.undated(e, KINDS)) == {("u", 1, 2.5, 0, 0.0, 0, 0.0, 1, 2.5)}
    r = {x.unit_id: x for x in features.edge_derived(e, KINDS).collect()}
    assert (r["u"].edge_rows, r["u"].edge_carriers, r["u"].undated_rows, r["u"].dated_fraction, r["u"].year_span, r["u"].trial_carriers_of_edges) == (3, 2, 2, round(1 / 3, 6), 0, 1)


def test_static_features_fill_numbers_only(spark):
    units = spark.createDataFrame([("u", 1, None), ("v", None, "x")], "unit_id string, n long, name string")
    more = spark.createDataFrame([("u", 9, 2.5)], "unit_id string, n long, w double")
    assert sets(features.static_features(units, more)) == {("u", 1, None, 2.5), ("v", 0, "x", 0.0)}


def test_snapshots(spark, cutoffs):
    rng = random.Random(2)
    ids = sorted({f"ku_{rng.getrandbits(64):016x}" for _ in range(300)})
    units = spark.createDataFrame([(u, rng.choice(["a", "b", None])) for u in ids], "unit_id string, kind string")
    nodes = features.encoded(features.index_by(units, "unit_id", 5), ["kind"])
    rows = nodes.collect()
    assert sorted((r.node_idx, r.unit_id) for r in rows) == list(enumerate(ids)) and {(r.kind, r.kind_code) for r in rows} == {("a", 1), ("b", 2), (None, 0)}
    x = spark.createDataFrame([(ids[0], 2001, "train", 3, 0.3, 1, True), (ids[1], 2003, "test", None, -1.0, 0, None)], "unit_id string, cutoff int, split string, n long, heat_t double, label_t int, eligible_t boolean")
    snap = features.snapshots(nodes, x, cutoffs, ["n"], ["kind"], ["t"])
    check = {r.cutoff: r for r in features.snapshot_check(snap, nodes, ["t"]).collect()}
    assert all(r.complete and r.rows == len(ids) for r in check.values()) and (check[2001].eligible_t, check[2001].positive_t, check[2003].eligible_t) == (1, 1, 0)
    assert not features.snapshot_check(snap.filter("node_idx <> 5"), nodes, ["t"]).filter("complete").count()
    path = tempfile.mkdtemp(prefix="snapshots-") + "/rows"
    features.write_snapshots(snap, path)
    again = spark.read.parquet(f"{path}/split=test/cutoff=2003")
    assert again.count() == len(ids) and again.filter("node_idx = 1").first().log_heat_t == 0


def test_variants(spark):
    df = spark.createDataFrame([("u", 1, 0.0, 2.0, "x"), ("v", 0, 1.0, None, "y")], "unit_id string, b long, s double, d double, kind string")
    numeric, kinds = {"base": ["b"], "structure": ["s"], "diffusion": ["d"]}, {"base": ["kind"]}
    assert features.variant(df, "base_diffusion", numeric, kinds, ["unit_id"]).columns == ["unit_id", "b", "d", "kind"]
    got = {r.variant: tuple(r)[1:] for r in features.variant_summary(df, numeric, kinds).collect()}
    assert got["base_structure_diffusion"] == (3, 1, 2, 3) and got["structure_only"] == (1, 0, 2, 1)


def test_link_profile_and_id_checks(spark):
    df = spark.createDataFrame([(1, 2, "A B"), (1, 2, "AB"), (1, 3, "a"), (2, 2, None), (2, 2, "X-Y")], "a_id long, b_key long, code string")
    assert sets(audit.link_profile(df, "t")) == {("t", 5, "a_id|b_key", "a_id", "b_key", 2)}
    assert audit.link_profile(df.select("code"), "t") is None and audit.link_profile(df.select("a_id"), "my_links") is not None
    assert sets(audit.normalization(df, "code", "c")) == {("c", 5, 4, "ids not fully normalized")}
    assert sets(audit.normalization(df, "none", "c")) == {("c", None, None, "missing column")}
    assert sets(audit.ungrounded(df, "code", "c", " x-y".strip())) == {("c", 5, 1, "ungrounded ids present")}


def test_walks_with_hubs(spark):
    hub = [("hub", f"n{i}", 1.0) for i in range(500)] + [(f"n{i}", "hub", 1.0) for i in range(500)] + [("hub", "end", 1500.0), ("lost", "hub", 0.0)]
    e = spark.createDataFrame(hub, "src string, dst string, weight double")
    starts = spark.createDataFrame([("hub",), ("n1",), ("end",), ("lost",)], "node string")
    got = walks.hub_walks(e, starts, 4, per_node=400, seed=7, per_block=8)
    rows = {r.walk_id: r.path for r in got.collect()}
    assert len(rows) == 4 * 400 and rows == {r.walk_id: r.path for r in walks.hub_walks(e, starts, 4, per_node=400, seed=7, per_block=8).collect()}
    known = {(a, b) for a, b, w in hub if w}
    assert all(step in known for p in rows.values() for step in zip(p, p[1:], strict=False))
    assert all((len(p) == 4) == (p[-1] != "end" and p[0] != "lost") or p[-1] == "end" for p in rows.values())
    first = [p[1] for p in rows.values() if p[0] == "hub"]
    assert 0.68 < first.count("end") / len(first) < 0.82 and len(set(first)) > 60


def test_biased_walks_follow_their_law(spark):
    weights = {("a", "b"): 1.0, ("a", "c"): 3.0, ("b", "c"): 2.0, ("b", "d"): 4.0, ("d", "e"): 1.0}
    both = [(x, y, w) for (x, y), w in weights.items()] + [(y, x, w) for (x, y), w in weights.items()]
    e = spark.createDataFrame(both + [("a", "b", 0.0), ("c", "end", 1.0)], "src string, dst string, weight double")
    w = {(x, y): v for x, y, v in both} | {("c", "end"): 1.0}
    starts = spark.createDataFrame([("a",), ("end",)], "node string")
    back, out = 4.0, 0.25
    run = lambda: {r.walk_id: r.path for r in walks.biased_walks(e, starts, 4, per_node=6000, back=back, out=out, seed=5, per_block=2).collect()}
    rows = run()
    assert len(rows) == 12000 and rows == run()

    def law(was, at):
        f = {y: v * (1 / back if y == was else 1.0 if (was, y) in w else 1 / out) if was else v for (x, y), v in w.items() if x == at}
        return {y: v / sum(f.values()) for y, v in f.items()}

    want, front = {}, {("a",): 1.0}
    for _ in range(3):
        nxt = {}
        for p, chance in front.items():
            options = law(p[-2] if len(p) > 1 else None, p[-1])
            if not options:
                want[p] = chance
            for y, v in options.items():
                nxt[p + (y,)] = nxt.get(p + (y,), 0) + chance * v
        front = nxt
    want |= front
    got = Counter(tuple(p) for p in rows.values() if p[0] == "a")
    assert set(got) <= set(want) and all(p == ["end"] for p in rows.values() if p[0] == "end")
    assert all(abs(got[p] / 6000 - c) < 5 * (c * (1 - c) / 6000) ** 0.5 + 1e-3 for p, c in want.items())
    assert walks.biased_walks(e.limit(0), starts.limit(0), 3).count() == 0
    assert {tuple(r.path) for r in walks.biased_walks(e.limit(0), starts, 3).collect()} == {("a",), ("end",)}
    with pytest.raises(ValueError):
        walks.biased_walks(e, starts, 3, back=0.0)


def test_metapath_walks_take_each_edge_alike(spark):
    wide = spark.range(400).select(F.lit("s").alias("src"), F.concat(F.lit("m"), F.col("id") % 40).alias("dst"))
    to = spark.createDataFrame([(f"m{i}", f"t{i % 2}") for i in range(30)], "src string, dst string")
    starts = spark.createDataFrame([("s",), ("gone",), (None,)], "node string")
    paths = [r.path for r in walks.metapath_walks([wide, to], starts, per_node=4000, seed=3, per_block=8).collect()]
    # three quarters of the middle nodes go on; repeated edges count once
    assert abs(len(paths) - 3000) < 150 and all(p[0] == "s" and p[2] == f"t{int(p[1][1:]) % 2}" for p in paths)
    counts = Counter(p[1] for p in paths)
    assert len(counts) == 30 and max(counts.values()) < 160 and min(counts.values()) > 50


def test_blocks_of_a_line_are_bounded(spark):
    e = spark.range(3000).select(F.lit("hub").alias("src"), F.concat(F.lit("n"), "id").alias("dst"), (F.col("id") % 7 + 1).cast("double").alias("weight"))
    lines = walks.edge_lines(e, per_block=32)
    assert lines.groupBy("block").count().agg(F.max("count")).first()[0] < 200 and lines.select("dst").distinct().count() == 3000
    total = sum(i % 7 + 1 for i in range(3000))
    ends = lines.groupBy("dst").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("low").collect()
    assert ends[0].low == 0 and ends[-1].high == pytest.approx(total) and all(a.high == pytest.approx(b.low) for a, b in zip(ends, ends[1:], strict=False))


def test_walks_meet_one_row_of_edges_a_step_and_hubs_change_nothing(spark):
    hub = [("hub", f"n{i}", float(i % 3 + 1)) for i in range(700)] + [(f"n{i}", "hub", 1.0) for i in range(700)] + [(f"n{i}", f"n{i + 1}", 2.0) for i in range(600)] + [("n5", "end", 1.0), ("n5", "end", 2.0)]
    e = spark.createDataFrame(hub, "src string, dst string, weight double")
    starts = spark.createDataFrame([("hub",), ("n1",), ("n5",), ("end",)], "node string")
    small, plain = walks.packed_lines(e, per_block=8, wide=100), walks.packed_lines(e)
    assert plain.hubs is None and [r.at for r in small.hubs.collect()] == ["hub"]
    assert plain.rows.count() == 701 and small.rows.filter("at = 'hub'").count() > 4
    assert small.rows.agg(F.max(F.size("cells"))).first()[0] < 30
    for run in (walks.hub_walks, lambda *a, **k: walks.biased_walks(*a, back=3.0, out=0.5, **k)):
        one, two = ({r.walk_id: r.path for r in run(e, starts, 5, per_node=300, seed=2, **k).collect()} for k in ({}, {"per_block": 8, "wide": 100}))
        assert one == two and len(one) == 1200
    # the walks' plan shuffles the walks, not the edges: one exchange for each step
    plan = walks.hub_walks(e, starts, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
