"""Top-k, near vectors, passages, Jaccard join and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from embermill.llm import components, jaccard, near_vectors, substrings, topk

from .conftest import DOC, corpus, prose, rows_of

VEC = "vec_id bigint, embedding array<float>, label int"
ODD = [(None, [1.0, 0.0], 1), (900, None, 1), (901, [None, 1.0], 1), (902, [float("nan"), 1.0], 1), (903, [float("inf"), 1.0], 1), (904, [], 1), (905, [0.0, 0.0], 1), (950, [3.0, 4.0, 5.0], 1)]


def vectors(n=300, d=8, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).astype(np.float32)
    x[50:90] = x[0] + r.normal(size=(40, d)).astype(np.float32) * 0.05
    x[90:120] = x[1]
    return [(int(i), v.tolist(), 0) for i, v in enumerate(x)]


# ------------------------------------------------------------------ components


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
def test_forest_keeps_components(edges):
    a, b = (np.array(x, np.int64) for x in zip(*edges))
    u, v = components.forest(a, b)
    assert union(edges) == union(list(zip(u.tolist(), v.tolist())) + [(x, x) for e in edges for x in e])


def union(edges):
    par = {}

    def f(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        a, b = f(a), f(b)
        par[max(a, b)] = min(a, b)
    return {x: f(x) for x in list(par)}


def test_components_of_paths_stars_and_nothing(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(r.randint(2000, 2400), r.randint(2000, 2400)) for _ in range(150)] + [(7, 7)]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(6)
    got = dict(map(tuple, components.components(df).collect()))
    want = union([e for e in edges if e[0] != e[1]])
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ------------------------------------------------------------------ top-k


@pytest.mark.parametrize("seed", [0, 1])
def test_topk_by_brute_force(spark, seed):
    rows = vectors(400, 8, seed)
    df = spark.createDataFrame(rows + ODD + rows[:3], VEC).withColumn("score", F.lit("own"))
    whole = topk.whole_vectors(df)
    got = {}
    for r in topk.top_k(whole, whole.where("vec_id % 10 = 0"), k=5, shard_rows=64, query_rows=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = np.floor(256 * np.array([v for _, v, _ in rows], float)).astype(int)
    for q in range(0, 400, 10):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        assert sorted(got[q]) == [(k + 1, int(i), int(s[i])) for k, i in enumerate(order)]
    assert [q for q in got if q >= 400] == []  # 950 has no partner of its length; others take no part


def test_topk_ties_and_nothing(spark):
    df = spark.createDataFrame([(i, [0.5, 0.5], 0) for i in range(50)], VEC)
    assert [(r["vec_id"]) for r in topk.topk_digest(df).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    assert topk.topk_digest(spark.createDataFrame([], VEC)).count() == 0


def test_threshold_stops_early():
    r = np.random.default_rng(0)
    x = r.integers(-50, 50, (2000, 3)).astype(float)
    x[7] = 300
    ids, s = topk.threshold_topk(x, np.arange(2000), topk.sorted_lists(x), np.array([1.0, 2.0, 3.0]), -1, 1)
    assert ids.tolist() == [7] and s.tolist() == [1800]


# ------------------------------------------------------------------ near vectors


def test_near_vectors_by_brute_force(spark):
    rows = vectors(500, 16)
    extra = [(990, [2.0 * c for c in rows[0][1]], 0), (991, rows[5][1], 0)]
    df = spark.createDataFrame(rows + ODD + extra, VEC).withColumn("kept", F.lit("own")).repartition(4)
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(df, near_vectors.Near(shards=3)).collect()}
    every = rows + extra
    x = np.array([v for _, v, _ in every], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a = x @ x.T >= 0.95
    np.fill_diagonal(a, False)
    names = [i for i, _, _ in every]
    comp = union([(names[i], names[j]) for i, j in zip(*np.nonzero(a))] + [(i, i) for i in names])
    wrong = sum(got[n]["n_links"] != k for n, k in zip(names, a.sum(1)))
    assert wrong <= 0.02 * len(names)
    assert all(got[n]["component_id"] == comp[n] and got[n]["kept"] == (comp[n] == n) for n in names)
    for n in (900, 901, 902, 903, 904, 905):
        assert (got[n]["n_links"], got[n]["component_id"], got[n]["kept"]) == (0, n, True)
    assert got[None]["n_links"] == 0 and len(got) == len(every) + len(ODD)
    assert near_vectors.near_vectors(spark.createDataFrame([], VEC)).count() == 0


def test_audit_leaves_out_a_querys_own_class(monkeypatch):
    class Blind:
        """Finds a point itself at the first width, and all at wider ones."""

        def __init__(self, x, cfg):
            self.x, self.first = x, cfg.beam

        def within(self, q, width, limit):
            sims = q @ self.x.T
            return np.nonzero(sims >= (0.9999 if width <= self.first else limit))

    monkeypatch.setattr(near_vectors, "SmallWorld", Blind)
    cfg = near_vectors.Near(audit=500)
    x = np.eye(400) + 0.0
    x[1] = x[0] + 0.1 * x[2]
    names = np.arange(400)
    i, p = near_vectors.shard_links(x, x, cfg, names, names)
    assert {(a, b) for a, b in zip(i.tolist(), p.tolist()) if a != b} == {(0, 1), (1, 0)}


def test_small_world_recall():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 24))
    q = x[:300] + r.normal(size=(300, 24)) * 0.02
    i, p = near_vectors.shard_links(x, q, near_vectors.Near())
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    truth = unit(q) @ unit(x).T >= 0.95
    assert truth[i, p].all() and len(i) >= 0.95 * truth.sum()


# ------------------------------------------------------------------ passages


def passages(rows):
    texts = {}
    for d, t in rows:
        texts.setdefault((d, t or ""), (t or "").encode().split())
    first = {}
    for (d, _), w in texts.items():
        if d is not None:
            for k in range(len(w) - 12):
                g = tuple(w[k : k + 13])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, t in rows:
        w = texts[d, t or ""]
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if d is not None and first[tuple(w[k : k + 13])] < d:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_by_brute_force(spark, seed, empty):
    rows = corpus(seed)
    r = random.Random(seed)
    loop = prose(r, 13)
    rows += [(500, (loop + " ") * 5, "", "", 0), (501, loop, "", "", 0), (502, loop + " tail", "", "", 0), (501, "another text of the same id " * 4, "", "", 0)]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("own") for c in ("h", "at", "starts", "kept")}).repartition(7)
    got = rows_of(substrings.passages_digest(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == passages([(x[0], x[1]) for x in rows])
    assert substrings.passages_digest(empty).count() == 0


# ------------------------------------------------------------------ Jaccard join


def shingles(t, n=4):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


def near_copies(seed, groups=6, size=25):
    """Groups whose members stray from a base by more and more edits: some pairs link, some just do not."""
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        base = prose(r, r.choice([8, 30, 90, 200])).split()
        for k in range(size):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = prose(r, 1)
            rows.append((len(rows), " ".join(w), "", "", 0))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("percent,n", [(85, 4), (80, 5)])
def test_jaccard_by_brute_force(spark, seed, percent, n):
    rows = corpus(seed) + [(1000 + d, *x) for d, *x in near_copies(seed)]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("own") for c in ("key", "grams", "cluster", "n_shingles")}).repartition(6)
    cfg = jaccard.Join(n=n, percent=percent, block=8)
    got = rows_of(jaccard.jaccard_digest(df, cfg), "doc_id", "n_shingles", "component_id")
    sets = [shingles(x[1], n) for x in rows]
    edges = [(i, i) for i in range(len(rows))]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                edges.append((j, i))
    group = union(edges)
    least = {}
    for i, c in group.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    want = sorted(((x[0], len(s), least.get(group[i]) if s else x[0]) for i, (x, s) in enumerate(zip(rows, sets))), key=repr)
    assert got == want


def test_jaccard_keeps_one_of_each_group(spark, docs, empty):
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect() if r["text"] and r["doc_id"] is not None]
    sets = [shingles(t) for t in texts]
    assert not any(a and b and 100 * len(a & b) >= 85 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert jaccard.jaccard_digest(empty).count() == 0 and jaccard.keep_first(empty).count() == 0


def test_early_bound_covers_partners():
    for size in range(1, 400):
        for percent in (80, 85):
            tested, _ = jaccard.early(np.array([size]), percent)
            for other in range(-(-size * percent // 100), size * 100 // percent + 1):
                _, shown = jaccard.early(np.array([other]), percent)
                assert shown[0] == other or shown[0] >= tested[0] + jaccard.spare(other, percent)


# ------------------------------------------------------------------ near vectors: crowds and odd sizes


def test_near_vectors_crowd_common_vector_and_magnitudes(spark):
    """One group of 2,000 near copies, one vector held by 500 rows, and huge and tiny vectors, over several shards and blocks."""
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 24))
    x[100:2100] = x[100] + r.normal(size=(2000, 24)) * 0.08
    x[2100:2600] = x[2100]
    x[2700] = x[2699] * 1e-170
    x[2701] = x[2699] * 1e170
    clash = ("h1", "h2", "shard", "block", "place", "near", "width", "links", "component", "copies", "d", "v", "task", "kept")
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    df = df.withColumns({c: F.lit("own") for c in clash}).repartition(5)
    got = {g["vec_id"]: g for g in near_vectors.near_vectors(df, near_vectors.Near(shard_rows=900, query_rows=700)).collect()}
    u = near_vectors.unit(x)
    a = u @ u.T >= 0.95
    np.fill_diagonal(a, False)
    comp = union([(int(i), int(j)) for i, j in zip(*np.nonzero(a)) if i < j] + [(i, i) for i in range(3000)])
    links = a.sum(1)
    assert sum(got[i]["n_links"] for i in range(3000)) >= 0.999 * links.sum()
    assert got[2701]["n_links"] == links[2701] >= 2 and got[2100]["n_links"] >= 499
    assert [got[i]["component_id"] for i in range(3000)] == [comp[i] for i in range(3000)]
    assert all(got[i]["kept"] == (comp[i] == i) for i in range(3000))


def test_near_vectors_cost_of_a_crowd_is_its_pairs():
    """A beam stops widening at its crowd: members beyond it are compared with the shard at once."""
    r = np.random.default_rng(6)
    x = near_vectors.unit(r.normal(size=(1, 32)) + r.normal(size=(1500, 32)) * 0.1)
    cfg = near_vectors.Near()
    graph = near_vectors.SmallWorld(x.astype(np.float32), cfg)
    widths = []
    search = graph.search
    graph.search = lambda q, width: widths.append(width) or search(q, width)
    i, p = graph.within(x[:400].astype(np.float32), cfg.beam, 0.9)
    assert max(widths) <= cfg.crowd and len(i) == (x[:400] @ x.T >= 0.9).sum()


def test_a_crowd_widens_no_beam_of_its_shard():
    """Links planted around a crowd's members are found at the first width: queries beside it are compared with the shard, the others are not."""
    r = np.random.default_rng(8)
    center = near_vectors.unit(r.normal(size=(1, 64)))
    x = np.concatenate([near_vectors.unit(center + r.normal(size=(600, 64)) * 0.018), near_vectors.unit(r.normal(size=(4000, 64)))])
    cfg = near_vectors.Near()
    graph = near_vectors.SmallWorld(x.astype(np.float32), cfg)
    assert graph.crowded(0.9499)[:600].mean() > 0.9 and not graph.crowded(0.9499)[600:].any()
    assert near_vectors.audited_width(graph, 0.9499, cfg) == cfg.beam
    q = near_vectors.planted(x[:1200], 0.9501, r)
    links = np.concatenate([np.stack(pair, 1) for pair in near_vectors.verified_links(graph, x, q, cfg.beam, cfg)])
    truth = q @ x.T >= 0.95
    assert truth[links[:, 0], links[:, 1]].all() and len(links) >= 0.999 * truth.sum()
    searched = []
    search = graph.search
    graph.search = lambda q, width: searched.append((len(q), width)) or search(q, width)
    graph.within(x[600:].astype(np.float32), cfg.beam, 0.9499)
    assert searched and max(w for _, w in searched) == cfg.beam and sum(n for n, _ in searched) == 4000


def test_stored_graph_searches_like_the_built_one():
    r = np.random.default_rng(7)
    x = near_vectors.unit(r.normal(size=(900, 12))).astype(np.float32)
    cfg = near_vectors.Near()
    built = near_vectors.SmallWorld(x, cfg)
    levels = np.zeros(900, int)
    for k, member in enumerate(built.members):
        levels[member] = k
    again = near_vectors.SmallWorld.of(x, built.layers[0], [built.layers[k][m] for k, m in enumerate(built.members) if k], levels, cfg)
    for a, b in zip(built.search(x[:50], 16), again.search(x[:50], 16)):
        assert (a == b).all()
    assert near_vectors.audited_width(built, 0.9499, cfg) <= 900


def test_cells_bound_what_a_query_visits():
    """Links at the threshold meet in a cell, though a row asks a few of 60 cells only, and one of two cells asks."""
    r = np.random.default_rng(8)
    cfg = near_vectors.Near()
    x = near_vectors.unit(r.normal(size=(6000, 48)))
    means, margin = near_vectors.pivots_of(x, 60, cfg)
    p = near_vectors.unit(r.normal(size=(2000, 48)))
    q = near_vectors.planted(p, 0.95, r)
    home, row, cell = near_vectors.routes(np.concatenate([p, q]), means, margin)
    assert len(row) <= 6 * len(home)
    asks = set(zip(row.tolist(), cell.tolist()))
    met = [(home[i] == home[i + 2000]) + ((i, home[i + 2000]) in asks) + ((i + 2000, home[i]) in asks) for i in range(2000)]
    assert max(met) == 1 and sum(met) >= 0.97 * 2000


def test_near_vectors_in_cells_and_waves(spark, monkeypatch):
    """Both ends of a link across cells count it, whichever wave finds it; a wave moves a bounded number of rows."""
    r = np.random.default_rng(9)
    x = r.normal(size=(1500, 24))
    x[700:1400] = near_vectors.planted(near_vectors.unit(x[:700]), 0.955, r) * 2
    tags = []
    kept = near_vectors.written_at
    monkeypatch.setattr(near_vectors, "written_at", lambda df, tag: tags.append(tag) or kept(df, tag))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC)
    got = {g["vec_id"]: g for g in near_vectors.near_vectors(df, near_vectors.Near(shard_rows=250, wave_rows=600)).collect()}
    u = near_vectors.unit(x.astype(np.float32).astype(float))
    a = u @ u.T >= 0.95
    np.fill_diagonal(a, False)
    n = np.array([got[i]["n_links"] for i in range(1500)])
    assert (n <= a.sum(1)).all() and n.sum() >= 0.97 * a.sum()
    assert n[:700].sum() == n[700:1400].sum() and tags.count("vector-links") >= 2 and tags.count("vector-graphs") == 3


def test_labels_join():
    label = np.arange(8)
    near_vectors.join_labels(label, np.array([1, 3, 6]), np.array([2, 2, 7]))
    assert label.tolist() == [0, 1, 1, 1, 4, 5, 6, 6]


# ------------------------------------------------------------------ passages: compaction


def test_paths_cover_every_window_once():
    from embermill.llm.shingles import rolling

    r = np.random.default_rng(2)
    h = r.integers(0, 40, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.array([0, 12, 13, 900, 5, 2070])
    cfg = substrings.Passages()
    node, first, size, text, key, _ = substrings.paths_of(h, counts, cfg)
    windows = [s + k for s, n in zip(first.tolist(), size.tolist()) for k in range(n)]
    begins = np.cumsum(counts) - counts
    assert windows == [int(b) + k for b, c in zip(begins, counts) for k in range(max(0, c - 12))]
    assert size.max() <= cfg.window - cfg.seed_words + 1
    # equal keys are equal words, and equal windows have equal nodes
    words = {}
    for s, n, k in zip(first.tolist(), size.tolist(), key.tolist()):
        assert words.setdefault(k, h[s : s + n + 12].tolist()) == h[s : s + n + 12].tolist()
    by_window = {}
    w13 = rolling(h, 13)
    for s, n, k in zip(first.tolist(), size.tolist(), node.tolist()):
        for j in range(n):
            assert by_window.setdefault(int(w13[s + j]), k) == k


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_passages_with_edits_nesting_and_branches(spark, seed):
    """Passages that share parts, stand in each other and differ by a word, over a small vocabulary, by brute force."""
    r = random.Random(seed)
    vocabulary = [prose(r, 1) for _ in range(30)]
    base = [r.choice(vocabulary) for _ in range(300)]
    rows = []
    for i in range(120):
        a, n = r.randrange(250), r.randint(10, 120)
        w = base[a : a + n]
        if r.random() < 0.5 and w:
            w[r.randrange(len(w))] = r.choice(vocabulary)
        text = " ".join([r.choice(vocabulary) for _ in range(r.randint(0, 20))] + w + base[r.randrange(250) :][: r.randint(0, 40)])
        rows.append((i // 2 * 2 if r.random() < 0.1 else i, text, "", "", 0))
    df = spark.createDataFrame(rows, DOC).repartition(6)
    got = rows_of(substrings.passages_digest(df, substrings.Passages(most_bits=16)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == passages([(x[0], x[1]) for x in rows])


# ------------------------------------------------------------------ Jaccard join: filters of a pair


def test_filters_are_intersected_for_each_pair():
    """Every linked pair passes all orders; a pair that shares early shingles under one order alone does not."""
    r = np.random.default_rng(4)
    cfg = jaccard.Join()
    base = [r.choice(5000, 80, replace=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(30)]
    sets = [np.sort(np.concatenate([b[r.permutation(80)[: r.integers(70, 81)]], b[:0]])) for b in base for _ in range(3)]
    sizes, grams = np.array([len(x) for x in sets]), np.concatenate(sets).view(np.int64)
    pair = jaccard.candidates([grams, grams], [sizes, sizes], cfg)
    each = [jaccard.candidates([grams, grams], [sizes, sizes], jaccard.Join(orders=(o,))) for o in cfg.orders]
    assert (pair == (each[0] & each[1])).all() and pair.sum() < min(e.sum() for e in each)
    for i, a in enumerate(map(set, sets)):
        for j, b in enumerate(map(set, sets)):
            if 100 * len(a & b) >= cfg.percent * len(a | b):
                assert pair[i, j]


def test_texts_that_lose_nothing_stay_out_of_the_join(spark):
    """Only documents with spans are shuffled with their text; the others come from a second branch, each once."""
    r = random.Random(4)
    shared = prose(r, 30)
    rows = [(i, prose(r, 40) + (" " + shared if i < 4 else ""), "en", "s", 0) for i in range(40)]
    out = substrings.remove_repeats(spark.createDataFrame(rows + [(None, shared, "en", "s", 0)], DOC))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan
    got = {g["doc_id"]: g["n_removed"] for g in out.collect()}
    assert len(got) == 41 and [i for i in got if got[i]] == [i for i in got if i in (1, 2, 3)] and got[1] == 30
