import random
import tracemalloc

import numpy as np
import pytest

from cipherlake.llm import near_dedup as N


def check(df, rows, **kw):
    want = N.brute_force(rows, kw["width"], kw["percent"])
    got = N.near_duplicates(df, **kw).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_documents(docs, width, percent):
    check(docs, [(r.doc_id, r.text) for r in docs.collect()], width=width, percent=percent)


def family(n, seed, edits):
    """A base text and copies of it with a few words replaced, so that many pairs lie around the threshold."""
    rng = random.Random(seed)
    base = [f"b{seed}_{k}" for k in range(120)]
    out = []
    for _ in range(n):
        t = base[:]
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = f"r{rng.random()}"
        out.append(" ".join(t))
    return out


def test_crowds_and_strays(spark):
    """Families larger than a leaf go through crowds: pivots, then strays against all."""
    texts = family(150, 1, 6) + family(60, 2, 9) + [f"lone text number {k} of its own kind" for k in range(40)] + family(30, 1, 3)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows, width=3, percent=85, leaf=8)


def test_recall_over_shared_lines(spark):
    """One common line puts all texts into common nodes without making them similar."""
    rng = random.Random(9)
    rows = [(k, "the very same first line of all " + " ".join(f"w{rng.randrange(50)}" for _ in range(30))) for k in range(200)]
    rows += [(1000 + k, rows[k][1] + " tail") for k in range(50)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, width=3, percent=85, leaf=8)


@pytest.mark.parametrize("own,cost", [(16, 256.0), (40, 4.0), (90, 4.0), (90, 256.0)])
def test_recall_over_boilerplate(spark, own, cost, monkeypatch):
    """Pages of a few sites: alike by their site's template only, at some 0.8, 0.6 and 0.35, but for planted near copies."""
    monkeypatch.setattr(N, "NODE_COST", cost)
    rng = random.Random(own)
    sites = [[f"t{s}_{k}" for k in range(100)] for s in range(3)]
    rows = []
    for k in range(330):
        words = sites[k % 3] + [f"p{k}_{j}" for j in range(own)]
        rows.append((k, " ".join(words)))
        if k % 11 == 0:
            words[rng.randrange(len(words))] = "edited"
            rows.append((1000 + k, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, width=3, percent=85, leaf=8)


def test_average_similarity_decides_depth(spark, monkeypatch):
    """A node whose sets have little in common on average branches until it is small; alike ones are dense at once."""
    rng = random.Random(3)
    loose = [(k, " ".join(["one", "line", "for", "all"] + [f"w{rng.randrange(400)}" for _ in range(8)])) for k in range(300)]
    tight = [(k, t) for k, t in enumerate(family(100, 7, 3))]
    monkeypatch.setattr(N, "NODE_COST", 4.0)
    for rows, any_dense in ((loose, False), (tight, True)):
        join = N.Join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 1 - 1e-6, 8)
        join.sets = join.save(N.sketch(join.docs, 3).groupBy("set_key", "n_shingles", "sig").agg(N.F.min("doc_id").alias("rep_doc")))
        leaves, dense = join.paths()
        assert (dense is not None) == any_dense and leaves.groupBy("node").count().agg(N.F.max("count")).first()[0] <= 8


def test_nasty_rows(nasty, nothing):
    rows = N.near_duplicates(nasty, width=3, percent=85).collect()
    assert len(rows) == nasty.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.component_id == 1 for i in (1, 2, 3) for r in by[i])
    assert {r.component_id for r in by[None]} == {1, None}
    assert all(by[i][0].n_shingles == 0 and by[i][0].component_id == i for i in (4, 5, 6))
    assert by[8][0].component_id == 7 and by[11][0].component_id == 10 and by[9][0].n_shingles == 1
    assert N.near_duplicates(nothing).count() == 0 and N.drop_near_copies(nasty).columns == nasty.columns
    assert N.near_duplicates(nasty.where("doc_id IN (4, 5)")).count() == 2


def keyed_by_row(texts, ids, width, percent):
    """Components by brute force over row numbers, mapped to the smallest id that is not null."""
    found = N.brute_force(list(enumerate(texts)), width, percent)
    least: dict = {}
    for k, (_, root) in found.items():
        if ids[k] is not None:
            least[root] = min(least.get(root, ids[k]), ids[k])
    return sorted(((ids[k], least.get(root)) for k, (_, root) in found.items()), key=str)


def test_null_ids_link(spark):
    """A null id's text may be the only one of its set, and the only way between two others."""
    words = [f"w{k}" for k in range(200)]
    near = " ".join(words[:199] + ["x"])
    far = lambda k: " ".join([f"l{j}" for j in range(k)] + words[k:])
    for texts, ids in (([" ".join(words), near], [5, None]), ([far(0), far(20), far(40)], [5, None, 9]), ([far(20), far(0), far(40)], [5, None, 9]), ([far(0), far(20), far(40)], [5, 7, 9])):
        rows = list(zip(ids, texts, strict=True))
        got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=80).collect()
        assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == keyed_by_row(texts, ids, 3, 80)
        assert all(r.component_id == 5 for r in got)


def test_block_compare_is_exact():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    got = set(N.similar(sets, sets, 70))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            common = len(np.intersect1d(a, b))
            assert ((i, j) in got) == (100 * common >= 70 * (len(a) + len(b) - common))


def test_cells_lose_no_likely_link(monkeypatch):
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.97], rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)])) for _ in range(60)]
    want = set(N.similar(sets, sets, 85))
    for few in (0, 10**6):
        monkeypatch.setattr(N, "FEW_PAIRS", few)
        assert set(N.similar_in_cell(sets, sets, 85, N.least_agreement(0.85, 1e-7))) == want and len(want) > 60
    assert N.similar_in_cell([], sets, 85, 30) == []


def test_tree_counts():
    assert N.trees_for(0.85, 1 - 1e-6) == 8 and N.trees_for(0.8, 1 - 1e-6) == 10
    assert N.least_agreement(0.85, 1e-7) < N.N_HASH * 0.85


def test_long_chain_is_one_component(spark):
    rows = [(k, " ".join(f"c{j}" for j in range(k, k + 40))) for k in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, width=3, percent=85)


def test_full_sets_meet_only_where_a_link_is_likely(spark, monkeypatch):
    """Texts of one template, alike at some 0.25: of a crowd, only planted near copies reach the comparison of full sets."""
    met = []
    inner = N.Join.block_links

    def counted(self, left, right, shingles):
        met.append((left.count(), right.count()))
        plan = spark.createDataFrame([(b"k", 1)], "set_key binary, x int").hint("merge").join(shingles, "set_key")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
        return inner(self, left, right, shingles)

    monkeypatch.setattr(N.Join, "block_links", counted)
    monkeypatch.setattr(N, "NODE_COST", 10.0**9)
    rows = []
    for k in range(300):
        words = [f"t{j}" for j in range(100)] + [f"p{k}_{j}" for j in range(150)]
        rows.append((k, " ".join(words)))
        if k % 30 == 0:
            rows.append((1000 + k, " ".join([*words, "edited"])))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, width=3, percent=85, leaf=8)
    assert met[0][1] > 250 and len(met) > 1 and all(a + b <= 60 for a, b in met[1:]), met
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("shingles_")]


def test_a_full_cell_takes_little_memory():
    """Blocks of short sets, nearly all of them linked: the comparison holds no matrix of all pairs, and gives out a forest."""
    rng = np.random.default_rng(7)
    base = rng.integers(1, 2**63, 100).astype(np.uint64)

    def copies(n):
        out = [np.where(rng.random(100) < 0.05, rng.integers(1, 2**63, 100).astype(np.uint64), base) for _ in range(n)]
        return [np.unique(s) for s in out]

    left, right = copies(N.LEFT_TOKENS // 100), copies(N.RIGHT_TOKENS // 100)
    tracemalloc.start()
    kept = N.forest(N.links_in_cell(left, right, 80, N.least_agreement(0.8, 1e-7)), len(left), len(right))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20, peak
    assert len(left) <= len(kept) < len(left) + len(right)


def test_forest_keeps_components(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(N, "AREA", 64)
    monkeypatch.setattr(N, "MATRIX", 128)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(50)]
    for few in (0, 10**6):
        monkeypatch.setattr(N, "FEW_PAIRS", few)
        every = N.similar_in_cell(sets[:20], sets[20:], 30, 0)
        assert set(every) == set(N.similar(sets[:20], sets[20:], 30)) and len(every) > 20
        kept = N.forest(N.links_in_cell(sets[:20], sets[20:], 30, 0), 20, 30)

        def components(pairs):
            label = list(range(50))
            for i, j in pairs:
                a, b = label[i], label[20 + j]
                label = [a if x == b else x for x in label]
            return [[x == y for y in label] for x in label]

        assert set(kept) <= set(every) and len(kept) < 50 and components(kept) == components(every)
