import random

import numpy as np
import pytest

from cipherlake.llm import jaccard_join as J
from cipherlake.llm._text import U64


def check(df, rows, **kw):
    want = J.brute_force(rows, kw.get("width", 5), kw.get("percent", 80))
    got = J.jaccard_join(df, **kw).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    return want


def test_documents(docs):
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        t = base[:]
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = f"r{rng.randrange(10**9)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("short,seed", [(32, 1), (2, 2)])
def test_families_around_the_threshold(spark, short, seed, monkeypatch):
    """Families whose members lie around the threshold to one another and to other families; lists cut into cells."""
    monkeypatch.setattr(J, "SHORT", short)
    if short == 2:
        monkeypatch.setattr(J, "LIST", 8)
        monkeypatch.setattr(J, "STRETCH", 4)
        monkeypatch.setattr(J, "MEMBERS", 7)
    rng = random.Random(seed)
    texts = []
    for f in range(4):
        base = [f"b{f}_{k}" for k in range(150)]
        texts += family(rng, base, 45, 5)
        for cut in (8, 12, 16, 20, 30):
            # Further families that share most of the base, so that only some members are linked across.
            texts += family(rng, base[cut:] + [f"c{f}_{cut}_{k}" for k in range(cut // 2)], 14, 5)
    texts += [f"template of all pages {'lorem ipsum ' * 20} page {k} has {k * k} own words" for k in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, width=seed)


def test_links_between_members_only(spark, monkeypatch):
    """Two leaders apart, linked through one member of each: found from differences alone."""
    calls = []
    inner = J.JaccardJoin.between_families

    def counted(self, *a):
        found = inner(self, *a)
        calls.append(found.count())
        return found

    monkeypatch.setattr(J.JaccardJoin, "between_families", counted)
    base = [f"w{k}" for k in range(1000)]
    step = lambda k: " ".join([f"n{j}" for j in range(k)] + base[k:])
    for a in (0,):
        # Distances that grow along a chain: neighbours are linked, others are not.
        rows = [(k, step(a + 55 * k)) for k in range(12)]
        want = check(spark.createDataFrame(rows, "doc_id long, text string"), rows, width=1)
        assert {c for _, c in want.values()} == {0}
    assert any(calls), calls


def test_null_ids_and_nasty_rows(spark, nasty, nothing):
    got = J.jaccard_join(nasty).collect()
    assert len(got) == nasty.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.component_id == 1 for i in (1, 2, 3) for r in by[i]) and {r.component_id for r in by[None]} == {1, None}
    assert all(by[i][0].n_shingles == 0 and by[i][0].component_id == i for i in (4, 5, 6)) and by[8][0].component_id == 7
    assert J.jaccard_join(nothing).count() == 0 and J.jaccard_join(nasty.where("doc_id IN (4, 5)")).count() == 2
    words = [f"w{k}" for k in range(200)]
    rows = [(5, " ".join(words)), (None, " ".join(words[:199] + ["x"])), (9, " ".join(["y"] + words[1:]))]
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {5}


def test_signed_product():
    rng = np.random.default_rng(3)
    side = lambda n: [(a[:6], a[6:]) for a in (rng.permutation(40)[:12].astype(U64) for _ in range(n))]
    left, right = side(7), side(5)
    value = lambda d: {**{t: 1 for t in d[0].tolist()}, **{t: -1 for t in d[1].tolist()}}
    want = [[sum(v * value(r).get(t, 0) for t, v in value(x).items()) for r in right] for x in left]
    assert J.signed_product(left, right).tolist() == want


def test_lists_make_no_pairs_out_of_reach(spark, monkeypatch):
    """Copies of one text, near to it but not to one another: their lists are long, and hardly make a pair of copies."""
    made = []
    inner = J.JaccardJoin.overlaps

    def counted(self, pairs, shingles, with_difference):
        if not with_difference:
            made.append(pairs.count())
        return inner(self, pairs, shingles, with_difference)

    monkeypatch.setattr(J.JaccardJoin, "overlaps", counted)
    rng = random.Random(4)
    rows = [(k, " ".join([f"b{j}" for j in range(60)] + [f"o{k}_{rng.randrange(10**9)}" for _ in range(40)])) for k in range(120)]
    rows.append((500, rows[7][1] + " end"))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, width=1)
    assert sum(made) <= 120, made


def test_parities_bound_the_difference():
    rng = np.random.default_rng(8)
    for n in (1, 20, 300, 3000):
        a, b = (np.unique(rng.integers(0, 4 * n, n).astype(U64)) for _ in range(2))
        differ = sum(int(x).bit_count() for x in np.frombuffer(J.parities(a), np.uint8) ^ np.frombuffer(J.parities(b), np.uint8))
        assert differ <= len(np.setxor1d(a, b)) and (differ - len(np.setxor1d(a, b))) % 2 == 0


def test_wide_parities_tell_unlike_sets(spark, monkeypatch):
    """Texts that share rare shingles, yet are far from similar: their full sets are not fetched, however long they are."""
    met = []
    inner = J.JaccardJoin.overlaps

    def counted(self, pairs, shingles, with_difference):
        met.append(pairs.count())
        return inner(self, pairs, shingles, with_difference)

    monkeypatch.setattr(J.JaccardJoin, "overlaps", counted)
    rows = [(k, " ".join([f"s{k // 2}_{j}" for j in range(1200)] + [f"o{k}_{j}" for j in range(800)])) for k in range(20)]
    rows.append((100, rows[3][1] + " end"))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, width=1)
    assert 1 <= sum(met) <= 2, met


def test_wide_parities_bound_the_difference():
    rng = np.random.default_rng(9)
    for n, m in ((1, 1), (20, 700), (3000, 300), (3000, 2900)):
        a, b = (np.unique(rng.integers(0, 4 * n, k).astype(U64)) for k in (n, m))
        differ = J.fewest_differences(J.wide_parities(a), J.wide_parities(b))
        assert differ <= len(np.setxor1d(a, b)) and (differ - len(np.setxor1d(a, b))) % 2 == 0


def test_only_wanted_texts_are_shuffled(spark):
    """Texts go on by a bitmap of the wanted digests: all that are wanted, and hardly another."""
    import hashlib

    from cipherlake.llm import near_dedup as N

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(3000)] + [(None, "text 7"), (5, "")], "doc_id long, text string")
    wanted = ["", *(f"text {k}" for k in range(0, 3000, 100))]
    keys = spark.createDataFrame([(hashlib.md5(t.encode()).hexdigest(),) for t in wanted], "rep_text string")
    found = {r.text for r in N.with_marked_texts(docs, N.marks(keys, len(wanted))).collect()}
    assert set(wanted) <= found and len(found) < len(wanted) + 10
    assert N.with_marked_texts(docs, N.marks(keys.limit(0), 0)).count() == 0
