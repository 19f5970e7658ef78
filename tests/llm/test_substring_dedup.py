import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cipherlake.llm import suffix_arrays as S
from cipherlake.llm import substring_dedup as D


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array_and_prefixes(values):
    t = np.array([*values, 0], dtype=np.int16)
    sa = S.suffix_array(t, 5)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    if len(t) > 1:
        shared, before = S.permuted_prefixes(t, sa)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
            n = 0
            while t[a + n] == t[b + n]:
                n += 1
            assert shared[b] == n and before[b] == a


def test_both_ways_of_inducing(monkeypatch):
    rng = random.Random(1)
    t = np.array([rng.choice((1, 2)) for _ in range(3000)] + [1, 2] * 400 + [3] * 200 + [0], dtype=np.int16)
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    for run in (0, 1, 100, 10_000):
        monkeypatch.setattr(S, "MAX_RUN", run)
        assert S.suffix_array(t, 4).tolist() == want


def test_a_whole_shard_recurses(monkeypatch, docs):
    """2 MB of documents: leftmost-smaller substrings are sorted by recursion on strings of their names, at every size."""
    data = b"\n".join((r.text or "").encode() for r in docs.collect())
    data = (data * (1 + (2 << 20) // len(data)))[: 1 << 20] + bytes(random.Random(3).choices(range(97, 123), k=1 << 20))
    t = np.append(np.frombuffer(data, np.uint8).astype(np.int16) + 2, 0).astype(np.int16)
    sizes, whole = [], S.suffix_array

    def spy(values, n_values):
        sizes.append(len(values))
        return whole(values, n_values)

    monkeypatch.setattr(S, "suffix_array", spy)
    sa = spy(t, 258)
    assert len(sizes) >= 4 and sizes[1] > 100_000 and all(b <= a / 2 + 1 for a, b in zip(sizes, sizes[1:]))
    assert np.array_equal(np.sort(sa), np.arange(len(t)))
    shared, before = S.permuted_prefixes(t, sa)
    for i in np.random.default_rng(5).integers(1, len(t), 500).tolist():
        a, n = int(before[i]), int(shared[i])
        if a >= 0:
            assert np.array_equal(t[a : a + n], t[i : i + n]) and t[a + n] < t[i + n]


def check(spark, rows, length, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = D.brute_force(rows, length)
    got = D.substring_dedup(df, length, **kw).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], texts[r.doc_id]
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


@pytest.mark.parametrize("group", [256, 1])
@pytest.mark.parametrize("length", [8, 50])
def test_planted_passages(spark, length, group):
    rng = random.Random(length)
    words = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [words(length + k) for k in (-1, 0, 1, 40)]
    rows = [(k, words(rng.randint(0, 200)) + (rng.choice(shared) if k % 2 else "") + words(rng.randint(0, 120))) for k in range(60)]
    rows += [(100, "z" * (3 * length)), (101, "xy" * length), (102, None), (103, ""), (104, words(30) * 8), (105, rows[1][1]), (106, rows[1][1]), (107, shared[1])]
    check(spark, rows, length, group=group)


def test_documents(spark, docs):
    check(spark, [(r.doc_id, r.text) for r in docs.limit(60).collect()], 400)


def test_nasty_rows(nasty, nothing):
    rows = D.substring_dedup(nasty, 400).collect()
    assert len(rows) == nasty.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[7].n_removed == by[7].n_bytes and by[8].n_bytes - by[8].n_removed == len(" end")
    assert by[14].n_removed == 3000 and by[15].n_removed == 3000 and by[9].n_removed == 0
    assert D.substring_dedup(nothing).count() == 0


def test_null_ids_are_fetched_by_content(spark):
    text = "".join(chr(97 + (k * k) % 26) for k in range(900))
    rows = [(None, "head " + text), (None, text + " tail"), (5, "other")]
    got = sorted((r.n_bytes, r.n_removed) for r in D.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect())
    assert got == [(5, 0), (905, 905), (905, 900)] or got[1][1] >= 900


def test_hot_passage_edges_split(spark):
    """A passage in very many texts, at different places and after different letters: its keys split level by level."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage, short = letters(150), letters(60)
    rows = [(k, letters(rng.randint(0, 40)) + passage + letters(rng.randint(0, 40))) for k in range(120)]
    rows += [(1000 + k, letters(5) + short + "q" * k) for k in range(80)]
    rows += [(2000 + k, "a" * (100 + k)) for k in range(30)]
    for group in (4, 25):
        check(spark, rows, 100, group=group)
