import random

import pytest

from cipherlake.llm import spelling as S
from cipherlake.llm._frames import Workspace


def check(df, rows, **kw):
    got = S.spelling_variants(df, **kw).collect()
    kw.pop("bucket_rows", None)
    want = S.brute_force(rows, **kw)
    assert len(got) == len(want)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    return want


def test_documents(docs):
    part = docs.where("doc_id < 15")
    want = check(part, [(r.doc_id, r.text) for r in part.collect()])
    assert any(form for form, *_ in want.values())


@pytest.mark.parametrize("bucket_rows", [2, 12, 1024])
def test_variants_of_few_words(spark, bucket_rows):
    """Dense neighbourhoods, repeated letters and very long words, with buckets split down to one open place."""
    rng = random.Random(bucket_rows)
    base = ["aaaaaaa", "abababab", "spelling", "Überprüfung", "aaaaaaaaa", "x" * 500, "wordwordw"]
    words = []
    for _ in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = [rng.choice("abÀÿ")] * rng.choice([0, 1, 2])
        words += ["".join(w)] * rng.choice([1, 2, 3, 25])
    rows = [(k, " ".join(words[k::9])) for k in range(9)]
    want = check(spark.createDataFrame(rows, "doc_id long, text string"), rows, bucket_rows=bucket_rows)
    assert max(n_near for *_, n_near, _ in want.values()) > 5


def test_roots_follow_forms(spark):
    rows = [(1, "abcdefg " * 2 + "abcdefgh " * 30 + "abcdefghi " * 400), (2, "zzzzzzzz, zzzzzzzz; yyyyyyyy yyyyyyyy")]
    want = check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert want["abcdefg"][:2] == ("abcdefgh", "abcdefghi") and want["zzzzzzzz"] == (None, "zzzzzzzz", 2, 0, None)


def test_nasty_rows(nasty, nothing):
    check(nasty, [(r.doc_id, r.text) for r in nasty.collect()])
    assert S.spelling_variants(nothing).count() == 0
    assert S.spelling_variants(nasty.where("text IS NULL")).count() == 0


def test_buckets_stay_small(spark):
    """Words that share a half by the thousand are split by further code points."""
    rows = [(1, " ".join(f"shared{a}{b}{c}{d}" for a in "abcdef" for b in "abcdef" for c in "abcdef" for d in "abcdef") + " ") for _ in range(2)]
    words = S.word_counts(spark.createDataFrame(rows, "doc_id long, text string"), one_in=10**9)
    ws = Workspace(spark, "spelling-test")
    assert words.count() == 6**4
    pairs = S.near_words(words, ws, 64)
    assert pairs.count() == 6**4 * 4 * 5 == pairs.distinct().count()
