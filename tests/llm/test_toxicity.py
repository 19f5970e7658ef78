import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherlake.llm import toxicity as X


def exact_marginals(e, trans):
    weights = {}
    for path in itertools.product((0, 1), repeat=len(e)):
        w = np.exp(sum(x for x, s in zip(e, path) if s))
        for a, b in zip(path, path[1:]):
            w *= trans[a, b]
        weights[path] = w
    z = sum(weights.values())
    return [sum(w for p, w in weights.items() if p[k]) / z for k in range(len(e))]


def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = rng.integers(0, 7, 5)
        e, trans = rng.normal(0, 2, counts.sum()), np.exp(rng.normal(0, 1, (2, 2)))
        got, at = X.chain(e, counts, trans), 0
        for c in counts:
            assert np.allclose(got[at : at + c], exact_marginals(e[at : at + c], trans))
            at += c


def log_likelihood(w, ids, labels, counts):
    trans, total, at = X.transitions(w), 0.0, 0
    for c in counts:
        e = w[:-4][ids[at : at + c]].sum(axis=1) + w[-4]
        score = lambda path, e=e: sum(x for x, s in zip(e, path) if s) + sum(np.log(trans[a, b]) for a, b in zip(path, path[1:]))
        total += score([int(x) for x in labels[at : at + c]]) - np.log(sum(np.exp(score(p)) for p in itertools.product((0, 1), repeat=int(c))))
        at += c
    return total


def test_gradient_is_that_of_the_likelihood():
    """Pair chances against enumeration, and the gradient against differences of the enumerated likelihood."""
    rng = np.random.default_rng(4)
    for _ in range(5):
        counts = rng.integers(0, 6, 4)
        n = int(counts.sum())
        ids, labels = rng.integers(0, 5, (n, 2)), rng.integers(0, 2, n).astype(np.float32)
        w = rng.normal(0, 1, 5 + 4)
        got = X.loss_gradient(w, ids, labels, counts)
        for k in range(len(w)):
            up, down = w.copy(), w.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            slope = (log_likelihood(up, ids, labels, counts) - log_likelihood(down, ids, labels, counts)) / 2e-5
            assert abs(got[k] + slope) < 1e-4, k


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "x" * 100) for k in range(50)] + [(k, "x" * 100) for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    take = lambda rows, size: len(X.training_rows(docs, labels, rows, size, 3, 1, "text", "doc_id")[0])
    assert take(10, 1 << 20) == 10 and take(1000, 700) == 7 and take(1000, 1 << 20) <= 50


def planted(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(300)]
    bad = ["awful", "vileness", "vilest", "rotten", "nasty"]
    texts, toxic = [], []
    for k in range(n):
        t = rng.choice(words, rng.integers(5, 60)).tolist()
        toxic.append(int(k % 4 == 0))
        if toxic[-1]:
            for _ in range(rng.integers(2, 6)):
                t[rng.integers(0, len(t))] = str(rng.choice(bad))
        texts.append(" ".join(t))
    return texts, toxic


@pytest.fixture(scope="module")
def trained(spark):
    texts, toxic = planted(1500, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    return docs, labels, toxic, X.train(docs, labels, max_rows=900)


def test_held_out_accuracy(trained):
    docs, _, toxic, model = trained
    rows = X.score_toxicity(docs, model).withColumn("held", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1).where("held").collect()
    right = [(r.score >= 0.7) == bool(toxic[r.doc_id]) for r in rows]
    assert len(rows) > 300 and np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_spans_are_the_words(trained, spark):
    model = trained[3]
    df = spark.createDataFrame([(1, "é漢 w1 rotten w2 w3 awful, nasty w4")], "doc_id long, text string")
    text, row = "é漢 w1 rotten w2 w3 awful, nasty w4", X.score_toxicity(df, model).first()
    assert [text[s.start : s.end] for s in row.spans] == ["rotten", "awful, nasty"]


def test_batches_dont_matter(trained):
    docs, _, _, model = trained
    a = {r.doc_id: r.score for r in X.score_toxicity(docs, model, chunk_bytes=500).collect()}
    b = {r.doc_id: r.score for r in X.score_toxicity(docs.repartition(3), model).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_training_reads_only_its_folds(trained):
    docs, labels, _, _ = trained
    texts, _ = X.training_rows(docs, labels, 100, 1 << 30, 3, 1, "text", "doc_id")
    assert len(texts) == 100
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = X.training_rows(docs, labels, 10_000, 1 << 30, 3, 1, "text", "doc_id"), X.training_rows(docs, flipped, 10_000, 1 << 30, 3, 1, "text", "doc_id")
    assert a[0] == b[0] and (a[1] == b[1]).all()


def test_nasty_rows(trained, nasty, nothing, spark):
    model = trained[3]
    rows = X.score_toxicity(nasty, model).collect()
    assert len(rows) == nasty.count() and all(r.score < 0.7 for r in rows)
    assert X.score_toxicity(nothing, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.drop_toxic(nasty, none).columns == nasty.columns and X.drop_toxic(nasty, none).count() == nasty.count()
    ones = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    assert X.score_toxicity(nasty, X.train(nasty, ones)).count() == nasty.count()
