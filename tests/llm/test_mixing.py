import hashlib
import math
from collections import Counter

from cipherlake.llm.mixing import mix_sources, source_rates


def poisson(rate, u):
    total, k = 0.0, 0
    while rate > 0:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if total >= u or k > rate + 12 * math.sqrt(rate) + 30:
            return k if total >= u else k + 1
        k += 1
    return 0


def uniform(*parts):
    bits = int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)
    return (bits + 0.5) / 16**13


def test_counts_follow_the_inverse(docs):
    weights = {"src0": 5.0, "src1": 1.0, "src2": 0.0}
    rates = {r.source: r.rate for r in source_rates(docs, "source", weights, 1.0, 2.0).collect()}
    assert abs(sum(r.rate * r.n_source for r in source_rates(docs, "source", weights, 1.0, 2.0).collect()) - 2 * docs.count()) < 1e-6
    got = Counter(r.doc_id for r in mix_sources(docs, weights=weights, budget=2.0, seed=5).collect())
    for r in docs.collect():
        assert got[r.doc_id] == poisson(rates[r.source], uniform(5, r.doc_id))
    assert not any(r.source in ("src2", "src3") for r in mix_sources(docs, weights=weights, budget=2.0, seed=5).collect())


def test_both_join_ways_and_reruns_agree(docs):
    a = sorted((r.doc_id, r.mix_copy, r.mix_order) for r in mix_sources(docs).collect())
    b = sorted((r.doc_id, r.mix_copy, r.mix_order) for r in mix_sources(docs.repartition(7), broadcast_rows=1).collect())
    c = sorted((r.doc_id, r.mix_copy, r.mix_order) for r in mix_sources(docs, broadcast_steps=10).collect())
    assert a == b == c and len(set(x[2] for x in a)) == len(a)


def test_large_rates_dont_underflow(spark):
    df = spark.createDataFrame([(k, "a") for k in range(3)] + [(9, "b")] * 1, "doc_id long, source string")
    n = mix_sources(df, weights={"b": 1.0}, budget=500.0).count()
    assert 1700 < n < 2300


def test_nasty_rows(nasty, nothing):
    out = mix_sources(nasty.withColumnRenamed("kept", "mix_copy"), budget=3.0)
    rows = out.collect()
    assert rows and out.columns.count("mix_copy") == 1
    assert mix_sources(nothing).count() == 0 and mix_sources(nasty, weights={}).count() == 0


def test_plan_has_no_python(docs):
    plan = mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
