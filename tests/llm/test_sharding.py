import bisect
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherlake.llm import sharding as S
from cipherlake.llm.sharding import quantile_splitters, shard_bytes


def check(rows, texts, n):
    total = sum(r.size for r in rows)
    sizes = [sum(r.size for r in rows if r.shard == k) for k in range(n)]
    largest = max((r.size for r in rows), default=0)
    assert all(abs(s - total / n) <= largest for s in sizes)
    for k in range(n):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
    got = sorted((r.size, r.text_crc32) for r in rows)
    assert got == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)


def test_whole_table(docs):
    check(shard_bytes(docs).collect(), [r.text for r in docs.collect()], 8)


@pytest.mark.parametrize("n_ranges", [4, 64])
def test_hot_group_is_cut_by_id(spark, n_ranges):
    rows = [(k, "same text") for k in range(3000)] + [(5000 + k, f"own {k}") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard_bytes(df, n_shards=5, n_ranges=n_ranges, n_sample=400).collect()
    check(got, [t for _, t in rows], 5)
    # Few texts apart from the hot one are cut.
    by_text = {}
    for r in got:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in by_text.values()) <= 5


def test_nasty_rows(nasty, nothing):
    check(shard_bytes(nasty).collect(), [r.text for r in nasty.collect()], 8)
    assert shard_bytes(nothing).count() == 0


def test_splitters():
    assert quantile_splitters([], 4) == [] and quantile_splitters([(1, 1)] * 9, 4) == [(1, 1)]
    assert quantile_splitters([(k, 0) for k in range(8)], 4) == [(2, 0), (4, 0), (6, 0)]


def test_repeated_rows_are_spread(spark):
    """One row repeated thousands of times, beside others: its range is subdivided too."""
    df = spark.createDataFrame([(7, "the same row")] * 6000 + [(k, f"text {k}") for k in range(2000)], "doc_id long, text string")
    keys = S.Workspace(spark, "sharding-test").save(S.row_keys(df, "text", "doc_id"), "keys")
    splitters = S.find_splitters(keys, 16, 4000, 2.0, 4)
    rows = [r["count"] for r in keys.withColumn("range", S.range_of(splitters)).groupBy("range").count().collect()]
    assert sum(rows) == 8000 and max(rows) <= 2.5 * 8000 / 16
    by = {}
    for r in S.shard_bytes(df, n_ranges=16).collect():
        by.setdefault(r.shard, []).append(r)
    sizes = [sum(r["size"] for r in by[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 26 and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())


def test_places_are_those_of_bisect():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 4, (500, 3))
    splitters = sorted({tuple(map(int, k)) for k in rng.integers(0, 4, (30, 3))})
    got = S.places(np.array(splitters), keys)
    assert got.tolist() == [bisect.bisect_right(splitters, tuple(map(int, k))) for k in keys]
    assert S.places(np.zeros((0, 3), np.int64), keys).tolist() == [0] * 500


def test_law_against_a_plain_program(spark, docs):
    """Shards and slots from nothing but the order of keys and exact byte offsets."""
    rows = {r.doc_id: r for r in S.shard_bytes(docs).collect()}
    keys = sorted(((r.h1, r.h2), r.doc_id, r["size"]) for r in S.row_keys(docs, "text", "doc_id").collect())
    total, at, slots = sum(k[2] for k in keys), 0, [0] * 8
    for _, i, size in keys:
        at += size
        shard = min(7, int((at - size / 2) * 8 // total))
        assert (rows[i].shard, rows[i].slot) == (shard, slots[shard])
        slots[shard] += 1


def test_ranges_follow_rows(spark, monkeypatch):
    """The number of ranges grows with the counted rows; shards and slots stay right."""
    seen = []
    inner = S.find_splitters
    monkeypatch.setattr(S, "find_splitters", lambda keys, n_ranges, n_sample, *a: seen.append((n_ranges, n_sample)) or inner(keys, n_ranges, n_sample, *a))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 700).alias("text"))
    rows = S.shard_bytes(df, n_ranges=4, range_rows=100, n_sample=50).collect()
    assert seen == [(30, 960)] and len(rows) == 3000
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    sizes = [sum(r.size for r in rows if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)
