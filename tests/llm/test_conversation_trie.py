import random

import numpy as np
import pytest

from cipherlake.llm import conversation_trie as T
from cipherlake.llm._frames import Workspace
from cipherlake.llm._running import running

SCHEMA = "conv_id long, turn long, role string, text string"


def check(df, rows, **kw):
    got = [tuple(r) for r in T.conversation_trie(df, **kw).collect()]
    assert sorted(got, key=str) == T.brute_force(rows)
    return got


@pytest.mark.parametrize("shard_rows", [1 << 16, 30])
def test_conversations(spark, sf_dir, shard_rows):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    check(df, [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()], shard_rows=shard_rows)


def made(seed, n):
    """Conversations that share beginnings, copies in plenty, prefixes of one another, and a long one."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-200, 4 * n), n):
        length = rng.choice([1, 2, 3, 6, 9])
        one = rng.randrange(3)
        rows += [(c, t if rng.random() < 0.9 or t else None, "user" if t % 2 else None, f"say {one} word{rng.randrange(1 + one)}  at {t}" if rng.random() < 0.9 else None) for t in range(length)]
    rows += [(40, t, "user", f"turn {t // 2} of a long one") for t in range(300)]
    rows += [(60, t, "user", f"turn {t // 2} of a long one") for t in range(280)]
    return rows


@pytest.mark.parametrize("shard_rows", [1, 60])
def test_heavy_levels_and_shards_agree(spark, shard_rows):
    rows = made(shard_rows, 150)
    got = check(spark.createDataFrame(rows, SCHEMA).repartition(5), rows, shard_rows=shard_rows)
    assert max(r[1] for r in got) > 250


def test_nasty_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "x"), (1, 3, "user", ""), (1, 3, "user", ""), (None, 0, "user", "lost"), (21, 0, "a", "b"), (41, 0, "", " \t"), (61, 0, None, "w " * 50_000), (20, 5, "user", "é 漢")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", depth string")
    check(df, rows)
    assert T.conversation_trie(df.where("conv_id IS NULL")).count() == 0
    assert T.conversation_trie(df.where("false")).count() == 0


def test_only_turnless(spark):
    """Conversations whose every turn goes and whose base is absent: the root is the only node, and a leaf."""
    ids = [c for c in range(1, 400) if c % 20 and T.zlib.crc32(str(c).encode()) % 4]
    rows = [(c, 0, "user", "gone") for c in ids]
    got = check(spark.createDataFrame(rows, SCHEMA), rows)
    assert len(got) == 1 and got[0][:6] == (ids[0], 0, None, len(ids), 0, 1)


def test_louds():
    trie = T.Louds(np.array([0, 0, 1, 2, 2, 4]), np.array([5, 6, 1, 2, 3, 4]), [0, 1, 3, 6])
    assert trie.parents().tolist() == [-1, 0, 0, 1, 2, 2, 4] and trie.degrees().tolist() == [2, 1, 2, 0, 1, 0, 0]
    assert "".join(str(int(b)) for b in trie.unpacked()) == "1101011001000" and trie.slices() == [(6, 7), (3, 6), (1, 3)]


def test_running_over_ranges(spark):
    """A group of half of all rows spans many ranges."""
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, rng.randrange(9)]), k, rng.randrange(100), rng.randrange(2**62)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g long, o long, v long, x long").repartition(6)
    got = {r.o: (r.v, r.x) for r in running(df, Workspace(spark, "running"), "r", "g", ["o"], {"v": "add", "x": "xor"}).collect()}
    sums: dict = {}
    for g, o, v, x in rows:
        a, b = sums.get(g, (0, 0))
        sums[g] = (a + v, b ^ x)
        assert got[o] == sums[g]
