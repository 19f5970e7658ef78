"""Holds op4, op5, op11, op12 and op13 against independent programs on whole tables: python tests/llm/whole_tables.py DIR [op4] [op5] ...

Not collected by pytest, as it takes minutes and gigabytes: one process holds every window of the table.
"""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

U = np.uint64


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * U(0x9E3779B97F4A7C15) + (b ^ (b >> U(29))) * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(31))


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of `length` bytes, put together from windows whose sizes are powers of two."""
    out, size, done, h = None, 1, 0, data.astype(U) + U(1)
    while True:
        if length & size:
            part = h[done : done + len(data) - length + 1]
            out = part.copy() if out is None else mixed(out, part)
            done += size
        if 2 * size > length:
            return out
        h = mixed(h[:-size], h[size:])
        size *= 2


def expected_op4(ids: list, texts: list[bytes], length: int = 400) -> dict:
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - np.array([len(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), ends - starts)
    inside = np.flatnonzero(doc[: len(data) - length + 1] == doc[length - 1 :])
    h = window_hashes(data, length)[inside]
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    at = inside[twice]
    edge[at] += 1
    np.add.at(edge, at + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    out = {}
    for i, t, a, b in zip(ids, texts, starts.tolist(), ends.tolist(), strict=True):
        g = gone[a:b]
        spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if len(g) else 0
        out[i] = (len(t), int(np.count_nonzero(g)), spans, hashlib.sha256(data[a:b][~g].tobytes()).hexdigest())
    return out


def expected_op5(ids: list, texts: list[bytes], width: int = 3, percent: int = 85) -> dict:
    """Components by an exact prefix-filter join: sets that reach the similarity share one of their rarest shingles."""
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    of_set: dict[frozenset, list] = {}
    size, alone = {}, []
    for i, t in zip(ids, texts, strict=True):
        w = word.findall(t.lower())
        s = frozenset(hash(b" ".join(w[k : k + width])) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
        size[i] = len(s)
        if s:
            of_set.setdefault(s, []).append(i)
        else:
            alone.append(i)
    times = Counter(x for s in of_set for x in s)
    sets = sorted(of_set, key=len)
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index: dict[int, list[int]] = {}
    for k, s in enumerate(sets):
        n = len(s)
        rare = sorted(s, key=lambda x: (times[x], x))[: n - -(-percent * n // 100) + 1]
        tried = set()
        for x in rare:
            if times[x] < 2:
                continue
            for j in index.get(x, ()):
                if j in tried or 100 * len(sets[j]) < percent * n:
                    continue
                tried.add(j)
                a, b = find(j), find(k)
                if a != b:
                    common = len(s & sets[j])
                    if 100 * common >= percent * (n + len(sets[j]) - common):
                        root[a] = b
            index.setdefault(x, []).append(k)
    least: dict[int, int] = {}
    for k, s in enumerate(sets):
        r = find(k)
        least[r] = min(least.get(r, min(of_set[s])), *of_set[s])
    out = {i: (0, i, True) for i in alone}
    for k, s in enumerate(sets):
        for i in of_set[s]:
            out[i] = (size[i], least[find(k)], i == least[find(k)])
    return out


def expected_op11(ids: list, texts: list[bytes]) -> dict:
    return {i: found[:2] for i, found in expected_op5(ids, texts, 5, 80).items()}


def expected_op12(ids: list, texts: list[bytes]) -> dict:
    """Near words by deletion: words of one length that are equal without place k, and words that are another's deletion."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts: Counter = Counter()
    for i, text in zip(ids, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text.decode()):
            word = run.translate(lower)
            h = zlib.crc32(f"{i}:{word}".encode())
            counts[word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near: dict[str, set] = {w: set() for w in counts}
    groups: dict[tuple, list[str]] = {}
    for w in counts:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            groups.setdefault((k, less), []).append(w)
            if less in near:
                near[less].add(w)
                near[w].add(less)
    for group in groups.values():
        for w in group if len(group) > 1 else ():
            near[w].update(v for v in group if v != w)
    best = {w: min(found, key=lambda v: (-counts[v], v)) for w, found in near.items() if found}
    form = {w: v for w, v in best.items() if counts[v] >= 10 * counts[w]}

    def root(w: str) -> str:
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def compare_op13(spark, folder: str) -> None:
    from cipherlake.llm import queries
    from cipherlake.llm.conversation_trie import brute_force

    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    want = Counter(brute_force(rows))
    got = Counter(tuple(r) for r in queries.op13_conversation_trie(spark, folder).collect())
    print(f"{folder} op13: {sum(got.values())} nodes of {sum(want.values())}, {sum(((got - want) + (want - got)).values())} differ", flush=True)


def main(folder: str, names: list[str]) -> None:
    from pyspark.sql import SparkSession

    from cipherlake.llm import queries

    builder = SparkSession.builder.master("local[8]").config("spark.driver.memory", "10g").config("spark.ui.enabled", "false")
    spark = builder.config("spark.sql.shuffle.partitions", "32").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    table = pq.read_table(f"{folder}/documents" if Path(folder, "documents").is_dir() else f"{folder}/documents.parquet", columns=["doc_id", "text"])
    ids, texts = table.column("doc_id").to_pylist(), [(t or "").encode() for t in table.column("text").to_pylist()]
    plans = {
        "op4": (queries.op4_suffix_array_dedup, ["n_bytes", "n_removed", "n_spans", "kept_sha256"], expected_op4),
        "op5": (queries.op5_minhash_near_dedup, ["n_shingles", "component_id", "kept"], expected_op5),
        "op11": (queries.op11_jaccard_join, ["n_shingles", "component_id"], expected_op11),
        "op12": (queries.op12_spelling_variants, ["form", "root", "n", "n_near", "form_n"], expected_op12),
    }
    for name in names or [*plans, "op13"]:
        if name == "op13":
            compare_op13(spark, folder)
            continue
        query, columns, expected = plans[name]
        rows = query(spark, folder).select("word" if name == "op12" else "doc_id", *columns).collect()
        got = {r[0]: tuple(r[1:]) for r in rows}
        want = expected(ids, texts)
        wrong = [i for i in want if got.get(i) != want[i]]
        marks = {"op4": lambda i, w: w[1] > 0, "op5": lambda i, w: not w[2], "op11": lambda i, w: w[1] != i, "op12": lambda i, w: w[0] is not None}
        marked = sum(marks[name](i, w) for i, w in want.items())
        print(f"{folder} {name}: {len(rows)} rows of {len(want)}, {marked} marked, {len(wrong)} differ {[(i, got.get(i), want[i]) for i in wrong[:3]]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
