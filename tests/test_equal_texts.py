"""Lexing of tables with many equal texts, and its spread over tasks."""

import itertools

from cipherlake import queries as Q
from cipherlake.operators import nodes as N


def test_equal_texts_of_a_batch_are_lexed_once(spark, monkeypatch):
    calls = itertools.count()

    def extract(text):
        if text == "bad":
            raise ValueError(text)
        call = next(calls)
        return [{"node_type": "word", "text": f"{call}:{w}", "start": i, "stop": i + 1, "_at": (i, 0)} for i, w in enumerate(text.split())]

    monkeypatch.setitem(N._REGISTERED, "words", extract)
    texts = ["a b", "c", "bad", "", None, " ".join(["x"] * (N.FLUSH + 5))]
    files = spark.createDataFrame([(f"f{k}", "words", texts[k % len(texts)]) for k in range(60)], "file_path string, language string, text string").coalesce(1)
    got: dict[str, list] = {}
    for r in N.extract_nodes(files).collect():
        got.setdefault(r.file_path, []).append((r.seq, r.text.split(":")[1], int(r.text.split(":")[0])))
    for k in range(60):
        words = (texts[k % len(texts)] or "").split() if texts[k % len(texts)] != "bad" else []
        assert [(s, w) for s, w, _ in sorted(got.get(f"f{k}", []))] == list(enumerate(words))
    assert len({call for k in range(60) if k % len(texts) < 2 for *_, call in got[f"f{k}"]}) == 2


def test_costly_rows_are_spread(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(Q, "SPREAD", 40)
    n = Q.table(spark, sf_dir, "customer").count()
    spread = Q.SOURCES.spark(spark, sf_dir, True)
    assert spread.rdd.getNumPartitions() == -(-n // 40)
    assert sorted(spread.select("id").collect()) == sorted(Q.SOURCES.spark(spark, sf_dir).select("id").collect())
