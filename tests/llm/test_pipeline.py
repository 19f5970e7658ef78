import corpus_pipeline as P
from cipherlake.llm.exact_dedup import exact_dedup
from cipherlake.llm.mixing import mix_sources
from cipherlake.llm.near_dedup import brute_force


def test_stages(spark, docs, sf_dir):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "MinHash near-dedup", "mixing sources", "SentencePiece"]
    seen = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        seen[name] = docs.collect()
        if name != "SentencePiece":
            assert docs.columns == P.COLUMNS
    first = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(first[r.doc_id] == r for r in seen["toxicity"])
    frame = spark.createDataFrame(seen["toxicity"], docs_schema())
    kept = {r.doc_id for r in exact_dedup(frame).where("kept").collect()}
    assert {r.doc_id for r in seen["exact dedup"]} == kept
    groups = brute_force([(r.doc_id, r.text) for r in seen["exact dedup"]], 5, 80)
    assert {r.doc_id for r in seen["MinHash near-dedup"]} == {i for i, (_, c) in groups.items() if i == c}
    frame = spark.createDataFrame(seen["MinHash near-dedup"], docs_schema())
    assert sorted(r.doc_id for r in seen["mixing sources"]) == sorted(r.doc_id for r in mix_sources(frame).collect())
    assert sorted(r.doc_id for r in seen["SentencePiece"]) == sorted(r.doc_id for r in seen["mixing sources"])
    assert all(r.round_trip for r in seen["SentencePiece"])


def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.count() > 0 and "ids" in out.columns


def test_nasty_rows(spark, nasty, nothing, sf_dir):
    for name, stage in P.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0, name
        stage(spark, nasty, sf_dir).collect()


def test_one_row_of_each_group_stays(spark, sf_dir):
    """Repeated ids and null ids: the dedup stages keep rows, not ids."""
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty {0} again a b c d e f g h i j k l m n o p q r s t u v w x y z"
    other = " ".join(f"other{k}" for k in range(60))
    rows = [(7, words.format("x")), (7, words.format("x")), (None, words.format("x")), (None, other), (None, other), (None, other + " more"), (8, "alone here"), (8, "quite another text"), (None, "without an id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs_schema())
    exact = P.exact_dedup(spark, docs, sf_dir).select(*P.COLUMNS)
    got = sorted(((r.doc_id, r.text) for r in exact.collect()), key=str)
    assert got == sorted([(7, words.format("x")), (None, other), (None, other + " more"), (8, "alone here"), (8, "quite another text"), (None, "without an id")], key=str)
    for frame in (docs, exact):
        near = P.near_dedup(spark, frame, sf_dir)
        assert near.columns == P.COLUMNS
        got = [(r.doc_id, r.text) for r in near.collect()]
        assert len(got) == 5 and sum(t.startswith("other") for _, t in got) == 1
        assert [i for i, t in got if t.startswith("one")] == [7] and sorted(t for i, t in got if i == 8) == ["alone here", "quite another text"]
