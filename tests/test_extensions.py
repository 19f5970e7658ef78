"""The tree source, listing orders, the document sink, the table function, and tracking over time."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cipherlake.operators import nodes as N
from cipherlake.operators.enrichment import enrich
from cipherlake.operators.findings import diff_with_stored, store_scan
from cipherlake.plans.functions import register_functions
from cipherlake.sources.corpus import list_by_extension
from cipherlake.sources.documents import JsonDocuments, write_reports
from cipherlake.sources.tree import TreeReader, numbered, path_order, source_tree, walk_order, without_directories
from cipherlake.streaming.tracking import FOUND, file_scans, scan_stream, track_changes


@pytest.fixture
def tree(tmp_path):
    for name in ("a/z.py", "a/b/c.py", "a.py", "B/x.ts", "B/y.TSX", "node_modules/q/r.ts", ".git/h.py", "a/.hidden.py", "a/b/.py", "m/n/node_modules/k.py", "a-b/w.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("import rsa")
    return tmp_path


def rel(rows):
    return [r.rel_path for r in rows]


def test_filters_reach_the_source(spark, tree):
    """Directories are pruned and suffixes chosen by the reader; both show in the plan."""
    df = source_tree(spark, str(tree)).where(without_directories(["node_modules"])).where("extension = '.py'")
    assert sorted(rel(df.collect())) == sorted(["a/z.py", "a/b/c.py", "a.py", "a/.hidden.py", "a/b/.py", "a-b/w.py"])
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PushedFilters" in plan and "node_modules" in plan.split("PushedFilters")[1]
    assert sorted(rel(source_tree(spark, str(tree)).where("size > 5 AND extension IN ('.ts', '.tsx')").collect())) == ["B/x.ts", "B/y.TSX", "node_modules/q/r.ts"]
    with pytest.raises(NotADirectoryError):
        source_tree(spark, str(tree / "a.py"))


@pytest.mark.parametrize("subtrees", [1, 3, 64])
def test_partitions_cover_the_tree_once(tree, subtrees):
    reader = TreeReader({"root": str(tree), "subtrees": str(subtrees)})
    assert not list(reader.pushFilters([]))
    found = [p for part in reader.partitions() for batch in reader.read(part) for p in batch.column(1).to_pylist()]
    assert len(found) == len(set(found)) == 11


def test_links_and_uris(spark, tree):
    os.symlink(tree, tree / "loop")
    assert source_tree(spark, tree.as_uri()).count() == 11
    assert all(r.file_path.startswith("file://") for r in source_tree(spark, tree.as_uri()).collect())


def test_listing_orders(spark, tree):
    """One suffix: by whole path. Several: a directory's files before its subdirectories'."""
    assert rel(list_by_extension(spark, str(tree), ".py").collect()) == sorted(["a/z.py", "a/b/c.py", "a.py", "a/.hidden.py", "a/b/.py", "m/n/node_modules/k.py", "a-b/w.py"][:5] + ["a-b/w.py"])
    assert rel(list_by_extension(spark, str(tree), "ts", ".TSX", ".py").collect()) == ["a.py", "B/x.ts", "B/y.TSX", "a/.hidden.py", "a/z.py", "a/b/.py", "a/b/c.py", "a-b/w.py"]


def test_places(spark):
    df = spark.range(500).select(F.concat(F.lit("/r/"), F.col("id") % 7, F.lit("/"), F.col("id")).alias("file_path")).repartition(9)
    got = {r.file_path: r.place for r in numbered(df, path_order()).collect()}
    assert [got[p] for p in sorted(got)] == list(range(1, 501))
    assert numbered(df.where("false"), walk_order()).count() == 0


FINDING = "project string, file_path string, line_number int, language string, algorithm_detected string, code_snippet string, is_quantum_vulnerable boolean, vulnerability_class string, severity string"


def test_documents(spark, tmp_path):
    rows = [("p/1", f"f{k % 3}", k, "python", "RSA", f's"{k}\n', True, "SHOR", "HIGH") for k in range(1, 400)] + [("é", "g", 1, "unknown", "MD5", "s", True, "GROVER", "LOW")]
    write_reports(spark.createDataFrame(rows, FINDING).repartition(6), "project", str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["%C3%A9.json", "p%2F1.json"]
    one = json.loads((tmp_path / "out/p%2F1.json").read_text())
    assert one["total_findings"] == len(one["findings"]) == 399 and one["severity_breakdown"]["HIGH"] == 399 and one["languages_scanned"] == ["python"]
    places = [(f["file_path"], f["line_number"]) for f in one["findings"]]
    assert places == sorted(places) and one["findings"][0]["usage_context"] is None
    # Written again, the documents are replaced.
    write_reports(spark.createDataFrame(rows[-1:], FINDING), "project", str(tmp_path / "out"))
    assert json.loads((tmp_path / "out/%C3%A9.json").read_text())["project_name"] == "é" and len(os.listdir(tmp_path / "out")) == 2


def test_a_failed_task_leaves_no_document(spark, tmp_path):
    spark.dataSource.register(JsonDocuments)
    rows = spark.range(40, numPartitions=4).select(F.concat(F.lit("d"), "id").alias("document"), F.lit(0).alias("part"), F.when(F.col("id") == 37, F.raise_error(F.lit("broken"))).otherwise(F.lit("{}")).alias("json"))
    with pytest.raises(Exception, match="broken"):
        rows.write.format("json_documents").option("path", str(tmp_path / "out")).mode("append").save()
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []


def test_table_function(spark):
    """The function gives what the scan's own extraction gives; unknown languages and nulls give nothing."""
    texts = [("a.py", "python", "import rsa\n"), ("b.js", "javascript", "c.createHash('md5')"), ("c", "cobol", "x"), ("d", None, "x"), ("e.go", "go", None)]
    files = spark.createDataFrame(texts, "file_path string, language string, text string")
    register_functions(spark)
    columns = ["file_path", "seq", "node_type", "text", "start", "stop", "idents", "ancestors"]
    got = spark.sql("SELECT f.file_path, n.* FROM {f} f, LATERAL source_nodes(f.language, f.text) n", f=files).select(*columns)
    want = N.extract_nodes(files.where("language IN ('python', 'javascript', 'go')")).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3


def test_language_registered_at_run_time(spark, monkeypatch):
    monkeypatch.setitem(N._REGISTERED, "words", lambda text: (N.Source(text).node("word", m.start(), m.end()) for m in N.re.finditer(r"\w+", text)))
    register_functions(spark, "word_nodes")
    assert [r.text for r in spark.sql("SELECT n.text FROM VALUES ('one two'), (NULL) t(x), LATERAL word_nodes('words', t.x) n").collect()] == ["one", "two"]


def versions(spark, rows):
    schema = f"file_path string, seen_at timestamp, found {FOUND}"
    return spark.createDataFrame(rows, "file_path string, day int, names array<string>").select(
        "file_path", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, day)").alias("seen_at"),
        F.expr("transform(names, n -> named_struct('fingerprint', n, 'line_number', 1, 'algorithm_detected', 'RSA', 'severity', 'HIGH'))").cast(FOUND).alias("found"),
    ), schema


def test_tracking(spark, tmp_path):
    """Added, kept and removed findings over batches; a late older version is ignored; an unseen file expires."""
    batches = [[("f", 0, ["a", "b"]), ("g", 0, ["x"])], [("f", 2, ["b", "c"])], [("f", 1, ["z"])], [("h", 90, [])], [("h", 91, ["q"])]]
    for k, rows in enumerate(batches):
        df, schema = versions(spark, rows)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # Files are read in the order in which they were written.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = track_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.file_path, r.fingerprint, r.change, r.first_seen.day, r.last_seen.day) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [g for g in got if g[2] == "added"] == [("f", "a", "added", 1, 1), ("f", "b", "added", 1, 1), ("f", "c", "added", 3, 3), ("g", "x", "added", 1, 1), ("h", "q", "added", 1, 1)]
    assert [g for g in got if g[2] == "removed"] == [("f", "a", "removed", 1, 1), ("f", "b", "removed", 1, 3), ("f", "c", "removed", 3, 3), ("g", "x", "removed", 1, 1)]


def test_scans_of_a_stream_of_files(spark, tmp_path):
    """Sources, lines and JSON manifests go through the stream; a file without findings is a version too."""
    files = [("a/app.py", b"import rsa\nimport ecdsa"), ("package.json", b'{"dependencies": {"node-rsa": "1"}}'), ("requirements.txt", b"rsa==4.9\n"), ("b.py", b"x = 1")]
    rows = spark.createDataFrame([(p, p, bytearray(c)) for p, c in files], "file_path string, rel_path string, content binary").withColumn("seen_at", F.lit("2024-01-01").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    scan_stream(stream, str(tmp_path / "scans"), str(tmp_path / "cp")).awaitTermination()
    got = {r.file_path: sorted((f.line_number, f.algorithm_detected) for f in r.found) for r in spark.read.parquet(str(tmp_path / "scans")).collect()}
    assert got == {r.file_path: sorted((f.line_number, f.algorithm_detected) for f in r.found) for r in file_scans(rows).collect()}
    assert got["a/app.py"] == [(1, "RSA"), (2, "ECDSA")] and got["package.json"] == [(1, "RSA (node-rsa)")] or got["package.json"][0][0] == 1
    assert got["b.py"] == [] and len(got["requirements.txt"]) == 1


def test_tiers_are_asked_lazily(spark, tmp_path):
    """The second tier gets only what the first has not answered validly; failures and blank snippets cost no more calls."""
    good = json.dumps({"usage_context": "u", "pqc_replacement": "ML-KEM-768", "migration_complexity": "low", "reasoning": "r"})

    def provider(tier, answers):
        def call(prompt):
            line = int(prompt.split("a.py:")[1].split("\n")[0])
            (tmp_path / f"{tier}-{line}").touch(exist_ok=False)  # a second call of the same fails
            if answers[line] == "fail":
                raise OSError("timeout")
            return answers[line]

        return call

    rows = [(k, "p", "a.py", k, "python", "RSA", "  " if k == 5 else "import rsa", True, "SHOR", "HIGH") for k in range(6)]
    findings = spark.createDataFrame(rows, "key long, " + FINDING)
    first, second = [good, "no", "fail", None, "{}", good], [None, good, good, "no", "fail", None]
    got = {r.key: r for r in enrich(findings, "key", [provider(1, first), provider(2, second)], pool=3).collect()}
    assert {k: r.usage_context for k, r in got.items()} == {0: "u", 1: "u", 2: "u", 3: None, 4: None, 5: None}
    assert sorted(os.listdir(tmp_path)) == ["1-0", "1-1", "1-2", "1-3", "1-4", "2-1", "2-2", "2-3", "2-4"]


def test_stored_scans_are_not_shuffled(spark, tmp_path):
    rows = [("p", f"f{k}", k, "python", "RSA", "s", True, "SHOR", "HIGH") for k in range(1, 60)]
    for name, part in (("scan_before", rows[:40]), ("scan_after", rows[20:])):
        store_scan(spark.createDataFrame(part, FINDING), name, 4, str(tmp_path / name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = diff_with_stored(spark, "scan_before", "scan_after")
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.change, r.line_number) for r in out.collect()) == [("added", k) for k in range(41, 60)] + [("removed", k) for k in range(1, 21)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("scan_before", "scan_after"):
            spark.sql(f"DROP TABLE {name}")
