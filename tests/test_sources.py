"""Golden corpora, one case per quirk of the languages, and the directory source."""

import json
import time

import pytest
from pyspark.sql import functions as F

from cipherlake.operators import lookups, nodes
from cipherlake.operators import report as RP
from cipherlake.operators.lookups import find_in_nodes
from cipherlake.operators.manifest import scan_manifests
from cipherlake.operators.nodes import Markers, Source, extract_nodes, nodes_of
from cipherlake.plans import scan as P
from cipherlake.rules.tables import Rule
from cipherlake.sources.corpus import EXTRA_EXTENSIONS, MOCK_FILES, directory, list_directory, mock_corpus, uploaded

SAMPLE = '''"""
A payment module.
import rsa in a docstring is no code
"""
import rsa
from Crypto.Cipher import AES, DES
from Crypto.Hash import SHA1, MD5
import hashlib
import ecdsa
from cryptography.hazmat.primitives import hashes


def pay(x):
    return hashlib.md5(x).hexdigest()
'''


def found(spark, language, *texts):
    files = spark.createDataFrame([(f"{k:02d}", language, t) for k, t in enumerate(texts)], "file_path string, language string, text string")
    rows = find_in_nodes(extract_nodes(files), files).collect()
    return sorted((r.file_path, r.line_number, r.algorithm_detected, r.severity) for r in rows)


def test_sample_module(spark):
    rows = P.scan_files(uploaded(spark, "up/app.py", SAMPLE.encode())).orderBy("line_number").collect()
    assert [(r.line_number, r.algorithm_detected, r.severity, r.column_end) for r in rows] == [
        (5, "RSA", "CRITICAL", 10),
        (6, "AES", "HIGH", 34),
        (7, "SHA-1", "HIGH", 33),
        (8, "Hash/hashlib", "MEDIUM", 14),
        (9, "ECDSA", "CRITICAL", 12),
        (10, "PyCA/cryptography", "HIGH", 49),
    ]
    assert {r.file_path for r in rows} == {"app.py"} and all(r.is_quantum_vulnerable for r in rows)


def test_mock_report(spark):
    report = json.loads(P.scan(spark, "stripe.com", "web").first().json)
    assert report["total_findings"] == 13 and report["critical_findings_count"] == 7
    assert report["severity_breakdown"] == {"CRITICAL": 7, "HIGH": 6, "MEDIUM": 0, "LOW": 0, "INFO": 0}
    assert report["metadata"]["languages_scanned"] == ["python"] and report["metadata"]["files_scanned"] == 6
    assert report["enrichment_progress_pct"] == 0.0 and report["status"] == "COMPLETE"
    assert report["algorithms_detected"] == sorted(["AES", "ECDSA", "ECDSA/ECDH (elliptic)", "RSA", "RSA/AES (PyCryptodome)", "RSA/EC (cryptography lib)", "RSA/EC (golang.org/x/crypto)", "SHA-1"])
    order = [(r.file_path, r.line_number) for r in P.ordered_findings(mock_corpus(spark)).collect()]
    assert order[:6] == [("mock_vendor_app.py", k) for k in range(1, 7)] and order[6] == ("go.mod", 6)


@pytest.mark.parametrize(
    "text,want",
    [
        ("import os, rsa", []),
        ("import rsa as r", []),
        ("import x as rsa", [("RSA", "CRITICAL")]),
        ("from . import rsa", []),
        ("from .rsa import x", []),
        ("# import rsa", []),
        ("s = '''\nimport rsa\n'''", []),
        ("from Crypto.Hash import MD5", [("MD5", "HIGH")]),
        ("from Crypto.Cipher import (\n  Foo,  # no\n  AES,\n)", [("AES", "HIGH")]),
        ("import random", [("PRNG/random", "INFO")]),
        ("if x: import rsa; import ssl", [("RSA", "CRITICAL"), ("TLS/SSL", "HIGH")]),
        ("def f(:\n  import rsa\n  x = (", [("RSA", "CRITICAL")]),
        ("imported = 1\nfromage = 2", []),
        ("", []),
    ],
)
def test_python(spark, text, want):
    assert [(a, s) for _, _, a, s in found(spark, "python", text)] == want


def test_javascript(spark):
    assert [a for *_, a, _ in found(spark, "javascript", "require('crypto').createHash('md5')")] == ["MD5", "Node-crypto", "Node-crypto"]
    assert found(spark, "javascript", "import c from 'node:crypto'\nexport * from 'crypto'", "const x = 'md5'", "require ('crypto'); import('crypto')", "// require('crypto')\n/* createHash('md5') */") == []
    assert [a for *_, a, _ in found(spark, "typescript", "import a from './x/argon2'")] == ["Argon2"]
    nested = "subtle.generateKey({name: 'RSA-OAEP', n: 2048}, true)"
    assert [(a, s) for *_, a, s in found(spark, "javascript", nested)] == [("RSA-OAEP", "CRITICAL")]


def test_java(spark):
    rows = found(
        spark, "java", "import java.security.MessageDigest;", "import javax.crypto.Cipher;", 'class A { void f() { KeyPairGenerator g = KeyPairGenerator.getInstance("RSA"); g.initialize(2048); } }',
        'String a = "RSA";', 'Object o = new SecretKeySpec(k, "AES");', 'class B { void f(String s) { x.init("AES"); } }', 'Cipher c = Cipher.getInstance("RSA", 3072);',
    )
    assert [(f, a, s) for f, _, a, s in rows] == [("00", "ECC", "HIGH"), ("01", "JCA/JCE", "HIGH"), ("02", "RSA", "CRITICAL"), ("05", "AES", "MEDIUM"), ("06", "RSA-3072", "HIGH")]


def test_go(spark):
    rows = found(spark, "go", 'package a\nimport "crypto/rsa"', 'import (\n mrand "crypto/rand"\n)', 'import "golang.org/x/crypto/sha3"', "func f() { k, _ := rsa.GenerateKey(rand.Reader, 4096) }")
    assert [(f, a, s) for f, _, a, s in rows] == [("00", "RSA", "CRITICAL"), ("01", "CSPRNG", "INFO"), ("03", "RSA-4096", "HIGH")]


def test_csharp(spark):
    rows = found(
        spark, "csharp", "using System.Security.Cryptography.X509Certificates;", "var r = new RSACryptoServiceProvider(2048);", "var m = MD5.Create();", "TripleDES.Create()",
        "using (var x = SHA256.Create()) { }", 'class A { void f() { HashAlgorithm.Create("SHA1"); } }', "var q = new System.Security.Cryptography.RSACng();",
    )
    assert [(f, a, s) for f, _, a, s in rows] == [("00", "DotNet-Crypto", "HIGH"), ("01", "RSA-2048", "CRITICAL"), ("02", "MD5", "CRITICAL"), ("04", "SHA-256", "MEDIUM"), ("05", "SHA-1", "CRITICAL")]


@pytest.mark.parametrize("language", ["python", "javascript", "java", "go", "csharp"])
def test_lexers_survive_anything(language):
    for text in ("(((", ")]}", '"', "'", "/*", "`", 'f("', "import", "import (", "using", "new", "a.b.", "x(y(z)", "\x00� é漢", "{" * 500):
        nodes_of(text, language)


def big_array(language, size):
    """A file that is one array of literals within a call, on one line, and its number of literals."""
    names = [f"v{k}" for k in range(size // 9)]
    body = ", ".join(f'"{n}"' for n in names)
    shapes = {"javascript": "const all = lookup([{}], 'md5');", "java": "class A {{ Object f() {{ return find(new String[] {{ {} }}, Cipher.getInstance(\"DES\")); }} }}", "csharp": "class A {{ object f() {{ return Find(new[] {{ {} }}, HashAlgorithm.Create(\"SHA1\")); }} }}"}
    return shapes[language].format(body), len(names) + 1


@pytest.mark.parametrize("language", ["javascript", "java", "csharp"])
def test_output_is_linear(spark, language):
    """A megabyte of literals: rows, bytes and time bounded by the file's size, not by that of contexts."""
    text, n = big_array(language, 1_000_000)
    began = time.monotonic()
    nodes = nodes_of(text, language)
    assert time.monotonic() - began < 30
    strings = [x for x in nodes if x["node_type"] in ("string", "string_literal")]
    assert len(strings) == n and all(len(x["ancestors"]) <= 6 for x in strings)
    size = sum(len(x["text"]) + sum(len(a["type"]) + 9 + sum(map(len, a["child_idents"])) for a in x.get("ancestors", [])) for x in nodes)
    assert size < 40 * len(text)
    if language != "javascript":
        assert [(a, s) for *_, a, s in found(spark, language, text)] == [("DES", "CRITICAL") if language == "java" else ("SHA-1", "CRITICAL")]


@pytest.mark.parametrize("language", ["javascript", "java", "csharp", "go"])
def test_deep_and_long_code_is_linear(language):
    """Nested brackets, call chains, one long expression, unmatched brackets: a few hundred thousand tokens each."""
    n = 60_000
    texts = ("f(" * n + '"md5"' + ")" * n, "a" + ".b()" * n, 'x = "a"' + ' + "a"' * n + ";", "(" * n + "]" * n, "[(" * n + ']"s"' * n, '{"s"' * n, "é " + ' "é"' * n)
    for text in texts:
        began = time.monotonic()
        nodes_of(text, language)
        assert time.monotonic() - began < 20, text[:40]


def strings(text, language):
    return [x["text"] for x in nodes_of(text, language) if x["node_type"] in ("string", "string_literal")]


def test_code_within_templates():
    """Code in template literals and interpolated strings is code; nested ones too, and text around it is not."""
    text = "log(`a 'x' ${c.createHash('md5', `in ${f('sha1')} 'y'`)} \\` 'z'`); g('rc4')"
    assert strings(text, "javascript") == ["'md5'", "'sha1'", "'rc4'"]
    first = next(x for x in nodes_of(text, "javascript") if x["text"] == "'md5'")
    assert [a["type"] for a in first["ancestors"]] == ["arguments", "call_expression", "template_substitution", "template_string", "arguments", "call_expression"]
    assert first["ancestors"][1]["marked"] and text[first["ancestors"][3]["start"]] == text[first["ancestors"][3]["stop"] - 1] == "`"
    cs = 'var a = $"x {{no}} {MD5.Create("SHA1")} \\" y"; var b = $@"c:\\{F("DES")}""q"; G("RSA");'
    assert strings(cs, "csharp") == ['"SHA1"', '"DES"', '"RSA"']
    assert "MD5.Create" in {x["text"].split("(")[0] for x in nodes_of(cs, "csharp")}


def test_regular_expressions_and_divisions():
    assert strings("a.replace(/[\"'/]/g, 'md5'); b = x / 2 / y; c('sha1')", "javascript") == ["'md5'", "'sha1'"]
    assert strings("return /'/.test(s) ? f('des') : (a) / 'rc4' / 2", "javascript") == ["'des'", "'rc4'"]


@pytest.mark.parametrize(
    "language,text,want",
    [
        ("javascript", "f(`${", []), ("javascript", "f(`${g('a'", ["'a'"]), ("javascript", "`${ {a: 'b'} }` + 'c'", ["'b'", "'c'"]), ("javascript", "f('a' `${x", ["'a'"]),
        ("javascript", "if (x { f('md5'); } else ) g('sha1');", ["'md5'", "'sha1'"]), ("javascript", "f('unclosed\ng('next')", ["'unclosed", "'next'"]), ("javascript", "/* never closed f('a')", []),
        ("csharp", '$"{', []), ("csharp", 'F($"{G("a"', ['"a"']), ("csharp", 'class A { void f( { H("x"); } } }} I("y");', ['"x"', '"y"']),
        ("java", 'class A { void f( { x.init("AES"); }', ['"AES"']), ("java", '"""\n"no"\n', []), ("java", "f('\"', \"DES\"", ['"DES"']),
    ],
)
def test_broken_files_give_their_intact_parts(language, text, want):
    assert strings(text, language) == want


def test_contexts_by_position():
    """Contexts are told apart by where marker words lie; columns count bytes."""
    text = "/* é */ lookup(['md5'], x.createHash('sha1'))"
    by = {x["text"]: x for x in nodes_of(text, "javascript") if x["node_type"] == "string"}
    assert [a["marked"] for a in by["'md5'"]["ancestors"]][:3] == [False, True, True] and by["'sha1'"]["ancestors"][1]["marked"]
    assert text[by["'sha1'"]["ancestors"][1]["start"] : by["'sha1'"]["ancestors"][1]["stop"]] == "x.createHash('sha1')"
    assert by["'md5'"]["column_start"] == len("/* é */ lookup([".encode())
    marks = Markers("SIGN \u212aey x", ("sign", "key", "signature"))
    assert marks.within(0, 4) and not marks.within(1, 5) and marks.within(5, 8) and not Markers("sign", ()).within(0, 4)


def test_one_bad_file_stops_nothing(spark, monkeypatch):
    """A lexer that runs out of memory or depth gives no nodes; the other files do."""
    from cipherlake.operators import nodes as N

    def extract(text):
        if text == "bad":
            raise MemoryError
        yield Source(text).node("string", 0, len(text))

    monkeypatch.setitem(N._REGISTERED, "frail", extract)
    files = spark.createDataFrame([("a", "frail", "bad"), ("b", "frail", "fine"), ("c", "frail", None)], "file_path string, language string, text string")
    assert [(r.file_path, r.text) for r in extract_nodes(files).collect() if r.text] == [("b", "fine")]


def test_repeated_files_are_found_each_time(spark):
    texts = [("a.js", "javascript", "c.createHash('md5')"), ("a.js", "javascript", "c.createHash('md5')"), ("a.js", "javascript", "c.createHash('sha1')")]
    files = spark.createDataFrame(texts, "file_path string, language string, text string")
    rows = find_in_nodes(extract_nodes(files), files).collect()
    assert sorted((r.algorithm_detected, r.code_snippet) for r in rows) == [("MD5", "c.createHash('md5')")] * 2 + [("SHA-1", "c.createHash('sha1')")]


def test_manifest_lines(spark):
    lines = ["rsa==4.9", "# rsa", "// rsa", "<!-- rsa", "* rsa", "; rsa", "", "node-forge", "bcrypt", "\t des Moines \r\nopenssl = 1", "désétre"]
    rows = scan_manifests(spark.createDataFrame([("a.txt", "\n".join(lines))], "file_path string, text string")).orderBy("line_number").collect()
    assert [(r.line_number, r.algorithm_detected) for r in rows] == [(1, "RSA"), (8, "RSA (node-forge)"), (10, "AES/DES (symmetric)"), (11, "RSA (Rust crate)")]
    empty = spark.createDataFrame([("a.txt", None), ("b.json", None), ("c.json", "")], "file_path string, text string")
    assert scan_manifests(empty).count() == 0


def test_imports_of_any_length(spark):
    names = ",\n".join(f"name{k}" for k in range(2000))
    assert [a for *_, a, _ in found(spark, "javascript", f"import {{ {names} }} from 'node-rsa'")] == ["RSA"]
    assert [a for *_, a, _ in found(spark, "java", "import " + ".".join(f"p{k}" for k in range(500)) + ".javax.crypto.Cipher;")] == ["JCA/JCE"]
    assert nodes_of(f"import {{ {names} }} ; 'x'", "javascript")[0]["node_type"] == "string"


def test_usings_within_namespaces(spark):
    text = "namespace A.B {\n using System.Security.Cryptography;\n namespace C { using Org.BouncyCastle.Crypto; }\n class D { void f() { using var x = System.Security.Cryptography.Y; } }\n}"
    assert [(line, a) for _, line, a, _ in found(spark, "csharp", text)] == [(2, "DotNet-Crypto"), (3, "BouncyCastle.Net")]
    assert [n["node_type"] for n in nodes_of("namespace N; using System.Security.Cryptography;", "csharp")] == ["using_directive"]


def test_registered_language(spark):
    def extract(text):
        for k, line in enumerate(text.split("\n")):
            if line.startswith("use "):
                yield {"node_type": "use", "text": line, "line_number": k + 1, "column_start": 0, "column_end": len(line), "_at": (k, 0)}

    P.register_language("rust", (".rs",), extract)
    lookups.register(lookups.Detector("rust_use", ("rust",), F.col("node_type") == "use", (Rule(1, "rsa", "RSA", "SHOR", "HIGH", True),), F.regexp_extract("text", "^use ([a-z0-9_]+)", 1), F.col("text")))
    try:
        rows = P.scan_files(uploaded(spark, "a.rs", b"use rsa::Key;\nuse std::io;\n"))
        assert [(r.language, r.line_number, r.algorithm_detected) for r in rows.collect()] == [("rust", 1, "RSA")]
        assert RP.metadata(rows).first().languages_scanned == ["rust"]
    finally:
        lookups._REGISTERED.clear()
        nodes._REGISTERED.clear()
        EXTRA_EXTENSIONS.clear()


def test_deep_directory(spark, tmp_path):
    want = set()
    for k in range(40):
        f = tmp_path / "/".join(["d", *[f"x{k % m}" for m in (2, 3, 5, 7, 4)]]) / f"f{k}.py"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("import rsa")
        want.add(str(f.relative_to(tmp_path)))
    (tmp_path / "d/node_modules/z").mkdir(parents=True)
    (tmp_path / "d/node_modules/z/q.js").write_text("")
    for subtrees in (1, 4, 64):
        assert sorted(r.rel_path for r in list_directory(spark, str(tmp_path), subtrees).collect()) == sorted(want)


def test_report_is_timed_and_small_by_default(spark):
    row = P.scan_mock(spark, "x.com")
    assert "findings" not in row.columns
    report = json.loads(P.scan(spark, "x.com", "web").first().json)
    assert report["metadata"]["scan_duration_seconds"] > 0 and "findings" not in report
    assert len(json.loads(P.scan(spark, "x.com", "web", with_findings=True).first().json)["findings"]) == 13


def test_directory(spark, tmp_path):
    files = {"a/app.py": "import rsa", "a/__init__.py": "import ssl", "bin/x.py": "import rsa", "bin/requirements.txt": "rsa", ".git/y.py": "import rsa", "a/.env.py": "import rsa", "b/L.java": "import javax.crypto.Cipher;", "c.bin": "rsa"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "a/latin.py").write_bytes(b"# \xe9\r\nimport rsa\r\n")
    rows = P.scan_texts(*directory(spark, str(tmp_path))).collect()
    got = sorted((r.file_path[len(str(tmp_path)) + 1 :], r.line_number, r.algorithm_detected) for r in rows)
    assert got == [("a/.env.py", 1, "RSA"), ("a/__init__.py", 1, "TLS/SSL"), ("a/app.py", 1, "RSA"), ("a/latin.py", 2, "RSA"), ("b/L.java", 1, "JCA/JCE"), ("bin/requirements.txt", 1, "RSA")]
    with pytest.raises(NotADirectoryError):
        list_directory(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        P.scan(spark, "x", "ftp")


def test_one_python_pass(spark):
    """However many detections there are, a plan extracts nodes once."""
    plan = P.scan_files(mock_corpus(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and len(MOCK_FILES) == 4
    # What hits show is cut out of their files by one equi-join; rules are broadcast.
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1


def test_streaming_dedupes(spark, tmp_path):
    from cipherlake.streaming.incremental import new_findings

    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"file_path": "a.txt", "text": "rsa\\necdsa", "seen_at": "2024-01-01T00:00:00Z"}\n{"file_path": "a.txt", "text": "rsa", "seen_at": "2024-01-01T00:01:00Z"}\n')
    stream = spark.readStream.schema("file_path string, text string, seen_at timestamp").json(str(source))
    query = new_findings(stream).writeStream.format("memory").queryName("new_findings").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("new_findings").count() == 2
    static = spark.read.schema("file_path string, text string, seen_at timestamp").json(str(source))
    assert new_findings(static).select(F.col("fingerprint")).distinct().count() == 2


def test_manifest_gates_drop_nothing(spark):
    """A signature is found wherever its pattern alone would be, odd letters and case included."""
    from cipherlake.rules.tables import MANIFEST_RULES

    lines = ["rſa", "deſ", "bouncycastı", "ellİptic", "RSA", "OpenSSL =1", "rsa   = 1", "Key forge", "GOLANG.ORG/X/CRYPTO", "golangxorg/x/crypto", "nothing"]
    df = spark.createDataFrame([("a.txt", "\n".join(lines))], "file_path string, text string")
    got = {r.line_number: r.algorithm_detected for r in scan_manifests(df).collect()}
    plain = spark.createDataFrame(list(enumerate(lines, 1)), "k int, line string")
    for rule in reversed(MANIFEST_RULES):
        plain = plain.withColumn(f"r{rule.ord}", F.col("line").rlike(f"(?iU){rule.key}"))
    for r in plain.collect():
        first = next((rule.algorithm for rule in MANIFEST_RULES if r[f"r{rule.ord}"]), None)
        assert got.get(r.k) == first, lines[r.k - 1]
