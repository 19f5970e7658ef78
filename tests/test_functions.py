import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cipherlake.functions import redaction as R
from cipherlake.functions import urls as U
from cipherlake.operators import discovery as D
from cipherlake.operators import report as RP
from cipherlake.operators.findings import complete, valid
from cipherlake.rules.tables import REDACTIONS

SECRET, HASH = R.token("SECRET", "", ""), R.token("HASH_DIGEST", "", "")
CASES = [
    ("aes_key = b'16bytekey1234567'", SECRET, 1, ["secret_variable_assignment"]),
    ("des_key = b'8bytekey'", None, 0, []),
    ('token = "' + "0a" * 20 + '"', f"token = {HASH}", 1, ["sha1_digest"]),
    ('password = """abc"""', f'{SECRET}"abc"""', 1, ["secret_variable_assignment"]),
    ("host 10.1.2.3 and 127.0.0.1", f"host {R.token('IP', '', '')} and 127.0.0.1", 1, ["ipv4_address"]),
    ("os.environ['password']", f"os.environ[{SECRET}]", 1, ["os_environ_secret"]),
    ("b'" + "\\x0a" * 8 + "'", R.token("KEY_MATERIAL", "", ""), 1, ["bytes_key_literal"]),
    ("RSA.generate(2048)", None, 0, []),
    ("", None, 0, []),
]


def python_fold(text):
    count, fired = 0, []
    for name, raw, kind, before, after in REDACTIONS:
        text, n = re.subn(raw, lambda m, t=R.token(kind, before, after): t, text, flags=re.I | re.M)
        count += n
        fired += [name] * (n > 0)
    return text, count, sorted(fired)


def test_sanitize_cases(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)] + [(99, None)], "k int, text string")
    rows = {r.k: r for r in R.sanitize(df, "text").collect()}
    for k, (text, want, count, fired) in enumerate(CASES):
        r = rows[k]
        assert (r.sanitized, r.redaction_count, r.categories_redacted, r.was_modified) == (text if want is None else want, count, fired, want is not None)
    assert rows[99].sanitized == "" and not rows[99].was_modified
    plain = {r.k: r.t for r in df.select("k", R.sanitize_text(F.col("text")).alias("t")).collect()}
    assert all(plain[k] == rows[k].sanitized for k in range(len(CASES)))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["password", " = ", "'x'", '"', "0123456789abcdef" * 2, "eyJa.eyJb.c", "10.0.0.1", "AKIA" + "Z" * 16, "\n", "b'", "secret: ", "-----BEGIN ", "KEY-----", "é"]), max_size=10).map("".join), min_size=1, max_size=8))
def test_sanitize_equals_a_python_fold(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for r in R.sanitize(df, "text").collect():
        assert (r.sanitized, r.redaction_count, r.categories_redacted) == python_fold(texts[r.k])


def test_audit_and_gate(spark):
    df = spark.createDataFrame([(CASES[2][0],), ("eyJa.eyJb.c",)], "text string")
    audits = [r.a for r in df.select(R.audit(F.col("text")).alias("a")).collect()]
    assert audits[0] == {"sha1_digest": 1, "hex_encoded_key": 1}
    assert [r.s for r in df.select(R.is_safe(F.col("text")).alias("s")).collect()] == [True, False]


@pytest.mark.parametrize(
    "url,is_file,name",
    [
        ("https://github.com/o/r/blob/main/go.mod", True, "go.mod"),
        ("https://github.com/o/r/issues/12", False, "scraped_file.py"),
        ("https://github.com/o/r/tree/main/a.py", True, "a.py"),
        ("https://github.com/o/r", False, "scraped_file.py"),
    ],
)
def test_urls(spark, url, is_file, name):
    df = spark.createDataFrame([(url,)], "url string").select(U.is_file_url(F.col("url")).alias("f"), U.raw_url(F.col("url")).alias("raw"))
    row = df.select("f", "raw", U.filename_from_url(F.col("raw")).alias("name")).first()
    assert (row.f, row.name) == (is_file, name) and "/blob/" not in row.raw


def test_unique_names(spark):
    rows = spark.createDataFrame([(1, "x.py", k) for k in range(102)], "domain int, filename string, place int")
    names = {r.place: r.saved_name for r in D.unique_names(rows).collect()}
    assert [names[k] for k in (0, 1, 99, 100, 101)] == ["x.py", "x_1.py", "x_99.py", "x_dup.py", "x_dup.py"]


def test_model_tiers(spark):
    tiers = D.model_tiers(spark, "https://h", ["long-key-1", "short"], ["a", "b", "c"]).collect()
    assert [(t.tier, t.model) for t in tiers] == [(1, "a"), (3, "c")]


def test_report_of_nothing_and_validity(spark):
    schema = "file_path string, line_number int, column_start int, column_end int, language string, algorithm_detected string, code_snippet string, is_quantum_vulnerable boolean, vulnerability_class string, severity string"
    none = spark.createDataFrame([], schema)
    row = RP.summary(none).first()
    assert (row.total_findings, row.enrichment_progress_pct, row.severity_breakdown["INFO"]) == (0, 0.0, 0)
    assert RP.metadata(none).first().languages_scanned == []
    bad = spark.createDataFrame([("a", 0, None, None, "x", "RSA", "s", True, "c", "HIGH"), ("a", 1, None, None, "x", "RSA", " \t", True, "c", "HIGH"), ("a", 1, None, None, "x", "RSA", "s", True, "c", "HIGH")], schema)
    assert valid(bad).count() == 1 and complete(bad).where("NOT false_positive").count() == 3
