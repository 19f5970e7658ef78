import hashlib
import re
from collections import defaultdict

from cipherlake.llm.exact_dedup import drop_exact_copies, exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[ \x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[3]
        for m in members:
            out[m[3]] = (keep, len(members), hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(1000 + i, " ".join(t.split())) for i, t in rows[:20]]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), salts=3).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size, r.text_sha256) == want[r.doc_id] and r.kept == (r.doc_id == r.keep_id)


def test_nasty_rows(nasty, nothing):
    got = exact_dedup(nasty).collect()
    assert len(got) == nasty.count()
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r.text_sha256].append(r)
    for rows in by_sha.values():
        assert sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {len(rows)}
    empty = by_sha[hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {6} and len(empty) == 4
    first = by_sha[hashlib.sha256(b"abcdefgh").hexdigest()]
    assert {r.keep_id for r in first} == {2}
    assert exact_dedup(nothing).count() == 0


def test_filter_keeps_columns(docs, nasty):
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - exact_dedup(docs).where("NOT kept").count()
    assert drop_exact_copies(nasty).columns == nasty.columns


def test_plan_has_no_python(docs):
    plan = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastNestedLoop" not in plan


def test_every_group_keeps_one_row_however_the_input_is_made(spark, tmp_path):
    rows = [(i % 900, f"text {i % 500}", f"pad {i}") for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string, pad string").write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    side = d.select("doc_id").distinct()
    for made in (d, d.repartition(7), d.orderBy("pad"), d.join(side, "doc_id"), d.where("doc_id >= 0").coalesce(1), d.repartition(5, "text")):
        got = exact_dedup(made)
        assert got.count() == 4000 and got.where("kept").count() == 500
        assert exact_dedup(made).where("kept").coalesce(3).count() == 500
        assert drop_exact_copies(made).count() == 500


def test_ids_of_any_type(spark):
    rows = [("b", "x y"), ("a", "x  y"), ("c", "xy"), (None, "x  y"), ("a", "z")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.keep_id, r.kept) for r in got) == [("", "a", False), ("a", "a", True), ("a", "a", True), ("b", "a", False), ("c", "a", False)]
