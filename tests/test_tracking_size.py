"""Tracked findings without digests: the size of what a bucket keeps, and the fingerprints that changes get."""

import hashlib
import os

import pandas as pd
from pyspark.sql import functions as F
from test_tracking import Clock, Store

from cipherlake import queries as Q
from cipherlake.streaming.tracking import FOUND, FindingTracker, found_of_files, track_changes


def found(names):
    return [{"fingerprint": None, "line_number": line, "algorithm_detected": algorithm, "severity": "HIGH"} for line, algorithm in names]


def frame(rows):
    return iter([pd.DataFrame([(path, at, found(names)) for path, at, names in rows], columns=["file_path", "seen_us", "found"])])


def test_state_takes_few_bytes_a_file_and_names_findings_by_place():
    store, tracker = Store(), FindingTracker(1_000)
    tracker.init(store)
    names = [f"supplier-{k * 7919 % 1_000}/{k * 104_729 % 150_000}/requirements.txt" for k in range(500)]
    list(tracker.handleInputRows((0,), frame([(n, 5_000, [(1 + k % 7, "RSA"), (1 + k % 7, "AES")]) for k, n in enumerate(names)]), None))
    assert len(store.value[0]) < 40 * len(names)  # some 300 bytes a file as JSON with digests
    out = pd.concat(list(tracker.handleInputRows((0,), frame([(names[0], 6_000, [(1, "AES"), (2, "RSA")])]), None)))
    assert sorted(zip(out["line_number"], out["algorithm_detected"], out["change"], out["first_seen"])) == [(1, "RSA", "removed", 5_000), (2, "RSA", "added", 6_000)]
    gone = pd.concat(list(tracker.handleExpiredTimer((0,), Clock(10_000), Clock(9_999))))
    assert len(gone) == 2 * len(names) and sorted(gone["first_seen"][gone["file_path"] == names[0]]) == [5_000, 6_000]


def test_changes_get_their_fingerprints(spark, tmp_path):
    files = found_of_files(spark.createDataFrame([("f", 1, "RSA", "HIGH"), ("f", 1, "RSA", "HIGH"), ("f", 2, "AES", "LOW"), ("g", 1, "RSA", "HIGH")], "file_path string, line_number int, algorithm_detected string, severity string"))
    files.select("file_path", F.lit("2024-01-01").cast("timestamp").alias("seen_at"), "found").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"file_path string, seen_at timestamp, found {FOUND}").parquet(str(tmp_path / "in"))
    query = track_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.file_path, r.line_number, r.fingerprint) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(f, n, hashlib.sha256(f"{f}:{n}:{a}".encode()).hexdigest()) for f, n, a in (("f", 1, "RSA"), ("f", 2, "AES"), ("g", 1, "RSA"))]


def test_no_table_of_the_tracked_difference_holds_digests(spark, sf_dir):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert Q.queries()["tracked_diff"](spark, sf_dir).count()
    new = [f"{folder}/{n}" for n in os.listdir(folder) if n not in before and n.startswith("tracked-")]
    assert len(new) == 1
    assert spark.read.parquet(f"{new[0]}/scans").select(F.explode("found")).where("col.fingerprint IS NOT NULL").count() == 0
    changes = spark.read.parquet(f"{new[0]}/changes")
    assert "fingerprint" not in changes.columns and changes.count() == Q.queries()["stored_diff"](spark, sf_dir).count()
