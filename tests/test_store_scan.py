"""What storing a scan costs."""

import uuid

from cipherlake.operators import findings as FD


def test_a_stored_scan_is_shuffled_once(spark):
    rows = [(f"f{k % 30}", k % 3, "RSA", f"snippet {k}") for k in range(90)]
    found = spark.createDataFrame(rows, "file_path string, line_number int, algorithm_detected string, code_snippet string")
    name, group = f"scan_{uuid.uuid4().hex}", uuid.uuid4().hex
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.sparkContext.setJobGroup(group, "store")
    try:
        FD.store_scan(found, name, 3)
        tracker = spark.sparkContext.statusTracker()
        stages = [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(stages) == 2  # a shuffle's two sides; with a second shuffle there were three
    want = FD.dedupe(found)
    assert sorted(spark.table(name).select(want.columns).collect()) == sorted(want.collect())
    spark.sql(f"DROP TABLE {name}")
