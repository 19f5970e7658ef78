"""Incremental scans of a stream of manifest texts. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cipherlake.operators.findings import fingerprint
from cipherlake.operators.manifest import scan_lines


def new_findings(files: DataFrame, event_time: str = "seen_at", delay: str = "1 hour") -> DataFrame:
    """Findings of a stream of (file_path, text, event time), each fingerprint once within the watermark's delay.

    State holds the fingerprints of the delay's span only. A static frame gives each fingerprint once.
    """
    marked = files.withWatermark(event_time, delay) if files.isStreaming else files
    found = scan_lines(marked, event_time).withColumn("fingerprint", fingerprint())
    return found.dropDuplicatesWithinWatermark(["fingerprint"]) if files.isStreaming else found.dropDuplicates(["fingerprint"])
