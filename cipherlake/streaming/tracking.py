"""Findings over time: keyed state of a stream of scanned files, with first and last sight and removal by timer. An
extension."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cipherlake.operators.findings import fingerprint
from cipherlake.plans.scan import scan_files
from cipherlake.shipping import ship_package

#: A finding's fingerprint may be null: within its file, line and algorithm tell as much.
FOUND = "array<struct<fingerprint:string,line_number:int,algorithm_detected:string,severity:string>>"
#: As the tracker gives them; times are microseconds.
CHANGES = "file_path string, fingerprint string, line_number int, algorithm_detected string, severity string, change string, first_seen long, last_seen long"
_NAMES = [c.split()[0] for c in CHANGES.split(", ")]


def found_of_files(findings: DataFrame, *keys: str) -> DataFrame:
    """(file_path, keys, found): each file's findings as one array, without fingerprints, which `track_changes` adds.

    Findings are shuffled as they are, once: hardly any two of a task are of one file, so arrays of a task would be larger.
    """
    own = findings.select("file_path", *keys, "line_number", "algorithm_detected", "severity").repartition("file_path", *keys)
    item = F.struct(F.lit(None).cast("string").alias("fingerprint"), "line_number", "algorithm_detected", "severity")
    return own.groupBy("file_path", *keys).agg(F.array_sort(F.collect_set(item)).cast(FOUND).alias("found"))


def file_scans(files: DataFrame) -> DataFrame:
    """(file_path, seen_at, found) of scanned (file_path, rel_path, content, seen_at), sources and manifests alike: each
    file's findings as one array of the file's own size, empty for files without any."""
    found = found_of_files(scan_files(files))
    return files.select("file_path", "seen_at").join(found, "file_path", "left").withColumn("found", F.coalesce("found", F.array().cast(FOUND)))


class FindingTracker(StatefulProcessor):
    """Of one bucket of files: of each file the findings of its latest version, each with its first and last sight.

    A bucket's state is read and written once for all of its files in a micro-batch, as calls to the state store cost far
    more than their contents; a bucket has one timer, for the file that expires next.
    """

    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Deflated JSON: path, latest version (microseconds), and fingerprint, line, algorithm, severity, first and last sight of each finding.
        self.files = handle.getValueState("files", "files binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._read()
        versions = pd.concat(list(rows)).sort_values("seen_us", kind="stable")
        changes = []
        for path, at, found in zip(versions["file_path"].tolist(), versions["seen_us"].tolist(), versions["found"].tolist(), strict=True):
            latest, before = known.get(path, (None, {}))
            if latest is not None and at <= latest:
                continue  # an older version, late
            now = {}
            for f in found:
                what = [f["fingerprint"], f["line_number"], f["algorithm_detected"], f["severity"]]
                name = self._name(what)
                now[name] = [*what, before[name][4] if name in before else at, at]
            changes += [(path, *state[:4], "removed", *state[4:]) for name, state in before.items() if name not in now]
            changes += [(path, *state[:4], "added", *state[4:]) for name, state in now.items() if name not in before]
            known[path] = (at, now)
        self._write(known)
        yield self._frame(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Files that were not seen for long count as removed."""
        known, limit = self._read(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        gone = [path for path, (latest, _) in known.items() if self._expiry(latest) < limit]
        changes = [(path, *state[:4], "removed", *state[4:]) for path in gone for state in known.pop(path)[1].values()]
        self._write(known)
        yield self._frame(changes)

    @staticmethod
    def _name(finding: list):
        """What tells a finding from others of its file."""
        return (finding[1], finding[2]) if finding[0] is None else finding[0]

    def _expiry(self, latest: int) -> int:
        return latest // 1_000 + self.expire_ms

    def _read(self) -> dict:
        if not self.files.exists():
            return {}
        return {path: (latest, {self._name(state): state for state in found}) for path, latest, found in json.loads(zlib.decompress(self.files.get()[0]))}

    def _write(self, known: dict) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if not known:
            self.files.clear()
            return
        packed = json.dumps([[path, latest, list(found.values())] for path, (latest, found) in known.items()], separators=(",", ":"))
        self.files.update((zlib.compress(packed.encode()),))
        self.handle.registerTimer(self._expiry(min(latest for latest, _ in known.values())))

    @staticmethod
    def _frame(changes: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(changes, columns=_NAMES)


def track_changes(scans: DataFrame, expire: str = "30 days", delay: str = "1 hour", buckets: int = 4_096) -> DataFrame:
    """Changes (file_path, fingerprint, line_number, algorithm_detected, severity, change, first_seen, last_seen) of a stream of file versions (file_path, seen_at, found; see `file_scans`).

    A version replaces the one before it: findings that it lacks are removed, new ones added; versions older than the
    latest are ignored. A file that is not seen for `expire`, in event time, is removed with all its findings. A finding
    without a fingerprint is told by its line and algorithm, and changes give the fingerprint that follows from them and
    the path; so neither scans nor state need hold digests. All versions of a file have them, or none. State is
    keyed by buckets of files and holds their current findings, in RocksDB, deflated. Choose `buckets` so that one holds some hundred
    files, and the same whenever a stream is resumed; a task holds one bucket at a time.
    """
    spark = scans.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    expire_ms = int(pd.Timedelta(expire).total_seconds() * 1_000)
    versions = scans.select("file_path", "seen_at", "found").withWatermark("seen_at", delay).withColumn("seen_us", F.unix_micros("seen_at"))
    versions = versions.withColumn("bucket", F.pmod(F.xxhash64("file_path"), F.lit(buckets)))
    changes = versions.groupBy("bucket").transformWithStateInPandas(FindingTracker(expire_ms), CHANGES, "Append", "EventTime")
    times = {c: F.timestamp_micros(c) for c in ("first_seen", "last_seen")}
    return changes.withColumns({"fingerprint": F.coalesce("fingerprint", fingerprint()), **times})


def scan_stream(files: DataFrame, path: str, checkpoint: str):
    """Starts scanning a stream of (file_path, rel_path, content, seen_at): each micro-batch's `file_scans` are appended to
    the table at `path`, which `track_changes` can follow. A batch that is repeated writes its own folder again."""

    def keep(batch: DataFrame, number: int) -> None:
        file_scans(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
