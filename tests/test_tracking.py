"""The finding tracker on many files of one bucket, without Spark."""

import pandas as pd

from cipherlake.streaming.tracking import FindingTracker


class Store:
    """Stands in for a key's state and timers, and counts the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        self.calls += 1
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def finding(name):
    return {"fingerprint": name, "line_number": 1, "algorithm_detected": "RSA", "severity": "HIGH"}


def test_many_files_of_a_bucket_take_few_calls_and_expire_each_at_its_time():
    store, tracker = Store(), FindingTracker(1_000)
    tracker.init(store)
    rows = [(None if k == 0 else f"f{k}", 1_000 * k, [finding(f"p{k}")]) for k in range(500)]
    rows += [("f7", 9_000, []), ("f8", 7_000, [])]  # a newer version without findings, and one that is late
    out = pd.concat(list(tracker.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["file_path", "seen_us", "found"])]), None)))
    assert store.calls < 10
    assert sorted(out["fingerprint"][out["change"] == "added"]) == sorted(f"p{k}" for k in range(500))
    assert out[["file_path", "fingerprint", "first_seen", "last_seen"]][out["change"] == "removed"].values.tolist() == [["f7", "p7", 7_000, 7_000]]
    assert store.timers == [1_000]
    gone = pd.concat(list(tracker.handleExpiredTimer((0,), Clock(1_100), Clock(1_000))))
    assert len(gone) == 99 and set(gone["change"]) == {"removed"}  # files 0 to 99, but 7, which had none left
    assert store.timers == [1_100]
    again = pd.concat(list(tracker.handleInputRows((0,), iter([pd.DataFrame([("f5", 5_000, [finding("p5")])], columns=["file_path", "seen_us", "found"])]), None)))
    assert again["change"].tolist() == ["added"]  # known no more
