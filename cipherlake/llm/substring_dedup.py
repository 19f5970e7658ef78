"""Removal of long byte strings that occur more than once, by suffix arrays over shards of candidate fragments.

Every window of `length` bytes has a key, the smallest hash among its short grams; equal windows have equal keys. The
windows of a text that follow one another with one key form a fragment. Keys that occur once anywhere are settled;
fragments with equal bytes settle each other; the rest are dealt by key to shards, whose suffix arrays and permuted
common prefixes show which windows occur twice. A key with too many different fragments for one shard is split: its
fragments become texts of their own, with keys from longer grams, down to keys that are whole windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm._frames import Workspace, text_or_empty
from cipherlake.llm._text import U64, _BASE, _BASE_INVERSE, _BYTE_VALUE, _power, column, mix64, utf8_buffers
from cipherlake.llm.near_dedup import whole_groups
from cipherlake.llm.suffix_arrays import repeated_starts
from cipherlake.shipping import ship_package

#: Bytes of a gram on the first level, at most; a window must hold several.
GRAM = 32
#: Windows of a fragment, at least, within text that repeats itself.
STRIDE = 64
#: Bytes of fragments that share one suffix array.
SHARD_BYTES = 2 << 20


class Prefix:
    """Polynomial sums over one text: the hash of any span in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.empty(n + 1, dtype=U64)
        self.sums[0] = 0
        np.cumsum(_BYTE_VALUE[data] * _power("base", _BASE, n), out=self.sums[1:])
        self.inverse = _power("inverse", _BASE_INVERSE, n + 1)

    def grams(self, size: int) -> np.ndarray:
        """The hash of each `size`-byte gram, by start."""
        return mix64((self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values, in three passes whatever the width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(U64).max, dtype=U64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def gram_sizes(length: int) -> list[int]:
    """The grams of each level: short ones first, and at last the window itself."""
    return sorted({max(1, min(GRAM, length // 4)), max(1, length * 3 // 4), max(1, length * 15 // 16), length})


def fragments(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, last window, times the key's gram occurs in the text) of each fragment."""
    g = Prefix(data).grams(gram)
    least = sliding_min(g, length - gram + 1)
    changes = np.concatenate([[True], least[1:] != least[:-1]])
    if gram == length:
        changes[:] = True  # every window is a fragment
    else:
        # Where texts repeat themselves, a key's next gram ends a fragment too, after STRIDE windows or more: else runs of
        # different lengths would be different fragments of ever the same windows.
        begun = np.maximum.accumulate(np.where(changes, np.arange(len(least)), 0))
        left = np.flatnonzero((g[: len(least) - 1] == least[:-1]) & ~changes[1:]) + 1
        run, strides = begun[left], (left - begun[left]) // STRIDE
        before = np.concatenate([[0], np.where(run[1:] == run[:-1], strides[:-1], 0)]) if len(left) else strides
        changes[left[strides > before]] = True
    change = np.flatnonzero(changes)[1:]
    first = np.concatenate([[0], change])
    last = np.concatenate([change - 1, [len(least) - 1]])
    key = least[first]
    distinct = np.unique(key)
    # Few grams share the low bits of a key; only those are looked up.
    may = np.zeros(4096, dtype=bool)
    may[(distinct & U64(4095)).astype(np.int64)] = True
    some = g[may[(g & U64(4095)).astype(np.int64)]]
    at = np.minimum(np.searchsorted(distinct, some), len(distinct) - 1)
    times = np.bincount(at[distinct[at] == some], minlength=len(distinct))
    return key, first, last, times[np.searchsorted(distinct, key)]


def merged(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by windows with starts in the given inclusive ranges."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


class Dedup:
    """One run. A level's texts are rows (sha, base, parent, data): whole documents first, then fragments of hot keys;
    `sha` names the document, `base` the first window's place in it, `parent` the key that the fragment had."""

    def __init__(self, df: DataFrame, length: int, group: int, text_col: str, id_col: str):
        ship_package(df.sparkSession)
        self.ws = Workspace(df.sparkSession, "substring-dedup")
        self.length, self.group, self.grams = length, group, gram_sizes(length)
        text = text_or_empty(text_col)
        self.rows = df.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            text.alias("text"),
            F.sha2(text, 256).alias("sha"),
            # Where a text is fetched again: by id, or by content where there is none.
            F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("#"), F.sha2(text, 256))).alias("place"),
        )

    def occurrences(self, texts: DataFrame, level: int) -> DataFrame:
        """sha, base, key, content (128-bit digest), first, last, times for each fragment of each text."""
        length, gram = self.length, self.grams[level]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = utf8_buffers(column(batch, "data"))
                base, parent = (column(batch, c).to_numpy() for c in ("base", "parent"))
                parts, contents, owner = [], [], []
                for r in range(batch.num_rows):
                    if offsets[r + 1] - offsets[r] >= length:
                        own = data[offsets[r] : offsets[r + 1]]
                        key, first, last, times = fragments(own, length, gram)
                        parts.append((mix64(key ^ parent[r].astype(U64)), first + base[r], last + base[r], times))
                        view = memoryview(own)
                        contents += [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
                        owner.append(r)
                if not parts:
                    continue
                rows = pa.array(np.repeat(owner, [len(p[0]) for p in parts]))
                key, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "sha").take(rows), column(batch, "base").take(rows), pa.array(key.view(np.int64)), pa.array(contents, type=pa.binary()), *(pa.array(c.astype(np.int32)) for c in rest)],
                    names=["sha", "base", "key", "content", "first", "last", "times"],
                )

        return texts.mapInArrow(run, "sha binary, base int, key long, content binary, first int, last int, times int")

    def pieces(self, wanted: DataFrame, texts: DataFrame, level: int) -> DataFrame:
        """key, hot, sha, first, bytes of the wanted fragments (key, hot, sha, base, first, last)."""
        length = self.length
        lists = wanted.groupBy("sha", "base").agg(F.collect_list(F.struct("key", "hot", "first", "last")).alias("parts"))
        if level:
            lists = self.ws.save(lists, f"lists{level}")
            found = texts.select("sha", "base", "data").join(lists, ["sha", "base"]).select("sha", "base", "data", "parts")
        else:
            lists = lists.join(self.classes.select("sha", "place"), "sha").select(F.col("place").alias("at"), F.col("sha").alias("wanted"), "base", "parts")
            lists = self.ws.save(lists, f"lists{level}")
            found = self.rows.join(lists.hint("shuffle_hash"), F.col("place") == F.col("at")).where(F.unhex("sha") == F.col("wanted"))
            found = found.select(F.col("wanted").alias("sha"), "base", F.col("text").alias("data"), "parts")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()  # rows may repeat an id and its text
            for batch in batches:
                data, offsets = utf8_buffers(column(batch, "data"))
                shas, bases, parts = (column(batch, c).to_pylist() for c in ("sha", "base", "parts"))
                rows = []
                for r in range(batch.num_rows):
                    if (shas[r], bases[r]) in seen:
                        continue
                    seen.add((shas[r], bases[r]))
                    own = data[offsets[r] : offsets[r + 1]]
                    rows += [(p["key"], p["hot"], shas[r], p["first"], own[p["first"] - bases[r] : p["last"] - bases[r] + length].tobytes()) for p in parts[r]]
                kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.binary()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "hot", "sha", "first", "bytes"])

        return self.ws.save(found.mapInArrow(cut, "key long, hot boolean, sha binary, first int, bytes binary"), f"pieces{level}")

    def shard_runs(self, pieces: DataFrame) -> DataFrame:
        """sha, first, last: repeated windows of the pieces, whose keys all have few enough for one shard."""
        length = self.length

        def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def settle(tables: list[pa.Table]) -> pa.RecordBatch:
                table = pa.concat_tables(tables).combine_chunks()
                data, offsets = utf8_buffers(table.column("bytes").combine_chunks())
                masks = repeated_starts([data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], length)
                runs = [_runs(m) for m in masks]
                owner = np.repeat(np.arange(len(runs)), [len(a) for a, _ in runs])
                first = table.column("first").to_numpy()[owner]
                starts, ends = (np.concatenate([r[k] for r in runs]) if runs else np.zeros(0, int) for k in (0, 1))
                sha = table.column("sha").combine_chunks().take(pa.array(owner, type=pa.int64()))
                return pa.RecordBatch.from_arrays([sha, pa.array((first + starts).astype(np.int32)), pa.array((first + ends).astype(np.int32))], names=["sha", "first", "last"])

            held, size = [], 0
            for table in whole_groups(batches, "key"):
                # Groups of a key go together; a table of several is cut between keys.
                keys = table.column("key").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    group = table.slice(a, b - a)
                    held.append(group)
                    size += sum(len(x.as_buffer()) for x in group.column("bytes"))
                    if size >= SHARD_BYTES:
                        yield settle(held)
                        held, size = [], 0
            if held:
                yield settle(held)

        dealt = pieces.select("key", "sha", "first", "bytes").repartition("key").sortWithinPartitions("key")
        return dealt.mapInArrow(induce, "sha binary, first int, last int")

    def level_runs(self, texts: DataFrame, level: int) -> DataFrame:
        """sha, first, last: windows of the texts that occur elsewhere in them."""
        save = lambda df, name: self.ws.save(df, f"{name}{level}")
        every = save(self.occurrences(texts, level), "occurrences")
        keys = save(every.groupBy("key").agg(F.sum("times").alias("total")).where("total > 1").select("key"), "keys")
        seen = every.join(keys, "key").groupBy("key", "content", "sha", "base", "first", "last", "times").agg(F.count(F.lit(1)).alias("copies"))
        seen = save(seen, "seen")
        self.ws.drop(f"occurrences{level}", f"keys{level}")
        contents = seen.groupBy("key", "content").agg(F.sum("copies").alias("n"), F.min(F.struct("sha", "base", "first", "last")).alias("one"), F.max("times").alias("times"))
        contents = save(contents, "contents")
        # Fragments with equal bytes: all their windows occur elsewhere.
        twins = contents.where("n > 1").select("key", "content")
        runs = seen.join(twins, ["key", "content"]).select("sha", "first", "last")
        unlike = contents.groupBy("key").agg(F.count(F.lit(1)).alias("contents"), F.max("times").alias("most"))
        deeper = level + 1 < len(self.grams)
        unlike = save(unlike.where("contents > 1 OR most > 1").select("key", (F.col("contents") > (self.group if deeper else 1 << 62)).alias("hot")), "unlike")
        wanted = contents.join(unlike, "key").select("key", "hot", "one.sha", "one.base", "one.first", "one.last")
        pieces = self.pieces(wanted, texts, level)
        runs = runs.unionAll(self.shard_runs(pieces.where("NOT hot")))
        if deeper and not unlike.where("hot").isEmpty():
            split = pieces.where("hot").select("sha", F.col("first").alias("base"), F.col("key").alias("parent"), F.col("bytes").alias("data"))
            runs = runs.unionAll(self.level_runs(split, level + 1))
        return runs

    def run(self) -> DataFrame:
        length = self.length
        classes = self.rows.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("place").alias("place"), F.max(F.octet_length("text")).alias("n"))
        classes = self.ws.save(classes.select(F.unhex("sha").alias("sha"), "copies", "place", "n"), "classes")
        whole = classes.where((F.col("copies") > 1) & (F.col("n") >= length))

        self.classes = classes
        texts = self.rows.select(F.unhex("sha").alias("sha"), F.lit(0).alias("base"), F.lit(0).cast("long").alias("parent"), F.col("text").alias("data"))
        runs = self.level_runs(texts, 0)
        runs = runs.join(whole.select("sha"), "sha", "left_anti").groupBy("sha").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
        runs = self.ws.save(runs.join(classes.select("sha", "place"), "sha").select(F.col("sha").alias("wanted"), F.col("place").alias("at"), "runs"), "runs")

        def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = utf8_buffers(column(batch, "text"))
                wanted, lists = column(batch, "wanted"), column(batch, "runs").to_pylist()
                removed, count, kept, spans = [], [], [], []
                for r, own in enumerate(lists):
                    found = merged([(x["first"], x["last"]) for x in own], length)
                    text, at, digest = memoryview(data[offsets[r] : offsets[r + 1]]), 0, hashlib.sha256()
                    for a, b in found:
                        digest.update(text[at:a])
                        at = b
                    digest.update(text[at:])
                    removed.append(sum(b - a for a, b in found))
                    count.append(len(found))
                    kept.append(digest.hexdigest())
                    spans.append([{"start": a, "end": b} for a, b in found])
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([wanted, pa.array(removed, type=pa.int64()), pa.array(count, type=pa.int64()), pa.array(kept, type=pa.string()), pa.array(spans, type=span)], names=["wanted", "n_removed", "n_spans", "kept_sha256", "spans"])

        cut = self.rows.join(runs.hint("shuffle_hash"), F.col("place") == F.col("at")).where(F.unhex("sha") == F.col("wanted")).select("wanted", "text", "runs")
        cut = cut.mapInArrow(remove, "wanted binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>").dropDuplicates(["wanted"])
        gone = whole.select(
            F.col("sha").alias("wanted"),
            F.col("n").cast("long").alias("n_removed"),
            F.lit(1).cast("long").alias("n_spans"),
            F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"),
            F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end"))).alias("spans"),
        )
        results = self.ws.save(cut.unionAll(gone), "results")
        self.ws.keep("results")
        slim = self.rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "sha")
        return slim.join(results, F.unhex("sha") == F.col("wanted"), "left").select(
            "doc_id",
            "n_bytes",
            F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
            F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
            F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
            F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        )


def substring_dedup(df: DataFrame, length: int = 400, group: int = 256, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets, end exclusive).

    A byte is removed if a string of `length` bytes that covers it starts anywhere else as well, in the same text or
    another; overlaps count, and all is judged on the input. Matches don't cross texts.

    Shards are groups of fragment keys of about 2 MB, so their suffix arrays stay small. A key with more than `group`
    different fragments (a passage's edge in very many texts) is split by keys from longer grams, level after level; on
    the last one a key is a whole window, so it has one content, and its occurrences are counted with map-side
    combining. So no task holds a group that grows with the input, and nothing is left out. Fragments count as equal by
    a 128-bit BLAKE2 digest of their bytes. Equal texts are one from the start: copies of at least `length` bytes are
    removed whole. Joins on hot keys are between written tables, so adaptive execution splits them. Texts are fetched
    by id, not by content, so a hot content doesn't gather in a task.

    Null text is empty; texts shorter than `length` lose nothing. Null ids are fetched by content. Repeated rows are
    copies of each other. Other columns are not read. An empty table gives an empty result. The intermediate tables are
    dropped, but for one with a row per text that loses bytes.
    """
    return Dedup(df, length, group, text_col, id_col).run()


def brute_force(rows: list[tuple[int, str | None]], length: int) -> dict[int, tuple[int, int, int, str]]:
    """id -> n_bytes, n_removed, n_spans, kept_sha256, counting every window; for tests."""
    from collections import Counter

    texts = {i: (t or "").encode() for i, t in rows}
    count = Counter(t[k : k + length] for t in texts.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, dtype=bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[1:-1] & ~gone[:-2]).sum() + gone[0]) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out
