"""Exact n-gram Jaccard join with set-relation skipping.

Documents become sets of word shingles, equal sets become one. Highly similar sets form families: a leader, and members
that are kept as their difference from it. Index lists over the rarest shingles of every set hold a block for each family;
blocks are skipped by size and position. What lies between two families is derived from their leaders' overlap and the
members' differences. Links become components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm._frames import Workspace, small_batches, text_or_empty
from cipherlake.llm._text import U64, column, mix64, shingle_sets, spans, utf8_buffers
from cipherlake.llm.near_dedup import COLUMNS, Join, brute_force, whole_groups
from cipherlake.shipping import ship_package

__all__ = ["brute_force", "jaccard_join"]

#: Minwise tokens by which families are looked for.
N_MIN = 4
#: Counters of shingles, by the upper bits of their hash; they order shingles from rare to common. Of fixed size.
COUNTER_BITS, SLICE_BITS = 20, 14
CHUNK_BYTES = 1 << 18
#: Shingles counted at once; postings of a parcel, of a shard, and of what a task sorts at once.
COUNTED, PARCEL, SHARD, SORTED = 1 << 18, 1 << 17, 1 << 19, 1 << 18
#: Rows that a task hands on at once.
PORTION = 1 << 15
#: Blocks of an index list: in a cell, in a stretch that is skipped as one, and in lists taken row by row.
LIST, STRETCH, SHORT = 1 << 14, 256, 32
#: Blocks of a long list that all others of it are compared with first.
PIVOTS = 8
#: Bits of a set's parities, a power of two.
PARITIES = 512
#: Members of a block of a family, when two families are compared.
MEMBERS = 512

_SEEDS = np.random.default_rng(1711).integers(1, 2**63, N_MIN, dtype=np.int64).astype(U64)


def least_overlap(percent: int, total: np.ndarray) -> np.ndarray:
    """The smallest overlap of two sets of that total size with the similarity."""
    return -(-percent * total // (100 + percent))


def binary16(keys: np.ndarray) -> pa.Array:
    """V16 values as binary."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())


def sets_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, list[np.ndarray], list[bytes]]]:
    """Row ranges [i, j) of a batch with their rows' shingle sets and texts."""
    data, offsets = utf8_buffers(column(batch, "text"))
    for i, j in spans(offsets, CHUNK_BYTES):
        texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
        yield i, j, shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width), texts


def key_of(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def parities(tokens: np.ndarray, bits: int = PARITIES) -> bytes:
    """For each of so many bins (a power of two) whether it holds an odd number of the tokens, packed: two sets differ in at
    least as many tokens as their parities do in bits."""
    return np.packbits((np.bincount((mix64(tokens) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_parities(tokens: np.ndarray) -> bytes:
    """Parities of at least two bits a token: so many that sets which are not similar nearly always show it."""
    return parities(tokens, max(PARITIES, 1 << (2 * len(tokens) - 1).bit_length()))


def fewest_differences(x: bytes, y: bytes) -> int:
    """In how many tokens at least two sets differ, by their parities; the longer ones are folded."""
    x, y = (np.frombuffer(v, dtype=np.uint8) for v in sorted((x, y), key=len))
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds. Of documents: doc_id, n_shingles, set_key, text_key, mins, parities, wide. Of counters, where `slice` is not
    null: how many of a task's sets hold shingles of each hash range, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, waiting, n_waiting = np.zeros(1 << COUNTER_BITS, dtype=np.int32), [], 0
        id_type = None

        def count() -> None:
            nonlocal n_waiting
            if waiting:
                found, times = np.unique((np.concatenate(waiting) >> U64(64 - COUNTER_BITS)).astype(np.int32), return_counts=True)
                counters[found] += times.astype(np.int32)
                waiting.clear()
                n_waiting = 0

        def out(ids: pa.Array, sizes, keys, texts, mins, bits, wide, slices, counts) -> pa.RecordBatch:
            arrays = [ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(texts, pa.string()), pa.array(mins, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), pa.array(slices, pa.int32()), pa.array(counts, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_key", "text_key", "mins", "parities", "wide", "slice", "counts"])

        for batch in batches:
            ids = column(batch, "doc_id")
            id_type = ids.type
            for i, j, sets, texts in sets_of(batch, width):
                mins = [[int(mix64(s ^ c).min().view(np.int64)) for c in _SEEDS] if len(s) else None for s in sets]
                none = [None] * (j - i)
                yield out(ids.slice(i, j - i), [len(s) for s in sets], [key_of(s) for s in sets], [hashlib.md5(t).hexdigest() for t in texts], mins, [parities(s) if len(s) else None for s in sets], [wide_parities(s) if len(s) else None for s in sets], none, none)
                waiting += sets
                n_waiting += sum(len(s) for s in sets)
                if n_waiting > COUNTED:
                    count()
        count()
        if counters.any():
            n = 1 << (COUNTER_BITS - SLICE_BITS)
            parts = counters.reshape(n, -1)
            packed = [np.append(np.uint8(p.itemsize), p.view(np.uint8)).tobytes() for p in (row.astype(np.min_scalar_type(row.max())) for row in parts)]
            none = [None] * n
            yield out(pa.nulls(n, id_type), none, none, none, none, none, none, list(range(n)), packed)

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, set_key binary, text_key string, mins array<long>, parities binary, wide binary, slice int, counts binary")


def total_counters(rows: DataFrame) -> np.ndarray:
    """The counters' sums over all tasks: added up on executors slice by slice; the driver gets their fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(column(batch, "slice").to_pylist(), column(batch, "counts").to_pylist(), strict=True):
                values = np.frombuffer(packed, dtype=f"u{packed[0]}", offset=1).astype(np.int64)
                sums[k] = sums[k] + values if k in sums else values
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "counts"])

    found = rows.where("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(run, "slice int, counts binary").collect()
    counters = np.zeros((1 << (COUNTER_BITS - SLICE_BITS), 1 << SLICE_BITS), dtype=np.int64)
    for r in found:
        counters[r.slice] = np.frombuffer(r.counts, dtype=np.int64)
    return counters.reshape(-1)


def postings(docs: DataFrame, width: int, percent: int, counters: np.ndarray, n_shards: int) -> DataFrame:
    """token, set_key, size, rest, is_index: prefix postings of tokens that several sets have in their prefixes.

    A set's prefix is its rarest shingles, as many as it takes for any similar set to share one; `is_index` marks those
    that suffice where the set is the smaller one; `rest` counts the shingles after it. Parcels of packed postings go to
    token shards, where tokens of one set only are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of, seen, held, n_held = shared.value, set(), [], 0

        def out() -> pa.RecordBatch:
            tokens, keys, sizes, rests = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = (tokens % U64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            edges = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]])
            parcels = [b"".join(x[order[a:b]].tobytes() for x in (tokens, keys, sizes, rests)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(shard[order][edges[:-1]]), pa.array(parcels, pa.binary())], names=["shard", "parcel"])

        for batch in batches:
            for _, _, sets, _ in sets_of(batch, width):
                for s in sets:
                    key = key_of(s)
                    if key is None or key in seen:
                        continue
                    seen.add(key)
                    n = len(s)
                    p = n + 1 - -(-percent * n // 100)
                    first = np.lexsort((s, order_of[(s >> U64(64 - COUNTER_BITS)).astype(np.int64)]))[:p]
                    held.append((s[first], np.full(p, np.void(key)), np.full(p, n, dtype=np.int32), (n - 1 - np.arange(p)).astype(np.int32)))
                    n_held += p
                if n_held > PARCEL:
                    yield out()
                    held, n_held = [], 0
        if held:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(parcel: bytes) -> list[np.ndarray]:
            n, at, found = len(parcel) // 32, 0, []
            for kind, size in (("u8", 8), ("V16", 16), ("i4", 4), ("i4", 4)):
                found.append(np.frombuffer(parcel, dtype=kind, count=n, offset=at))
                at += n * size
            return found

        held: list[list[np.ndarray]] = []
        known = np.zeros(0, dtype=U64)

        def out() -> Iterator[pa.RecordBatch]:
            # Tokens seen once so far wait; those of a second set, and all after them, go on.
            nonlocal held, known
            tokens, keys, sizes, rests = (np.concatenate(x) for x in zip(*held, strict=True))
            halves = keys.view("u8").reshape(-1, 2)
            order = np.lexsort((halves[:, 1], halves[:, 0], tokens))
            t, h = tokens[order], halves[order]
            new_token = np.concatenate([[True], t[1:] != t[:-1]])
            new = new_token | np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)])
            order, t, new_token = order[new], t[new], new_token[new]
            starts = np.flatnonzero(new_token)
            counts = np.diff(np.append(starts, len(t)))
            distinct = t[starts]
            at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
            is_shared = (counts > 1) | (known[at] == distinct if len(known) else False)
            known = np.union1d(known, distinct[is_shared])
            go = order[np.repeat(is_shared, counts)]
            stay = order[np.repeat(~is_shared, counts)]
            held = [[tokens[stay], keys[stay], sizes[stay], rests[stay]]]
            size = sizes[go].astype(np.int64)
            is_index = size - 1 - rests[go] <= size - least_overlap(percent, 2 * size)
            out = pa.RecordBatch.from_arrays([pa.array(tokens[go].view(np.int64)), binary16(keys[go]), pa.array(sizes[go]), pa.array(rests[go]), pa.array(is_index)], names=["token", "set_key", "size", "rest", "is_index"])
            for at in range(0, max(1, out.num_rows), PORTION):
                yield out.slice(at, PORTION)

        for batch in batches:
            for parcel in column(batch, "parcel").to_pylist():
                held.append(columns(parcel))
                if sum(len(x[0]) for x in held[1:]) > SORTED:
                    yield from out()
        if held:
            yield from out()

    parcels = docs.mapInArrow(deal, "shard long, parcel binary").repartition(n_shards, "shard")
    return parcels.mapInArrow(meet, "token long, set_key binary, size int, rest int, is_index boolean")


def list_pairs(blocks: DataFrame, percent: int, by_pivots: bool) -> DataFrame:
    """a, b: leaders whose blocks in an index list allow a link and have different labels. blocks: token, lead, label,
    score, lo, hi (sizes), rest (largest), is_index; in lists of more than SHORT blocks also n (the leader's size), apart (its
    members' distance) and parities of the leader: pairs that cannot lie within the members' reach are not made there.

    Lists of more than LIST blocks are cut into parts, and a cell takes two parts. `by_pivots`: of a cell with more than
    SHORT blocks, only pairs with one of the PIVOTS with the highest score; otherwise only long lists are looked at.
    """
    counts = blocks.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (1 if by_pivots else SHORT))
    counts = counts.select("token", F.ceil(F.col("n") / LIST).cast("int").alias("parts"), F.col("n").alias("in_list"))
    own = F.pmod(F.xxhash64("lead"), F.col("parts")).cast("int")
    met = blocks.join(counts, "token").withColumn("part", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("token", F.least("part", "j"), F.greatest("part", "j"))
    dealt = met.select(cell.alias("cell"), (F.col("part") < F.col("j")).alias("first"), (F.col("part") == F.col("j")).alias("inner"), "lead", "label", "score", "lo", "hi", "rest", "is_index", *[F.when(F.col("in_list") > SHORT, F.col(c)).alias(c) for c in ("n", "apart", "parities")])
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            table = table.combine_chunks()
            cell, score, lo, hi, rest = (table.column(c).to_numpy().astype(np.int64) for c in ("cell", "score", "lo", "hi", "rest"))
            is_index, first, inner = (table.column(c).to_numpy(zero_copy_only=False) for c in ("is_index", "first", "inner"))
            keys, lead = np.unique(np.frombuffer(b"".join(table.column("lead").to_pylist()), dtype="V16"), return_inverse=True)
            label = np.unique(np.frombuffer(b"".join(table.column("label").to_pylist()), dtype="V16"), return_inverse=True)[1]
            n, apart = (table.column(c).fill_null(0).to_numpy() for c in ("n", "apart"))
            known = table.column("parities").is_valid().to_numpy(zero_copy_only=False)
            bits = np.frombuffer(b"".join(x or bytes(PARITIES // 8) for x in table.column("parities").to_pylist()), dtype=U64).reshape(len(cell), -1)
            pairs: list[np.ndarray] = []

            def test(i: np.ndarray, j: np.ndarray) -> None:
                good = (is_index[i] | is_index[j]) & (inner[i] | (first[i] != first[j])) & (label[i] != label[j])  # noqa: B023
                good &= (100 * hi[j] >= percent * lo[i]) & (100 * hi[i] >= percent * lo[j])  # noqa: B023
                good &= 1 + np.minimum(rest[i], rest[j]) >= least_overlap(percent, lo[i] + lo[j])  # noqa: B023
                i, j = i[good], j[good]
                differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)  # noqa: B023
                reach = 1 - percent / 100 + apart[i] + apart[j] + 1e-9  # noqa: B023
                near = ~(known[i] & known[j]) | (2 * differ <= reach * (n[i] + n[j] + differ))  # noqa: B023
                x, y = lead[i[near]], lead[j[near]]  # noqa: B023
                pairs.append(np.unique(np.minimum(x, y) * len(keys) + np.maximum(x, y)))  # noqa: B023

            edges = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            sizes = np.diff(edges)
            is_short = np.repeat(sizes <= SHORT, sizes)
            for d in range(1, SHORT):
                i = np.flatnonzero((cell[:-d] == cell[d:]) & is_short[d:])
                if not len(i):
                    break
                test(i, i + d)
            for s, e in zip(edges[:-1][sizes > SHORT].tolist(), edges[1:][sizes > SHORT].tolist(), strict=True):
                if by_pivots:
                    pivots = s + np.lexsort((lead[s:e], -score[s:e]))[:PIVOTS]
                    test(np.repeat(pivots, e - s), np.tile(np.arange(s, e), len(pivots)))
                    continue
                # By position: within a list, stretches of like rest; a pair of stretches is skipped by its bounds.
                order = s + np.argsort(-rest[s:e], kind="stable")
                cuts = np.arange(0, e - s, STRETCH)
                low, high = np.minimum.reduceat(lo[order], cuts), np.maximum.reduceat(hi[order], cuts)
                top, any_index = rest[order[cuts]], np.logical_or.reduceat(is_index[order], cuts)
                one, last = np.minimum.reduceat(label[order], cuts), np.maximum.reduceat(label[order], cuts)
                for k in range(len(cuts)):
                    reach = (1 + np.minimum(top[k], top[k:]) >= least_overlap(percent, low[k] + low[k:])) & (any_index[k] | any_index[k:])
                    reach &= (100 * high[k:] >= percent * low[k]) & (100 * high[k] >= percent * low[k:])
                    # Stretches of one and the same component have no pair to offer.
                    reach &= ~((one[k] == last[k]) & (one[k:] == one[k]) & (last[k:] == one[k]))
                    mine = order[cuts[k] : cuts[k] + STRETCH]
                    for m in (np.flatnonzero(reach) + k).tolist():
                        other = order[cuts[m] : cuts[m] + STRETCH]
                        test(np.repeat(mine, len(other)), np.tile(other, len(mine)))
            found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([binary16(keys[found // max(len(keys), 1)]), binary16(keys[found % max(len(keys), 1)])], names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary").groupBy("a", "b").agg(F.lit(True).alias("met")).select("a", "b")


def tokens_of(packed: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U64) for x in packed]


class JaccardJoin(Join):
    """One run; steps are written to the shared folder, and components are merged as in near-dedup."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        ship_package(docs.sparkSession)
        self.ws, self.step = Workspace(docs.sparkSession, "jaccard"), 0
        self.docs, self.width, self.percent = docs, width, percent

    def within_reach(self, pairs: DataFrame, widest: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) whose wide parities allow a link between them, or between members of their families, which are
        `apart` from them by at most what `widest` (lead, apart) says. Only these few bits a token are joined with pairs."""
        percent = self.percent
        for side in "ab":
            own = self.sets.select(F.col("set_key").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("wide").alias(f"wide_{side}"))
            if widest is not None:
                own = own.join(widest.select(F.col("lead").alias(side), F.col("apart").alias(f"apart_{side}")), side, "left").fillna(0.0, [f"apart_{side}"])
            else:
                own = own.withColumn(f"apart_{side}", F.lit(0.0))
            pairs = pairs.join(own, side)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (column(batch, c).to_pylist() for c in ("wide_a", "wide_b"))
                differ = np.array([fewest_differences(*z) for z in zip(x, y, strict=True)], dtype=np.int64)
                n, apart = (column(batch, f"{c}_a").to_numpy() + column(batch, f"{c}_b").to_numpy() for c in ("n", "apart"))
                good = 2 * differ <= (1 - percent / 100 + apart + 1e-9) * (n + differ)
                yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero(good)))

        return self.save(pairs.mapInArrow(run, "a binary, b binary"))

    def overlaps(self, pairs: DataFrame, shingles: DataFrame, with_difference: bool) -> DataFrame:
        """a, b, n_a, n_b, common of the pairs; and, if asked for, of those that are linked only, added (a without b) and
        removed (b without a), packed."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, sizes, added, removed = [], [], [], []
                for k, (x, y) in enumerate(zip(tokens_of(column(batch, "xs")), tokens_of(column(batch, "ys")), strict=True)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if with_difference:
                        if 100 * common < percent * (len(x) + len(y) - common):
                            continue
                        added.append(np.setdiff1d(x, y, assume_unique=True).tobytes())
                        removed.append(np.setdiff1d(y, x, assume_unique=True).tobytes())
                    rows.append(k)
                    sizes.append((len(x), len(y), common))
                arrays = [*batch.select(["a", "b"]).take(pa.array(rows, pa.int64())).columns, *(pa.array([s[k] for s in sizes], pa.int64()) for k in range(3))]
                names = ["a", "b", "n_a", "n_b", "common"]
                if with_difference:
                    arrays, names = arrays + [pa.array(added, pa.binary()), pa.array(removed, pa.binary())], [*names, "added", "removed"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        one = shingles.select(F.col("set_key").alias("a"), F.col("shingles").alias("xs"))
        two = shingles.select(F.col("set_key").alias("b"), F.col("shingles").alias("ys"))
        schema = "a binary, b binary, n_a long, n_b long, common long" + (", added binary, removed binary" if with_difference else "")
        return self.save(pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(run, schema))

    def families(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(members, links, shingles): members (set_key, lead, n_shingles, apart, added, removed), each linked to its leader
        and `apart` by Jaccard distance; all links found on the way; the sets looked at.

        A set's candidates are the smallest sets with the same minwise token, for each of N_MIN functions; a leader is one
        that has no leader itself. Sets outside members lead themselves.
        """
        entries = self.save(self.sets.select("set_key", "n_shingles", F.posexplode("mins").alias("k", "m")))
        smallest = entries.groupBy("k", "m").agg(F.min(F.struct("set_key", "n_shingles")).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
        smallest = self.save(smallest.select("k", "m", F.col("s.set_key").alias("b"), F.col("s.n_shingles").alias("n_b")))
        met = entries.join(smallest, ["k", "m"]).where(F.col("set_key") != F.col("b"))
        met = met.where(100 * F.least("n_shingles", "n_b") >= self.percent * F.greatest("n_shingles", "n_b"))
        pairs = self.within_reach(met.select(F.col("set_key").alias("a"), "b").distinct())
        shingles = self.shingles(pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct())
        linked = self.overlaps(pairs, shingles, True)
        leaders = linked.select(F.col("b").alias("set_key")).distinct().join(linked.select(F.col("a").alias("set_key")).distinct(), "set_key", "left_anti")
        choice = linked.join(leaders.select(F.col("set_key").alias("b")), "b", "left_semi").groupBy("a").agg(F.max(F.struct("common", "b"))["b"].alias("b"))
        members = linked.join(choice, ["a", "b"])
        apart = 1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
        members = self.save(members.select(F.col("a").alias("set_key"), F.col("b").alias("lead"), F.col("n_a").alias("n_shingles"), apart.alias("apart"), "added", "removed"))
        return members, linked.select("a", "b"), shingles

    def between_families(self, near: DataFrame, members: DataFrame, shingles: DataFrame) -> DataFrame:
        """The pairs (a, b) of leaders of `near` (a, b, n_a, n_b, common, apart_a, apart_b), not linked themselves, between
        whose families a link lies.

        A member's overlap with the other leader is the leaders' overlap, plus what it adds of the other set, less what it
        lacks of it; members that are too far from the other leader for any link to its family are left out. Overlaps
        between the rest follow from the same figures and from their differences, a block against a block.
        """
        percent, least = self.percent, self.percent / 100 - 1e-9
        empty = F.lit(b"")
        own = members.select("lead", "set_key", "n_shingles", "added", "removed")
        leaders = near.select(F.col("a").alias("lead"), F.col("n_a").alias("n_shingles")).unionAll(near.select("b", "n_b")).distinct()
        own = own.unionByName(leaders.select("lead", F.col("lead").alias("set_key"), "n_shingles", empty.alias("added"), empty.alias("removed")))
        sides = [near.select("a", "b", F.lit(k == 0).alias("is_left"), F.col("ab"[k]).alias("lead"), F.col("ba"[k]).alias("other"), F.col(("n_b", "n_a")[k]).alias("n_other"), "common", F.col(("apart_b", "apart_a")[k]).alias("apart")) for k in (0, 1)]
        rows = sides[0].unionAll(sides[1]).join(own, "lead").join(shingles.select(F.col("set_key").alias("other"), "shingles"), "other")

        def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                added, removed, other = (tokens_of(column(batch, c)) for c in ("added", "removed", "shingles"))
                hits = lambda x, y: len(np.intersect1d(x, y, assume_unique=True))
                gain = np.array([hits(p, o) - hits(m, o) for p, m, o in zip(added, removed, other, strict=True)], dtype=np.int64)
                common = column(batch, "common").to_numpy() + gain
                union = column(batch, "n_shingles").to_numpy() + column(batch, "n_other").to_numpy() - common
                keep = pa.array(np.flatnonzero(common >= (least - column(batch, "apart").to_numpy()) * union))
                kept = batch.select(["a", "b", "is_left", "n_shingles", "common", "added", "removed"]).append_column("gain", pa.array(gain))
                yield kept.take(keep)

        rows = self.save(rows.mapInArrow(derive, "a binary, b binary, is_left boolean, n_shingles long, common long, added binary, removed binary, gain long"))
        parts = lambda is_left: F.ceil(F.count_if(F.col("is_left") == is_left) / MEMBERS).cast("int")
        counts = self.save(rows.groupBy("a", "b").agg(parts(True).alias("n_left"), parts(False).alias("n_right")).where("n_left > 0 AND n_right > 0"))
        place = F.xxhash64("added", "removed", "n_shingles")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        met = rows.join(counts, ["a", "b"])
        met = met.withColumn("i", F.explode(F.when(F.col("is_left"), F.array(F.pmod(place, F.col("n_left")).cast("int"))).otherwise(every("n_left"))))
        met = met.withColumn("j", F.explode(F.when(F.col("is_left"), every("n_right")).otherwise(F.array(F.pmod(place, F.col("n_right")).cast("int")))))
        cells = met.withColumn("cell", F.xxhash64("a", "b", "i", "j")).drop("n_left", "n_right", "i", "j").repartition("cell").sortWithinPartitions("cell")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, "cell"):
                table = table.combine_chunks()
                cell = table.column("cell").to_numpy()
                n, common, gain = (table.column(c).to_numpy() for c in ("n_shingles", "common", "gain"))
                is_left = table.column("is_left").to_numpy(zero_copy_only=False)
                differences = [(p, m) for p, m in zip(tokens_of(table.column("added").combine_chunks()), tokens_of(table.column("removed").combine_chunks()), strict=True)]
                edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
                good = []
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    x, y = s + np.flatnonzero(is_left[s:e]), s + np.flatnonzero(~is_left[s:e])
                    if not len(x) or not len(y):
                        continue
                    both = common[s] + gain[x][:, None] + gain[y][None] + signed_product([differences[k] for k in x], [differences[k] for k in y])
                    if (100 * both >= percent * (n[x][:, None] + n[y][None] - both)).any():
                        good.append(s)
                yield table.select(["a", "b"]).take(pa.array(good, pa.int64())).to_batches(max_chunksize=1 << 20)[0] if good else pa.RecordBatch.from_pylist([], schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

        return self.save(cells.mapInArrow(compare, "a binary, b binary").distinct())

    def run(self) -> DataFrame:
        percent = self.percent
        with small_batches(self.docs.sparkSession):
            rows = self.ws.save(sketch(self.docs, self.width), "rows")
        found = rows.where("set_key IS NOT NULL").groupBy("set_key", "n_shingles", "mins", "parities", "wide")
        self.sets = self.save(found.agg(F.min("doc_id").alias("rep_doc"), self.one_text()))
        members, links, shingles = self.families()
        labels = self.merge(links, None)

        total = self.sets.agg(F.sum("n_shingles").alias("n"), F.count(F.lit(1)).alias("sets")).first()
        n_shards = max(8, -(-((total.n or 0) * (100 - percent) // 100 + total.sets) // SHARD))
        posted = self.save(postings(self.docs, self.width, percent, total_counters(rows), n_shards))
        led = posted.join(members.select("set_key", "lead"), "set_key", "left").withColumn("lead", F.coalesce("lead", "set_key"))
        blocks = led.groupBy("token", "lead").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.max("rest").alias("rest"), F.max("is_index").alias("is_index"))
        blocks = self.save(blocks)
        # Long lists first by pivots: the families that are in most of them, as a text that others were made from has no
        # rare shingles of its own. What they leave in different components is compared thereafter.
        long = blocks.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHORT).select("token")
        scores = self.save(blocks.join(long, "token", "left_semi").groupBy("lead").agg(F.count(F.lit(1)).alias("score")))
        widest = self.save(members.groupBy("lead").agg(F.max("apart").alias("apart")))
        own = self.sets.select(F.col("set_key").alias("lead"), F.col("n_shingles").alias("n"), "parities")
        scores = self.save(scores.join(own, "lead").join(widest, "lead", "left").fillna(0.0, ["apart"]))
        blocks = self.save(blocks.join(scores, "lead", "left").fillna(0, ["score"]))
        compared = None
        for by_pivots in (True, False):
            met = self.save(list_pairs(self.labelled(blocks, "lead", labels, "label"), percent, by_pivots))
            if compared is not None:
                met = met.join(compared.select("a", "b"), ["a", "b"], "left_anti")
            met = self.within_reach(self.save(met), widest)
            if met.isEmpty():
                continue
            lacking = met.select(F.explode(F.array("a", "b")).alias("set_key")).distinct().join(shingles.select("set_key"), "set_key", "left_anti")
            shingles = shingles.unionByName(self.shingles(lacking))
            found = self.overlaps(met, shingles, False).withColumn("is_link", 100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common")))
            labels = self.merge(found.where("is_link").select("a", "b"), labels)
            compared = found if compared is None else compared.unionByName(found)
        if compared is not None:
            near = compared.where("NOT is_link").drop("is_link")
            for side in "ab":
                near = near.join(widest.select(F.col("lead").alias(side), F.col("apart").alias(f"apart_{side}")), side, "left").fillna(0.0, [f"apart_{side}"])
            reach = F.lit(percent / 100 - 1e-9) - F.col("apart_a") - F.col("apart_b")
            near = near.where("apart_a + apart_b > 0").where(F.col("common") >= reach * (F.col("n_a") + F.col("n_b") - F.col("common")))
            near = self.save(self.labelled(self.labelled(near, "a", labels, "x"), "b", labels, "y").where("x != y").drop("x", "y"))
            if not near.isEmpty():
                labels = self.merge(self.between_families(near, members, shingles), labels)
        named = self.labelled(self.sets.select("set_key", "rep_doc"), "set_key", labels, "label")
        least = named.groupBy("label").agg(F.min("rep_doc").alias("component_id"))
        groups = self.ws.save(named.select("set_key", "label").join(least, "label").select("set_key", "component_id"), "groups")
        self.ws.keep("rows", "groups")
        docs = rows.where("slice IS NULL").select("doc_id", "n_shingles", F.col("set_key").alias("_set"))
        out = docs.join(groups, F.col("_set") == F.col("set_key"), "left")
        return out.select("doc_id", "n_shingles", F.when(F.col("_set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def signed_product(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each pair of differences (added, removed): the sum over common tokens of the products of their signs."""
    flat = [[np.concatenate([x for d in side for x in d]), np.concatenate([np.repeat([1.0, -1.0], [len(p), len(m)]) for p, m in side]), np.repeat(np.arange(len(side)), [len(p) + len(m) for p, m in side])] for side in (left, right)]
    tokens = np.intersect1d(flat[0][0], flat[1][0])
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, len(tokens), COLUMNS):
        some = tokens[first : first + COLUMNS]
        sides = []
        for (t, sign, row), side in zip(flat, (left, right), strict=True):
            at = np.minimum(np.searchsorted(some, t), len(some) - 1)
            here = some[at] == t
            matrix = np.zeros((len(side), len(some)), dtype=np.float32)
            matrix[row[here], at[here]] = sign[here]
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def jaccard_join(df: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id reachable over links).

    Words are runs of non-white bytes, A-Z as a-z. Rows whose sets of `width`-word shingles have a Jaccard similarity of
    `percent` / 100 or more are linked. The join is exact: every link between different sets is found, by full sets.

    Index lists: a set is entered under its rarest shingles only, rarity by counters over all documents, so what many
    documents share (templates, licenses) hardly makes lists. Entries of one family are one block, put together before
    the shuffle, so a group of near copies of any size is one entry a list; within a list, blocks are skipped in stretches
    by position and size. Long lists are compared with a few pivots first; after that only blocks of different components
    are, in cells of bounded size. A family's members are linked to their leader and thus one
    component: two families are compared through their leaders, and, if a link between others is possible, through
    members' differences, in blocks of bounded size that give out one row at most. All pairs of a group are never made.

    A row without words (or null text) has an empty set, is linked with nothing and is its own component. Fewer than
    `width` words form one shingle. Null ids take the component of rows with an equal or linked set, if one has an id,
    else null. Repeated rows share a component. Other columns are not read. An empty table gives an empty result.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return JaccardJoin(docs, width, percent).run()
