"""Near-duplicate groups by a chosen-path set similarity join over word shingles.

Documents become sets of shingles, equal sets become one, and each set gets a vector of minwise tokens. Independent
trees then branch on these: a node is a path of chosen coordinates and the tokens found there, so similar sets tend to
walk together. Small nodes are compared exhaustively, large ones branch again. Pairs that pass on the vectors are
confirmed on the full sets, and links become components.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm._frames import ROW, Workspace, small_batches, text_or_empty
from cipherlake.llm._text import column, shingle_sets, spans, utf8_buffers
from cipherlake.shipping import ship_package

#: Length of the vector of minwise tokens.
N_HASH = 64
#: Children of a node that branches; at 2 a pair of similarity s survives any depth with a chance near 1 - (1 - s) ** 2 / s ** 2.
BRANCH = 2
#: Members of a large node that stand for it, on average, when a set's average similarity is estimated.
REFERENCES = 12
#: How many comparisons of sets a set's way through one more node costs.
NODE_COST = 512.0
CHUNK_BYTES = 1 << 18
#: Pivots of a crowd, on average; tokens of a left and of a right block; columns of a matrix.
PIVOTS = 32
LEFT_TOKENS, RIGHT_TOKENS = 1 << 17, 1 << 18
#: Sets of a left and of a right block that are compared by minwise tokens; tokens of a bucket of stored shingles.
LEFT_SETS, RIGHT_SETS = 512, 2048
BUCKET = 1 << 21
COLUMNS = 1 << 14
#: Pairs of a stretch that are compared one by one; more of them by matrices.
FEW_PAIRS = 4096
#: Bits of a block of a bitmap.
MARKS = 1 << 15
#: Pairs of a cell that are compared at once; elements of the matrices over their tokens; tokens that a set counts as, at least.
AREA, MATRIX, LEAST_TOKENS = 1 << 20, 1 << 22, 64

_draw = np.random.default_rng(20240607)
_FACTORS = _draw.integers(1, 2**32, N_HASH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADDS = _draw.integers(0, 2**32, N_HASH, dtype=np.uint64).astype(np.uint32)


def minwise(tokens: np.ndarray) -> np.ndarray:
    """The smallest hash of the tokens under each of N_HASH functions, as int32."""
    best = np.full(N_HASH, 0xFFFFFFFF, dtype=np.uint32)
    low = (tokens ^ (tokens >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(low), 16384):
        h = low[at : at + 16384][None, :] * _FACTORS[:, None] + _ADDS[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        np.minimum(best, h.min(axis=1), out=best)
    return best.view(np.int32)


def trees_for(similarity: float, recall: float) -> int:
    """How many trees find a pair of exactly that similarity with the given chance, at any depth."""
    alive = 1.0
    for _ in range(200):
        alive = 1 - (1 - similarity * alive) ** BRANCH
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity * alive))


def least_agreement(similarity: float, miss: float) -> int:
    """The largest k with a chance of at most `miss` that a pair of that similarity agrees on fewer than k tokens."""
    total = 0.0
    for k in range(N_HASH + 1):
        total += math.comb(N_HASH, k) * similarity**k * (1 - similarity) ** (N_HASH - k)
        if total > miss:
            return k
    return N_HASH


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (16-byte digest of the set; null without words), text_key (MD5 of the text), sig (minwise
    tokens) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_buffers(column(batch, "text"))
            for i, j in spans(offsets, CHUNK_BYTES):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sigs = [minwise(s) if len(s) else None for s in sets]
                texts = [hashlib.md5(data[offsets[k] : offsets[k + 1]].tobytes()).hexdigest() for k in range(i, j)]
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id").slice(i, j - i), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(keys, type=pa.binary()), pa.array(texts), pa.array(sigs, type=pa.list_(pa.int32()))],
                    names=["doc_id", "n_shingles", "set_key", "text_key", "sig"],
                )

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, set_key binary, text_key string, sig array<int>")


def marks(texts: DataFrame, n: int) -> np.ndarray:
    """A bitmap with the bits that n digests (hexadecimal MD5) mark by their first 32 bits, of some 16 bits each and at most
    16 MB: blocks of it are put together on executors."""
    bits = 1 << min(max(16, (16 * n).bit_length()), 27)
    slots = texts.select(F.conv(F.substring(texts.columns[0], 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(bits - 1)).alias("slot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            slot, block = column(batch, "slot").to_numpy(), column(batch, "block").to_numpy()
            for k in np.unique(block).tolist():
                found.setdefault(k, np.zeros(MARKS, dtype=bool))[slot[block == k] % MARKS] = True
        packed = [np.packbits(v).tobytes() for v in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(packed, pa.binary())], names=["block", "packed"])

    dealt = slots.withColumn("block", F.expr(f"slot DIV {MARKS}")).repartition("block")
    out = np.zeros((bits // MARKS, MARKS // 8), dtype=np.uint8)
    for r in dealt.mapInArrow(run, "block long, packed binary").collect():
        out[r.block] = np.frombuffer(r.packed, dtype=np.uint8)
    return out.reshape(-1)


def with_marked_texts(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The rows (doc_id, text) whose text's digest has its bit set: no other row can be wanted, and texts are long to shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            data, offsets = utf8_buffers(column(batch, "text"))
            heads = b"".join(hashlib.md5(data[a:b]).digest()[:4] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            slot = np.frombuffer(heads, dtype=">u4").astype(np.int64) & (8 * len(bits) - 1)
            yield batch.take(pa.array(np.flatnonzero(bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)))

    return docs.mapInArrow(run, docs.schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups of a stream that is sorted by an integer key; the last group waits for its next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def leaf_pairs(leaves: DataFrame, least: int, similarity: float) -> DataFrame:
    """a, b, sure: pairs within each node that agree on `least` minwise tokens and whose sizes allow the similarity.

    `sure` marks a spanning forest of each node by descending agreement: if all of it is confirmed, the node's other
    pairs add nothing to components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            table = table.combine_chunks()
            node = table.column("node").to_numpy()
            keys = table.column("set_key").to_pylist()
            size = table.column("n_shingles").to_numpy().astype(np.float64)
            sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, N_HASH)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]])
            left, right, sure = [], [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                agree = (sig[s:e, None] == sig[None, s:e]).sum(axis=2)
                fit = np.minimum(size[s:e, None], size[None, s:e]) >= similarity * np.maximum(size[s:e, None], size[None, s:e]) - 1e-9
                i, j = np.nonzero(np.triu((agree >= least) & fit, 1))
                if not len(i):
                    continue
                root = list(range(e - s))

                def find(x: int, root: list[int] = root) -> int:
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for k in np.argsort(-agree[i, j], kind="stable").tolist():
                    x, y = find(int(i[k])), find(int(j[k]))
                    root[x] = y
                    a, b = keys[s + int(i[k])], keys[s + int(j[k])]
                    left.append(min(a, b))
                    right.append(max(a, b))
                    sure.append(x != y)
            yield pa.RecordBatch.from_arrays([pa.array(left, type=pa.binary()), pa.array(right, type=pa.binary()), pa.array(sure, type=pa.bool_())], names=["a", "b", "sure"])

    dealt = leaves.repartition("node").sortWithinPartitions("node", "set_key")
    return dealt.mapInArrow(run, "a binary, b binary, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sorted token arrays have that Jaccard similarity, as a matrix: 0/1 matrices over the left side's tokens,
    multiplied a stretch of columns at a time, which is the shorter the more rows there are."""
    n_left, n_right = (np.array([len(s) for s in side]) for side in (left, right))
    tokens, column_of = np.unique(np.concatenate(left), return_inverse=True)
    row_of = np.repeat(np.arange(len(left)), n_left)
    flat, other_row = np.concatenate(right), np.repeat(np.arange(len(right)), n_right)
    at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
    known = tokens[at] == flat
    at, other_row = at[known], other_row[known]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    stretch = max(1, min(COLUMNS, MATRIX // (len(left) + len(right))))
    for first in range(0, len(tokens), stretch):
        width = min(stretch, len(tokens) - first)
        a, b = np.zeros((len(left), width), dtype=np.float32), np.zeros((len(right), width), dtype=np.float32)
        here = (column_of >= first) & (column_of < first + width)
        a[row_of[here], column_of[here] - first] = 1
        here = (at >= first) & (at < first + width)
        b[other_row[here], at[here] - first] = 1
        common += a @ b.T
    # Sums of ones are exact in float32 up to 2 ** 24 tokens.
    common = common.astype(np.int64)
    return 100 * common >= percent * (n_left[:, None] + n_right[None] - common)


def similar(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Index pairs whose sorted token arrays have that Jaccard similarity."""
    return list(zip(*(x.tolist() for x in np.nonzero(linked(left, right, percent))), strict=True)) if left and right else []


def likely(left: np.ndarray, right: np.ndarray, least: int) -> np.ndarray:
    """Which rows of minwise tokens agree on at least so many, as a matrix; some rows at a time."""
    step = max(1, (1 << 22) // max(1, len(right) * N_HASH))
    parts = [(left[i : i + step, None] == right[None]).sum(axis=2) >= least for i in range(0, len(left), step)]
    return np.concatenate(parts) if parts else np.zeros((0, len(right)), dtype=bool)


def links_in_cell(left: list[np.ndarray], right: list[np.ndarray], percent: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`similar`, as arrays of indices, for those sets only that have a likely partner by minwise tokens; AREA pairs at a time."""
    if not left or not right:
        return
    mine, other = (np.stack([minwise(s) for s in side]) for side in (left, right))
    step = max(1, AREA // len(right))
    for first in range(0, len(left), step):
        hits = likely(mine[first : first + step], other, least)
        rows, columns = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
        if not len(rows):
            continue
        if hits.sum() <= FEW_PAIRS:
            i, j = np.nonzero(hits)
            common = np.array([len(np.intersect1d(left[first + x], right[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
            total = np.array([len(left[first + x]) + len(right[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
            good = 100 * common >= percent * (total - common)
            yield first + i[good], j[good]
        else:
            i, j = np.nonzero(linked([left[first + x] for x in rows.tolist()], [right[y] for y in columns.tolist()], percent))
            yield first + rows[i], columns[j]


def similar_in_cell(left: list[np.ndarray], right: list[np.ndarray], percent: int, least: int) -> list[tuple[int, int]]:
    """All links of `links_in_cell`."""
    return [pair for i, j in links_in_cell(left, right, percent, least) for pair in zip(i.tolist(), j.tolist(), strict=True)]


def forest(links: Iterator[tuple[np.ndarray, np.ndarray]], n_left: int, n_right: int) -> list[tuple[int, int]]:
    """Of links (left, right), sorted by left, as many as make the same components: fewer than there are sets."""
    label, kept = np.arange(n_left + n_right), []
    for i, j in links:
        cuts = [0, *(np.flatnonzero(np.diff(i)) + 1).tolist(), len(i)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s == e:
                continue
            own = label[i[s]]
            found, where = np.unique(label[n_left + j[s:e]], return_index=True)
            new = found != own
            if new.any():
                kept += [(int(i[s]), k) for k in j[s:e][where[new]].tolist()]
                label[np.isin(label, found[new])] = own
    return kept


class Join:
    """One run: sets, trees, candidates, confirmation and components, each step written to the shared folder."""

    def __init__(self, docs: DataFrame, width: int, percent: int, recall: float, leaf: int):
        ship_package(docs.sparkSession)
        self.ws = Workspace(docs.sparkSession, "near-dedup")
        self.docs, self.width, self.percent, self.leaf = docs, width, percent, leaf
        self.similarity = percent / 100
        self.trees = trees_for(self.similarity, recall)
        self.least = least_agreement(self.similarity, (1 - recall) / 10)
        self.step, self.table = 0, None

    def save(self, df: DataFrame) -> DataFrame:
        self.step += 1
        # Texts and sets are kilobytes a row, and pairs of sets twice that.
        with small_batches(df.sparkSession):
            return self.ws.save(df, f"t{self.step}")

    def paths(self) -> tuple[DataFrame | None, DataFrame | None]:
        """(leaves, dense): set_key and node of small nodes; and set_key, node, dense of the large nodes with dense sets.

        A set's nodes shrink at each level by its average similarity to the members, estimated from REFERENCES of them,
        while their number grows by BRANCH; so node size and likeness tell at how many nodes it would get to leaves. If
        that costs more than to compare it with the whole node, the set is dense: it is compared so, and goes no
        further. The others branch, level after level, whatever the depth.
        """
        coordinate = lambda node, k: F.element_at("sig", F.pmod(F.xxhash64(node, k), F.lit(N_HASH)).cast("int") + 1)
        roots = F.transform(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: F.xxhash64(t, F.element_at("sig", t + 1)))
        entries = self.save(self.sets.select("set_key", F.explode(roots).alias("node")))
        leaves: list[DataFrame] = []
        dense: list[DataFrame] = []
        while True:
            # Sizes are written first, so that the join below has two plain shuffles and a hot node can be split.
            sizes = self.save(entries.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
            if sizes.isEmpty():
                break
            sized = self.save(entries.join(sizes, "node"))
            leaves.append(sized.where(F.col("n") <= self.leaf).select("set_key", "node"))
            large = sized.where(F.col("n") > self.leaf)
            if large.isEmpty():
                break
            large = self.save(large.join(self.sets.select("set_key", "sig"), "set_key"))
            drawn = F.shiftrightunsigned(F.xxhash64(F.lit("reference"), "node", "set_key"), 12) / F.lit(float(2**52)) * F.col("n") < REFERENCES
            references = self.save(large.where(drawn).groupBy("node").agg(F.collect_list("sig").alias("refs")))
            alike = F.aggregate("refs", F.lit(0), lambda acc, r: acc + F.size(F.array_intersect("sig", r))) / (F.size("refs") * F.lit(float(N_HASH)))
            judged = self.save(large.join(references, "node", "left").select("set_key", "node", "sig", self.is_dense(alike, F.col("n")).alias("dense")))
            dense.append(judged.select("set_key", "node", "dense"))
            rest = judged.where("NOT dense")
            if rest.isEmpty():
                break
            children = F.transform(F.sequence(F.lit(1), F.lit(BRANCH)), lambda k: F.xxhash64("node", k, coordinate(F.col("node"), k)))
            entries = self.save(rest.select("set_key", F.explode(children).alias("node")))
        small, judged = (reduce(DataFrame.unionAll, parts) if parts else None for parts in (leaves, dense))
        if judged is None:
            return small, None
        crowded = self.save(judged.groupBy("node").agg(F.max("dense").alias("any")).where("any").select("node"))
        return small, None if crowded.isEmpty() else self.save(judged.join(crowded, "node", "left_semi"))

    def is_dense(self, alike: Column, n: Column) -> Column:
        """Whether a set with that average similarity to a node of n is compared with all of it; true if that is unknown."""
        depth = F.log(n / F.lit(float(self.leaf))) / -F.log(F.greatest(alike, F.lit(1 / N_HASH)))
        return F.coalesce((alike * BRANCH >= 1) | (F.pow(F.lit(float(BRANCH)), depth) * F.lit(NODE_COST) >= n), F.lit(True))

    def homes(self, dense: DataFrame) -> DataFrame:
        """set_key, crowd, n_shingles: each dense set in one of its nodes, for a first comparison with a few pivots."""
        home = dense.where("dense").groupBy("set_key").agg(F.min("node").alias("crowd"))
        return self.save(home.join(self.sets.select("set_key", "n_shingles"), "set_key"))

    def crowds(self, dense: DataFrame, labels: DataFrame | None) -> DataFrame:
        """set_key, crowd, n_shingles, label, dense, main: the members of the nodes with dense sets.

        Nodes stay apart, but for those whose largest component is the same one: these hold the same family of near
        copies, found by several trees, and their members meet once.
        """
        named = self.save(self.labelled(dense, "set_key", labels, "label"))
        counts = named.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        largest = counts.groupBy("node").agg(F.max(F.struct("n", "label")).alias("m"))
        crowd = F.when(F.col("m.n") > 1, F.xxhash64("m.label")).otherwise(F.col("node"))
        largest = self.save(largest.select("node", crowd.alias("crowd")))
        members = named.join(largest, "node").groupBy("set_key", "crowd", "label").agg(F.max("dense").alias("dense"))
        members = self.save(members.join(self.sets.select("set_key", "n_shingles"), "set_key"))
        counts = members.groupBy("crowd", "label").agg(F.count(F.lit(1)).alias("n"))
        main = self.save(counts.groupBy("crowd").agg(F.max(F.struct("n", "label"))["label"].alias("main")))
        return self.save(members.join(main, "crowd"))

    def crowd_links(self, crowds: DataFrame, shingles: DataFrame) -> list[DataFrame]:
        """Links of the sets outside their crowd's largest component: dense ones against all, others against the dense."""
        odd = crowds.where("label != main")
        found = []
        for mine, other in ((odd.where("dense"), crowds), (odd.where("NOT dense"), crowds.where("dense"))):
            if not mine.isEmpty():
                other = other.join(mine.select("crowd").distinct(), "crowd", "left_semi")
                columns = ("set_key", "crowd", "n_shingles", "label")
                hopeful = self.hopeful(mine.select(*columns), other.select(*columns))
                sides = (hopeful.where(which).select("set_key", "crowd", "n_shingles") for which in ("is_left", "NOT is_left"))
                found.append(self.block_links(*sides, shingles))
        return found

    def hopeful(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """set_key, crowd, n_shingles, is_left of those of the left and the right sets (set_key, crowd, n_shingles, label)
        that have a likely partner with another label on the other side of their crowd.

        Only minwise tokens meet in cells; full sets, which are many times larger, are left to `block_links`, which looks
        for partners by the same tokens.
        """
        percent, least = self.percent, self.least
        cells = self.in_cells(left, right, F.lit(1), LEFT_SETS, RIGHT_SETS)
        cells = cells.join(self.sets.select("set_key", "sig"), "set_key").repartition("cell").sortWithinPartitions("cell")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, "cell"):
                table = table.combine_chunks()
                cell, size = table.column("cell").to_numpy(), table.column("n_shingles").to_numpy()
                is_left = table.column("is_left").to_numpy(zero_copy_only=False)
                label = np.unique(np.array(table.column("label").to_pylist(), dtype=object), return_inverse=True)[1]
                sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, N_HASH)
                edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
                good = np.zeros(len(cell), dtype=bool)
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    x, y = s + np.flatnonzero(is_left[s:e]), s + np.flatnonzero(~is_left[s:e])
                    hits = likely(sig[x], sig[y], least) & (label[x][:, None] != label[y][None])
                    hits &= 100 * np.minimum(size[x][:, None], size[y][None]) >= percent * np.maximum(size[x][:, None], size[y][None])
                    good[x], good[y] = hits.any(axis=1), hits.any(axis=0)
                found = table.select(["set_key", "crowd", "n_shingles", "is_left"]).take(pa.array(np.flatnonzero(good)))
                yield from found.to_batches()

        found = cells.select("cell", "is_left", "set_key", "crowd", "n_shingles", "label", "sig")
        return self.save(found.mapInArrow(run, "set_key binary, crowd long, n_shingles long, is_left boolean").distinct())

    def in_cells(self, left: DataFrame, right: DataFrame, size: Column, left_size: int, right_size: int) -> DataFrame:
        """The rows of both sides with is_left and a cell: sides are cut into blocks of about that total size by hash, and
        each left block of a crowd meets each right block in a cell of its own."""
        sizes = [df.select("crowd", *[(size if k == j else F.lit(0)).cast("long") for j in (0, 1)]).toDF("crowd", "l", "r") for k, df in enumerate((left, right))]
        count = lambda name, most: F.ceil(F.sum(name) / most).cast("int")
        counts = sizes[0].unionAll(sizes[1]).groupBy("crowd").agg(count("l", left_size).alias("n_left"), count("r", right_size).alias("n_right"))
        counts = self.save(counts.where("n_left > 0 AND n_right > 0"))
        own = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "set_key"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        sides = []
        for is_left, df in ((True, left), (False, right)):
            met = df.join(counts, "crowd")
            met = met.withColumn("i", own("n_left", 1) if is_left else every("n_left")).withColumn("j", every("n_right") if is_left else own("n_right", 2))
            sides.append(met.select(F.xxhash64("crowd", "i", "j").alias("cell"), F.lit(is_left).alias("is_left"), *df.columns))
        return sides[0].unionByName(sides[1])

    def block_links(self, left: DataFrame, right: DataFrame, shingles: DataFrame) -> DataFrame:
        """Links (a, b) between the left and the right sets (set_key, crowd, n_shingles) of each crowd, on full sets.

        Both sides are cut into blocks of bounded size by hash, each left block meets each right block in a cell of
        its own, and a cell gives out nothing but links, as few as make its components.
        """
        percent, least = self.percent, self.least
        cells = self.in_cells(left, right, F.greatest("n_shingles", F.lit(LEAST_TOKENS)), LEFT_TOKENS, RIGHT_TOKENS).select("cell", "is_left", "set_key")
        cells = cells.join(shingles, "set_key").repartition("cell").sortWithinPartitions("cell")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, "cell"):
                table = table.combine_chunks()
                cell = table.column("cell").to_numpy()
                is_left = table.column("is_left").to_numpy(zero_copy_only=False)
                keys = table.column("set_key").to_pylist()
                data, offsets = utf8_buffers(table.column("shingles").combine_chunks())
                sets = [np.frombuffer(data[a:b].tobytes(), np.uint64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
                found = set()
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    x, y = [k for k in range(s, e) if is_left[k]], [k for k in range(s, e) if not is_left[k]]
                    for p, q in forest(links_in_cell([sets[k] for k in x], [sets[k] for k in y], percent, least), len(x), len(y)):
                        a, b = keys[x[p]], keys[y[q]]
                        if a != b:
                            found.add((min(a, b), max(a, b)))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], type=pa.binary()) for k in (0, 1)], names=["a", "b"])

        return self.save(cells.select("cell", "is_left", "set_key", "shingles").mapInArrow(run, "a binary, b binary"))

    def one_text(self) -> Column:
        """Of a set's rows, one by the digest of its text and its id."""
        return F.min(F.struct("text_key", "doc_id")).alias("rep")

    def shingles(self, keys: DataFrame, bucketed: bool = False) -> DataFrame:
        """set_key and shingles (8-byte hashes, packed) of the given sets, recomputed from whole texts. `bucketed`: dealt by
        set_key once, as a table that joins on it do not shuffle again; its buckets grow in number with the sets.

        A text is found by its digest and the id of one of its rows: ids may be null or repeated, and a text may have very
        many rows.
        """
        wanted = keys.join(self.sets.select("set_key", "rep", "n_shingles"), "set_key")
        wanted = self.save(wanted.select(F.col("set_key").alias("wanted"), F.col("rep.text_key").alias("rep_text"), F.col("rep.doc_id").alias("rep_id"), "n_shingles"))
        total = wanted.agg(F.count(F.lit(1)).alias("sets"), F.sum("n_shingles").alias("n")).first()
        if not total.sets and not bucketed:
            return self.ws.spark.createDataFrame([], "set_key binary, shingles binary")
        docs = with_marked_texts(self.docs, marks(wanted.select("rep_text"), total.sets))
        found = docs.join(wanted.hint("shuffle_hash"), (F.md5("text") == F.col("rep_text")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("wanted", "text")
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for batch in batches:
                data, offsets = utf8_buffers(column(batch, "text"))
                wanted = column(batch, "wanted").to_pylist()
                for i, j in spans(offsets, CHUNK_BYTES):
                    sets = [s.tobytes() for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)]
                    # Equal texts may be met in several rows: the set counts once.
                    keep = []
                    for k, s in zip(wanted[i:j], sets, strict=True):
                        if k not in seen and hashlib.blake2b(s, digest_size=16).digest() == k:
                            seen.add(k)
                            keep.append((k, s))
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keep], type=pa.binary()), pa.array([s for _, s in keep], type=pa.binary())], names=["set_key", "shingles"])

        found = found.mapInArrow(run, "set_key binary, shingles binary")
        if not bucketed:
            return self.save(found)
        buckets = max(8, (total.n or 0) // BUCKET)
        self.step += 1
        self.table = f"shingles_{uuid.uuid4().hex}"
        out = found.repartition(buckets, "set_key").write.bucketBy(buckets, "set_key").sortBy("set_key").option("compression", "zstd")
        with small_batches(self.ws.spark):
            out.option("path", self.ws.path(f"t{self.step}")).saveAsTable(self.table)
        return self.ws.spark.table(self.table)

    def confirm(self, pairs: DataFrame, shingles: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach the similarity."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                xs, ys = column(batch, "xs"), column(batch, "ys")
                good = []
                for k in range(batch.num_rows):
                    x, y = np.frombuffer(xs[k].as_buffer(), np.uint64), np.frombuffer(ys[k].as_buffer(), np.uint64)
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * common >= percent * (len(both) - common):
                        good.append(k)
                yield batch.select(["a", "b"]).take(pa.array(good, type=pa.int64()))

        one = shingles.select(F.col("set_key").alias("a"), F.col("shingles").alias("xs"))
        two = shingles.select(F.col("set_key").alias("b"), F.col("shingles").alias("ys"))
        return self.save(pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(run, "a binary, b binary"))

    def labelled(self, df: DataFrame, name: str, labels: DataFrame | None, out: str) -> DataFrame:
        """Adds the label of a key: what components have made of it, or itself."""
        if labels is None:
            return df.withColumn(out, F.col(name))
        known = labels.select(F.col("key").alias("_key"), F.col("label").alias("_label"))
        return df.join(known, F.col(name) == F.col("_key"), "left").withColumn(out, F.coalesce("_label", name)).drop("_key", "_label")

    def merge(self, links: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        """Labels (key, label) after further links: each round hooks every key to the neighbour that a fresh random
        order puts first, and contracts; sizes shrink by a constant factor a round, whatever the shape."""
        edges = self.labelled(self.labelled(links, "a", labels, "x"), "b", labels, "y")
        edges = self.save(edges.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        turn = 0
        while not edges.isEmpty():
            place = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("k"))
            both = edges.select("x", "y").unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
            first = both.groupBy("x").agg(F.min(place("y")).alias("m"))
            parent = self.save(first.select(F.col("x").alias("key"), F.when(F.col("m") < place("x"), F.col("m")["k"]).otherwise(F.col("x")).alias("label")))
            moved = self.labelled(self.labelled(edges, "x", parent, "p"), "y", parent, "q").where("p != q")
            edges = self.save(moved.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct())
            if labels is None:
                labels = parent
            else:
                older = self.labelled(labels, "label", parent, "new").select("key", F.col("new").alias("label"))
                labels = older.unionAll(parent.join(labels.select("key"), "key", "left_anti"))
            labels = self.save(labels)
            turn += 1
        return labels

    def run(self) -> DataFrame:
        with small_batches(self.docs.sparkSession):
            rows = self.ws.save(sketch(self.docs, self.width), "rows")
        self.sets = self.save(rows.where("set_key IS NOT NULL").groupBy("set_key", "n_shingles", "sig").agg(F.min("doc_id").alias("rep_doc"), self.one_text()))
        leaves, dense = self.paths()
        labels = None
        if leaves is not None:
            pairs = self.save(leaf_pairs(leaves.join(self.sets.select("set_key", "n_shingles", "sig"), "set_key"), self.least, self.similarity))
            needed = pairs.select(F.explode(F.array("a", "b")).alias("set_key"))
            if dense is not None:
                needed = needed.unionAll(dense.select("set_key"))
            shingles = self.shingles(needed.distinct(), bucketed=True)
            if dense is not None:
                members = self.homes(dense)
                size = self.save(members.groupBy("crowd").agg(F.count(F.lit(1)).alias("n")))
                u = F.shiftrightunsigned(F.xxhash64(F.lit("pivot"), "set_key"), 12) / F.lit(float(2**52))
                pivots = members.join(size, "crowd").where(u * F.col("n") < PIVOTS).select("set_key", "crowd", "n_shingles")
                labels = self.merge(self.block_links(pivots, members, shingles), labels)
            for which in ("sure", "NOT sure"):
                apart = self.labelled(self.labelled(pairs.where(which), "a", labels, "x"), "b", labels, "y").where("x != y")
                labels = self.merge(self.confirm(apart, shingles), labels)
            if dense is not None:
                for links in self.crowd_links(self.crowds(dense, labels), shingles):
                    labels = self.merge(links, labels)
        named = self.labelled(self.sets.select("set_key", "rep_doc"), "set_key", labels, "label")
        least = named.groupBy("label").agg(F.min("rep_doc").alias("component_id"))
        groups = self.ws.save(named.select("set_key", "label").join(least, "label").select("set_key", "component_id"), "groups")
        if self.table:
            self.ws.spark.sql(f"DROP TABLE {self.table}")
        self.ws.keep("rows", "groups")
        out = rows.select("doc_id", "n_shingles", F.col("set_key").alias("_set")).join(groups, F.col("_set") == F.col("set_key"), "left")
        component = F.when(F.col("_set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(
    df: DataFrame, width: int = 5, percent: int = 80, recall: float = 1 - 1e-6, leaf: int = 64, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id reachable over links), kept.

    Words are runs of non-white bytes, A-Z as a-z. Rows whose sets of `width`-word shingles have a Jaccard similarity
    of `percent` / 100 or more are linked; each link is confirmed on full sets. `recall` is the chance with which the
    trees find a link of exactly that similarity (closer pairs more surely); it sets the number of trees and how few
    equal minwise tokens still make a candidate.

    Hot groups: equal sets are one from the start. Nodes of at most `leaf` sets are compared exhaustively. In larger
    ones, sets with a low enough average similarity to the node branch on, to any depth; the others, which branching
    would hardly part, are compared with the whole node there: first each with about 32 pivots of one of its nodes,
    then whatever its node's largest component has not taken in with every member that is likely, by minwise tokens, to
    link it with another component. That is always a block against a block, on full sets, in a task of bounded size that gives out links only. No group is gathered in one task, no list
    of all pairs is made within a group, nodes merge only where they hold the same component, and nothing is capped.

    A row without words (or null text) has an empty set, is linked with nothing and is its own component. Fewer than
    `width` words form one shingle. Null ids take the component of rows with an equal or linked set, if one has an id,
    else null; kept is true where id and component are the same, or both null. Repeated rows share a component; all
    rows with the kept id are kept. Other columns are not read. An empty table gives an empty result. Intermediate
    tables are dropped, but for two with a row per document or set.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return Join(docs, width, percent, recall, leaf).run()


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each group that `near_duplicates` finds, with all its columns: that of the smallest id; a null id comes
    after every other, and of rows with the same id any one stays. Rows without words all stay.

    The rows are written with keys first, as ids may be null or repeated; groups are of keys.
    """
    ws = Workspace(docs.sparkSession, "near-dedup")
    docs = ws.keyed(docs, "rows")
    groups = near_duplicates(docs, width, percent, text_col=text_col, id_col=ROW).select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group"))
    ids = docs.select(ROW, F.col(f"`{id_col}`").alias("_id")).join(groups, F.col(ROW) == F.col("_key"))
    first = F.min(F.struct(F.col("_id").isNull(), "_id", ROW))[ROW]
    kept = ws.save(ids.groupBy("_group").agg(first.alias("_kept")).select("_kept"), "kept")
    return docs.join(kept, F.col(ROW) == F.col("_kept"), "left_semi").drop(ROW)


def brute_force(rows: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, tuple[int, int]]:
    """id -> (set size, component), comparing all pairs; for tests."""
    import re

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}
