"""A prefix trie over conversations: succinct level-order tries (LOUDS) of prefix shards, with the heavy upper levels
merged apart."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm._frames import Workspace, text_or_empty
from cipherlake.llm._running import running
from cipherlake.llm._text import column
from cipherlake.shipping import ship_package

#: Conversations whose number differs by less than this share the beginnings of the first of them.
FAMILY = 20
#: At most so many turns, less one, come from there.
HEADS = 4
#: Bytes of a block of ids, on the way to a node's digest.
BLOCK = 1 << 16
_EMPTY = hashlib.sha256(b"").hexdigest()


class Louds:
    """A trie in level order: `bits` holds, node by node, a 1 for each child and a closing 0; `labels` a code for each
    node but the root; `levels` where each level begins.

    Node i > 0 is the (i - 1)-th 1, so the zeros before it count its parent.
    """

    def __init__(self, parents: np.ndarray, labels: np.ndarray, levels: list[int]):
        self.size, self.labels, self.levels = len(parents) + 1, labels, levels
        degree = np.bincount(parents, minlength=self.size)
        bits = np.ones(2 * self.size - 1, dtype=bool)
        bits[np.cumsum(degree) + np.arange(self.size)] = False
        self.bits = np.packbits(bits)

    def unpacked(self) -> np.ndarray:
        return np.unpackbits(self.bits, count=2 * self.size - 1).astype(bool)

    def parents(self) -> np.ndarray:
        """The parent of each node; the root's is -1."""
        ones = np.flatnonzero(self.unpacked())
        return np.concatenate([[-1], ones - np.arange(len(ones))])

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(~self.unpacked())
        return np.diff(np.concatenate([[-1], zeros])) - 1

    def slices(self) -> list[tuple[int, int]]:
        """The nodes [a, b) of each level below the root, deepest first: reverse level order."""
        edges = [*self.levels, self.size]
        return list(zip(edges[:-1], edges[1:], strict=True))[:0:-1]


def build(shard: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> tuple[Louds, np.ndarray]:
    """The trie of a forest, below one common root, and each row's node.

    Rows are turns, sequence after sequence (`starts`); `shard` numbers the prefix of a row's sequence, `codes` its label.
    The first turns of a shard's sequences are the same node.
    """
    n = len(codes)
    lengths = np.diff(np.append(starts, n))
    level = np.arange(n) - np.repeat(starts, lengths)
    by_level = np.argsort(level, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(level))]) if n else np.zeros(1, dtype=np.int64)
    width = int(max(codes.max(initial=0), shard.max(initial=0))) + 1
    node, parents, labels, levels, size = np.zeros(n, dtype=np.int64), [], [], [0], 1
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rows = by_level[a:b]
        key = node[rows - 1] * width + codes[rows] if a else shard[rows]
        found, place = np.unique(key, return_inverse=True)
        node[rows] = size + place
        parents.append(found // width if a else np.zeros(len(found), dtype=np.int64))
        labels.append(found % width)
        levels.append(size)
        size += len(found)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return Louds(join(parents), join(labels), levels), node


def rollups(trie: Louds, ends: np.ndarray, weights: np.ndarray, ids: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """For each node: members, smallest member, children, leaves and saved tokens of its subtree.

    `ends` are the nodes where sequences end, each of so many conversations (`weights`), the smallest of which is in
    `ids`; `words` counts each node's words.
    """
    parent = trie.parents()
    members, first = np.zeros(trie.size, dtype=np.int64), np.full(trie.size, np.iinfo(np.int64).max)
    np.add.at(members, ends, weights)
    np.minimum.at(first, ends, ids)
    degree = trie.degrees()
    leaves, saved = (degree == 0).astype(np.int64), np.zeros(trie.size, dtype=np.int64)
    for a, b in trie.slices():
        saved[a:b] += (members[a:b] - 1) * words[a:b]
        for rolled in (members, leaves, saved):
            np.add.at(rolled, parent[a:b], rolled[a:b])
        np.minimum.at(first, parent[a:b], first[a:b])
    return {"conv_id": first, "n_convs": members, "n_children": degree, "n_leaves": leaves, "saved_tokens": saved}


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, node1 long, node2 long, p1 long, p2 long, is_top boolean"


def shard_tries(paths: DataFrame, chunk_rows: int) -> DataFrame:
    """The nodes of the light subtrees (_NODE; parent_conv_id is null for their tops) of rows (f1, f2, conv_id, pos,
    digest, n_words, weight, length, node1, node2, p1, p2): turns with the subtree's top f1, f2 that they lie below."""
    names = ["f1", "f2", "conv_id", "pos", "n_words", "weight", "length", "node1", "node2", "p1", "p2"]

    def nodes(table: pa.Table) -> pa.RecordBatch:
        at = {c: table.column(c).to_numpy() for c in names}
        digests = np.frombuffer(b"".join(table.column("digest").to_pylist()), dtype="V16")
        codes = np.unique(digests, return_inverse=True)[1].reshape(-1)
        changed = lambda *columns: np.concatenate([[False], np.any([at[c][1:] != at[c][:-1] for c in columns], axis=0)])
        shard = np.cumsum(changed("f1", "f2"))
        starts = np.flatnonzero(np.concatenate([[True], changed("f1", "f2", "conv_id")[1:]]))
        trie, node = build(shard, codes, starts)
        row = np.zeros(trie.size, dtype=np.int64)
        row[node] = np.arange(len(node))
        ends = at["pos"] == at["length"]
        words = at["n_words"][row]
        out = rollups(trie, node[ends], at["weight"][ends], at["conv_id"][ends], words)
        parent, is_top = trie.parents(), np.zeros(trie.size, dtype=bool)
        is_top[parent == 0] = True
        out |= {c: at[c][row] for c in ("node1", "node2", "p1", "p2")}
        out |= {"depth": at["pos"][row], "is_top": is_top}
        arrays = {c: pa.array(v[1:]) for c, v in out.items()}
        arrays["parent_conv_id"] = pa.array(out["conv_id"][parent[1:]], mask=is_top[1:])
        order = [f.split()[0] for f in _NODE.split(", ")]
        return pa.RecordBatch.from_arrays([arrays[c] for c in order], names=order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Subtrees come whole, one after another; a trie takes as many as make up `chunk_rows` rows.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < chunk_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            f1, f2 = table.column("f1").to_numpy(), table.column("f2").to_numpy()
            whole = np.flatnonzero((f1 != f1[-1]) | (f2 != f2[-1]))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield nodes(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield nodes(pa.Table.from_batches(held).combine_chunks())

    dealt = paths.select(*names, "digest").repartition("f1", "f2").sortWithinPartitions("f1", "f2", "conv_id", "pos")
    return dealt.mapInArrow(run, _NODE)


def end_digests(ends: DataFrame) -> DataFrame:
    """node1, node2, ends_sha256 of (conv_id, node1, node2): the digest of a node's ids, ascending and comma-joined.

    Ids are sorted over ranges and packed into blocks, so a node with very many is read as few rows, as a stream.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two, ids = (column(batch, c).to_numpy() for c in ("node1", "node2", "conv_id"))
            cuts = np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
            starts = np.unique(np.concatenate([[0], cuts, np.arange(0, len(ids), BLOCK // 8)]))
            names = ids.astype(str).tolist()
            blocks = [",".join(names[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(one[starts]), pa.array(two[starts]), pa.array(ids[starts]), pa.array(blocks)], names=["node1", "node2", "first", "block"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["node1", "node2", "ends_sha256"])

        node, state, done = None, None, []
        for batch in batches:
            for one, two, block in zip(*(column(batch, c).to_pylist() for c in ("node1", "node2", "block")), strict=True):
                if node == (one, two):
                    state.update(b"," + block.encode())
                    continue
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (one, two), hashlib.sha256(block.encode())
            yield out()
            done = []
        if node:
            done.append((*node, state.hexdigest()))
        yield out()

    blocks = ends.repartitionByRange("node1", "node2", "conv_id").sortWithinPartitions("node1", "node2", "conv_id").mapInArrow(pack, "node1 long, node2 long, first long, block string")
    return blocks.repartition("node1", "node2").sortWithinPartitions("node1", "node2", "first").mapInArrow(digest, "node1 long, node2 long, ends_sha256 string")


def slim_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, n_words; texts go no further."""
    role, text = text_or_empty("role"), text_or_empty("text")
    return df.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
    )


def rebuild(df: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): the rebuilt conversations' turns (conv_id, pos from 1, digest, n_words, x1, x2), and conv_id
    of all, turnless ones included.

    A conversation c takes the first h turns of c - c % FAMILY, then its own after its first h; h = crc32 of c, modulo
    HEADS. x1 and x2 are hashes of a turn at its place.
    """
    ranked = running(slim_turns(df).withColumn("rank", F.lit(1).cast("long")), ws, "ranked", "conv_id", ["turn", "digest"], {"rank": "add"})
    convs = ranked.groupBy("conv_id").agg(F.max("rank").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = ws.save(convs.select("conv_id", "n", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h")), "counted")
    heads = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = ws.save(convs.join(heads, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("m")), "convs")
    own = ranked.join(convs.select("conv_id", "h", "m"), "conv_id").where("rank > h").select("conv_id", (F.col("rank") - F.col("h") + F.col("m")).alias("pos"), "digest", "n_words")
    first = ranked.where((F.col("conv_id") % FAMILY == 0) & (F.col("rank") < HEADS)).select(F.col("conv_id").alias("base"), F.col("rank").alias("pos"), "digest", "n_words")
    taken = first.join(convs.where("m > 0").select("conv_id", "base", "m"), "base").where("pos <= m").select("conv_id", "pos", "digest", "n_words")
    lanes = {f"x{k}": F.xxhash64(F.lit(k), "pos", "digest") for k in (1, 2)}
    return own.unionByName(taken).withColumns(lanes), convs.select("conv_id")


def conversation_trie(df: DataFrame, shard_rows: int = 1 << 16) -> DataFrame:
    """One row per node of the prefix trie of rebuilt conversations (`rebuild`): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (role and text, compared by a 128-bit digest); the root has none. Its
    prefix's name is the XOR of hashes of its turns at their places (128 bit), so names come from running sums over a
    global sort, and a conversation of any length may span tasks. Equal conversations become one, with a count, before
    anything is grouped. Subtrees of at most `shard_rows` turns are shards: numpy builds their LOUDS tries and rolls
    figures up in reverse level order. The nodes above, and the root, are merged apart, from the shards' tops: every top
    adds its figures along the path of its smallest member, so that work is linear in the turns above shards, however
    long a heavy chain is. The ids that end at a node are digested as a stream of sorted blocks.

    Turns are ordered by turn, null first, then by digest; null roles and texts count as empty. Rows without conv_id
    belong to no conversation and are left out. Conversations that are left without turns are members of the root.
    Repeated rows are turns of their own. conv_id % 20 has the sign of conv_id. Other columns are not read. An empty table
    gives an empty result. Intermediate tables are dropped, but for three with a row per node or end.
    """
    spark = df.sparkSession
    ship_package(spark)
    ws = Workspace(spark, "trie")
    turns, convs = rebuild(df, ws)
    chained = running(turns.withColumns({"node1": F.col("x1"), "node2": F.col("x2")}), ws, "chained", "conv_id", ["pos"], {"node1": "xor", "node2": "xor"})
    last = chained.groupBy("conv_id").agg(F.max(F.struct("pos", "node1", "node2")).alias("e"))
    zero = F.lit(0).cast("long")
    ends = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"e.{a}", zero).alias(b) for a, b in (("pos", "length"), ("node1", "node1"), ("node2", "node2"))])
    ends = ws.save(ends, "ends")
    seqs = ws.save(ends.groupBy("node1", "node2", "length").agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id")), "seqs")
    parent = {f"p{k}": F.col(f"node{k}").bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)}
    paths = ws.save(chained.join(seqs.select("conv_id", "weight", "length"), "conv_id").withColumns(parent).drop("x1", "x2"), "paths")
    ws.drop("ranked", "counted", "convs", "chained")

    # Heavy nodes: more turns at and below them than a shard takes.
    sizes = paths.groupBy("node1", "node2").agg(F.sum(F.col("length") - F.col("pos") + 1).alias("rows"))
    heavy = ws.save(sizes.where(F.col("rows") > shard_rows).select("node1", "node2", F.lit(True).alias("is_heavy")), "heavy")
    paths = ws.save(paths.join(heavy, ["node1", "node2"], "left"), "flagged")
    light = paths.where("is_heavy IS NULL").drop("is_heavy")
    top = light.groupBy("conv_id").agg(F.min(F.struct("pos", "node1", "node2")).alias("t")).select("conv_id", F.col("t.node1").alias("f1"), F.col("t.node2").alias("f2"))
    nodes = ws.save(shard_tries(light.join(top, "conv_id"), shard_rows), "nodes")

    # Figures that enter the upper levels, each along the path of one conversation.
    tops = nodes.where("is_top")
    entering = tops.select("conv_id", (F.col("depth") - 1).alias("at"), "n_convs", "n_leaves", "saved_tokens")
    ending = seqs.where("length = 0").unionByName(seqs.join(heavy.select("node1", "node2"), ["node1", "node2"], "left_semi"))
    entering = entering.unionByName(ending.select("conv_id", F.col("length").alias("at"), F.col("weight").alias("n_convs"), zero.alias("n_leaves"), zero.alias("saved_tokens")))
    entering = ws.save(entering, "entering")
    up = paths.where("is_heavy").select("conv_id", "pos", "node1", "node2", "p1", "p2", "n_words")
    root = entering.select("conv_id", *[zero.alias(c) for c in ("pos", "node1", "node2", "p1", "p2", "n_words")])
    along = ws.save(up.unionByName(root).join(entering, "conv_id"), "along")
    upper = along.groupBy("node1", "node2").agg(
        F.min("conv_id").alias("conv_id"), F.max("pos").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"),
        F.max("n_words").alias("n_words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    upper = ws.save(upper, "upper")
    children = tops.select("p1", "p2").unionByName(upper.where("depth > 0").select("p1", "p2")).groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children"))
    children = children.toDF("node1", "node2", "n_children")
    # A node's own saving stands at the place of its smallest member; sums from the end of a path upwards.
    own = upper.select("conv_id", F.col("depth").alias("pos"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("own"))
    value = F.coalesce("own", zero) + F.when(F.col("pos") == F.col("at"), F.col("saved_tokens")).otherwise(zero)
    valued = along.join(own, ["conv_id", "pos"], "left").select("conv_id", (-F.col("pos")).alias("up"), "node1", "node2", value.alias("value"))
    saved = running(valued, ws, "valued", "conv_id", ["up"], {"value": "add"}).groupBy("node1", "node2").agg(F.sum("value").alias("saved_tokens"))
    upper = upper.join(children, ["node1", "node2"], "left").join(saved, ["node1", "node2"])
    n_children = F.coalesce("n_children", zero)
    upper = upper.withColumns({"n_children": n_children, "n_leaves": F.greatest("n_leaves", (n_children == 0).cast("long"))})
    upper = ws.save(upper, "merged")

    # Parents of the upper levels and of tops; the root's id is one value.
    first = upper.where("depth = 0").select("conv_id").first()
    of_root = F.lit(first.conv_id if first else None).cast("long")
    known = upper.where("depth > 0").select(F.col("node1").alias("p1"), F.col("node2").alias("p2"), F.col("conv_id").alias("_parent"))
    figures = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "node1", "node2"]
    below = upper.where("depth > 0").select(*figures, "p1", "p2").unionByName(tops.select(*figures, "p1", "p2"))
    deeper = below.where("depth > 1").join(known, ["p1", "p2"], "left").withColumn("parent_conv_id", F.col("_parent")).select(*figures, "parent_conv_id")
    parts = [
        upper.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")),
        below.where("depth = 1").withColumn("parent_conv_id", of_root),
        deeper,
        nodes.where("NOT is_top"),
    ]
    out = parts[0].select(*figures, "parent_conv_id")
    for part in parts[1:]:
        out = out.unionByName(part.select(*figures, "parent_conv_id"))
    digests = ws.save(end_digests(ends.select("conv_id", "node1", "node2")), "digests")
    ws.keep("nodes", "merged", "digests")
    return out.join(digests, ["node1", "node2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")
    )


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The result's rows, sorted, from (conv_id, turn, role, text), by plain dictionaries; for tests."""
    import re
    from collections import defaultdict

    def digest(role: str, text: str) -> bytes:
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()

    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            found[conv].append((turn is not None, turn or 0, digest(role, text), role, text))
    plain = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in found.items()}
    rebuilt = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % HEADS
        base = c - (abs(c) % FAMILY if c >= 0 else -(abs(c) % FAMILY))
        rebuilt[c] = tuple(plain.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(rebuilt.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
    out = []
    for node, ids in members.items():
        above = members[node[:-1]][0] if node else None
        sha = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.append((ids[0], len(node), above, len(ids), len(children[node]), leaves[node], saved[node], sha))
    return sorted(out, key=str)
