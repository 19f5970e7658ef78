"""Grouping of spelling variants: words that differ by one code point, found through Aho-Corasick automata of word halves.

One edit leaves one half of a word as it is. Automaton shards hold the halves (segments) of words; the words that may hold
them are scanned, hits are checked for offset and length, and the rest of the word for the one edit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm._frames import Workspace, text_or_empty
from cipherlake.llm._text import column
from cipherlake.shipping import ship_package

#: Different words that a task counts before it hands them on.
FLUSH = 1 << 18
#: Cells of a comparison of two blocks of words.
CELLS = 1 << 22
#: Rows of buckets that share one automaton.
AUTOMATON_ROWS = 1 << 15


def damaged(run: str, base: int, one_in: int) -> str:
    """The run, or, for one run in `one_in` by its checksum, the run without one code point."""
    h = zlib.crc32(run.encode(), base)
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(df: DataFrame, min_length: int = 7, min_count: int = 2, one_in: int = 31, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """word, n of the words of at least that many code points and occurrences, over whole texts.

    A word is a maximal run of `[A-Za-z\\u00C0-\\u00FF]`, A-Z lower-cased, after the planted damage (`damaged`, by the
    checksum of `<id>:<run>`; a null id counts as empty). Runs shorter than `min_length` never give a word.
    """
    runs = re.compile(rf"[a-zÀ-ÿ]{{{min_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for name, text in zip(column(batch, "id").to_pylist(), pc.ascii_lower(column(batch, "text")), strict=True):
                base = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(runs.findall(text.as_py())).items():
                    word = damaged(word, base, one_in)
                    if len(word) >= min_length:
                        counts[word] += n
                if len(counts) > FLUSH:
                    yield out(counts)
                    counts.clear()
        yield out(counts)

    ship_package(df.sparkSession)
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def one_replaced(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows x[i], y[j] of equal length: whether they differ in exactly one place."""
    differ = np.zeros((len(x), len(y)), dtype=np.uint8)
    for k in range(x.shape[1]):
        np.minimum(differ + (x[:, k, None] != y[None, :, k]), 2, out=differ)
    return differ == 1


def one_inserted(x: np.ndarray, y: np.ndarray, at_end: bool) -> np.ndarray:
    """For rows x[i] and rows y[j] that are longer by one: whether y[j] without one code point is x[i], that place being
    the end of their common beginning; where it is the end of x[i], only if `at_end`."""
    m = x.shape[1]
    head, tail = (np.zeros((len(x), len(y)), dtype=np.int32) for _ in range(2))
    alive = np.ones((len(x), len(y)), dtype=bool)
    for k in range(m):
        alive &= x[:, k, None] == y[None, :, k]
        head += alive
    alive[:] = True
    for k in range(m - 1, -1, -1):
        alive &= x[:, k, None] == y[None, :, k + 1]
        tail += alive
    return (head + tail >= m) & ((head < m) | at_end)


def codes(words: list[str], a: int, b: int) -> np.ndarray:
    """The code points between the first a and the last b of words of one length."""
    width = len(words[0])
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat.reshape(len(words), width)[:, a : width - b]


def near_in_bucket(owners: list[str], longer: list[str], a: int, b: int) -> Iterator[tuple[str, str]]:
    """Pairs that one edit makes equal within a bucket: words of one length with the first a and the last b code points in
    common, and words longer by one with the same beginning and end. A block against a block at a time."""
    step = lambda words: max(1, int((CELLS // (len(words[0]) + 1)) ** 0.5))
    for i in range(0, len(owners), step(owners)):
        mine = owners[i : i + step(owners)]
        x = codes(mine, a, b)
        for j in range(i, len(owners), step(owners)):
            other = owners[j : j + step(owners)]
            p, q = np.nonzero(one_replaced(x, codes(other, a, b)))
            yield from ((mine[s], other[t]) for s, t in zip(p.tolist(), q.tolist(), strict=True) if i < j or s < t)
        for j in range(0, len(longer), step(owners)):
            other = longer[j : j + step(owners)]
            p, q = np.nonzero(one_inserted(x, codes(other, a, b), b == 0))
            yield from ((mine[s], other[t]) for s, t in zip(p.tolist(), q.tolist(), strict=True))


def scan_shard(buckets: list[tuple[int, int, int, str, str]], words: dict[str, int]) -> Iterator[tuple[str, str]]:
    """Near pairs of an automaton shard: buckets (length, a, b, head, tail) and all words that may belong to them.

    The automaton holds every head and tail. A word belongs to a bucket if it holds the head at offset 0 and the tail at
    its end, and is of the bucket's length or longer by one.
    """
    heads: dict[str, list[int]] = {}
    tails: dict[str, list[int]] = {}
    for k, (_, _, _, head, tail) in enumerate(buckets):
        if head:
            heads.setdefault(head, []).append(k)
        if tail:
            tails.setdefault(tail, []).append(k)
    automaton = ahocorasick.Automaton()
    for segment in {*heads, *tails}:
        automaton.add_word(segment, segment)
    automaton.make_automaton()
    owners: list[list[str]] = [[] for _ in buckets]
    longer: list[list[str]] = [[] for _ in buckets]
    for word in words:
        at_start, at_end = [], []
        for end, segment in automaton.iter(word):
            if end + 1 == len(segment):
                at_start += heads.get(segment, [])
            if end + 1 == len(word):
                at_end += tails.get(segment, [])
        ends = set(at_end)
        found = [k for k in at_start if not buckets[k][4] or k in ends] + [k for k in at_end if not buckets[k][3]]
        for k in found:
            length, a, b, _, _ = buckets[k]
            # In a word that is longer by one, head and tail don't overlap; in one of the bucket's length they never do.
            if len(word) == length:
                owners[k].append(word)
            elif len(word) == length + 1:
                longer[k].append(word)
    for k, (_, a, b, _, _) in enumerate(buckets):
        if owners[k]:
            yield from near_in_bucket(owners[k], longer[k], a, b)


_KEY = ["length", "a", "b", "head", "tail"]


def _bucket(entries: DataFrame) -> DataFrame:
    """Adds a bucket's segments: the word's first a and last b code points."""
    return entries.withColumns({"head": F.expr("substring(word, 1, a)"), "tail": F.expr("IF(b = 0, '', right(word, b))")})


def _halves(length: Column) -> Column:
    """The two buckets of the words of a length: one keeps the first half, one the second."""
    half = F.floor(length / 2).cast("int")
    return F.array(
        F.struct(length.alias("length"), half.alias("a"), F.lit(0).alias("b")),
        F.struct(length.alias("length"), F.lit(0).alias("a"), (length - half).alias("b")),
    )


def near_words(words: DataFrame, ws: Workspace, bucket_rows: int = 1024) -> DataFrame:
    """word, near, near_n: each pair of near words of (word, n), in both directions.

    A word of length L goes to the buckets of its two halves, and to those of words of length L - 1 that it may extend.
    Buckets of more than `bucket_rows` words are split: of the stretch that their key leaves open, a half is added to
    the key, in two ways, and so on to a single open place. A pair belongs to the bucket whose open stretch holds the end
    of the two words' common beginning, so each is found once.
    """
    length = F.length("word").cast("int")
    homes = F.flatten(F.array(_halves(length), _halves(length - 1)))
    entries = _bucket(words.select("word", "n", F.explode(homes).alias("home")).select("word", "n", "home.*"))
    entries, level, cold = ws.save(entries, "entries0"), 0, []
    while True:
        sizes = entries.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.length("word") == F.col("length")).alias("owners"))
        sizes = ws.save(sizes.where("owners > 0 AND rows > 1"), f"sizes{level}")
        is_hot = (F.col("rows") > bucket_rows) & (F.col("length") - F.col("a") - F.col("b") > 1)
        cold.append(ws.save(entries.join(sizes.where(~is_hot).select(*_KEY), _KEY, "left_semi"), f"cold{level}"))
        hot = sizes.where(is_hot)
        if hot.isEmpty():
            break
        middle = F.col("a") + F.floor((F.col("length") - F.col("a") - F.col("b")) / 2).cast("int")
        children = F.array(F.struct(middle.alias("a"), F.col("b")), F.struct(F.col("a"), (F.col("length") - middle).alias("b")))
        split = entries.join(hot.select(*_KEY), _KEY, "left_semi").select("word", "n", "length", F.explode(children).alias("c")).select("word", "n", "length", "c.*")
        level += 1
        entries = ws.save(_bucket(split), f"entries{level}")
    found = cold[0]
    for more in cold[1:]:
        found = found.unionByName(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            left, right, n = [], [], []
            for x, y in scan_shard(buckets, words):
                left += (x, y)
                right += (y, x)
                n += (words[y], words[x])
            return pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

        # Rows come sorted by bucket; an automaton takes whole buckets.
        buckets: list[tuple] = []
        words: dict[str, int] = {}
        rows = 0
        for batch in batches:
            columns = [column(batch, name).to_pylist() for name in [*_KEY, "word", "n"]]
            for *key, word, n in zip(*columns, strict=True):
                rows += 1
                if not buckets or buckets[-1] != tuple(key):
                    if rows > AUTOMATON_ROWS:
                        yield out()
                        buckets, words, rows = [], {}, 1
                    buckets.append(tuple(key))
                words[word] = n
        if buckets:
            yield out()

    # Columns in the order of the key's, so that a bucket's rows stand together.
    dealt = found.select(*_KEY, "word", "n").repartition(*_KEY).sortWithinPartitions(*_KEY)
    pairs = ws.save(dealt.mapInArrow(run, "word string, near string, near_n long"), "pairs")
    ws.keep("pairs")
    return pairs


def follow(forms: DataFrame, ws: Workspace) -> DataFrame:
    """word, root of (word, form): the last word on the way from form to form. A form has at least `ratio` times its
    word's occurrences, so ways are short, and there are no circles."""
    roots, step = ws.save(forms.select("word", F.col("form").alias("root")), "roots0"), 0
    onward = forms.select(F.col("word").alias("_from"), F.col("form").alias("_to"))
    while True:
        moved = roots.join(onward, F.col("root") == F.col("_from"))
        if moved.isEmpty():
            return roots
        step += 1
        roots = ws.save(roots.join(onward, F.col("root") == F.col("_from"), "left").select("word", F.coalesce("_to", "root").alias("root")), f"roots{step}")
        ws.drop(f"roots{step - 1}")


def spelling_variants(df: DataFrame, ratio: int = 10, min_length: int = 7, min_count: int = 2, text_col: str = "text", id_col: str = "doc_id", bucket_rows: int = 1024) -> DataFrame:
    """One row per word of the texts (`word_counts`): word, form, root, n, n_near, form_n.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; n_near counts them. `form`
    is the near word with the most occurrences (ties: the smallest in code-point order), if these are at least `ratio`
    times the word's, else null; `root` is the end of the way from form to form, the word itself if it has none.

    Texts are counted word by word in each task before the shuffle. Only words are compared, in buckets of bounded size
    (`near_words`): a segment that many words share is split by further code points until a single place is open, so no
    bucket grows with the data. A word's near words are some 90 letters times its length at most.

    Null texts hold no words, null ids count as empty, repeated rows count again; other columns are not read. An empty
    table gives an empty result.
    """
    ws = Workspace(df.sparkSession, "spelling")
    words = ws.save(word_counts(df, min_length, min_count, text_col=text_col, id_col=id_col), "words")
    pairs = near_words(words, Workspace(df.sparkSession, "spelling-near"), bucket_rows)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form"), "near_n")).alias("best"))
    is_form = F.col("best.near_n") >= F.col("n") * ratio
    rows = words.join(best, "word", "left").select(
        "word",
        F.when(is_form, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near_n")).alias("form_n"),
    )
    rows = ws.save(rows, "rows")
    roots = follow(rows.where("form IS NOT NULL"), ws)
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def brute_force(rows: list[tuple[int | None, str | None]], ratio: int = 10, min_length: int = 7, min_count: int = 2, one_in: int = 31) -> dict[str, tuple]:
    """word -> (form, root, n, n_near, form_n), comparing every word with every other; for tests."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts: Counter = Counter()
    for name, text in rows:
        for found in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = found.translate(lower)
            h = zlib.crc32(f"{'' if name is None else name}:{word}".encode())
            if h % one_in == 0:
                word = "".join(c for k, c in enumerate(word) if k != h % len(word))
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}

    def is_near(x: str, y: str) -> bool:
        if len(x) > len(y):
            x, y = y, x
        if len(x) == len(y):
            return sum(p != q for p, q in zip(x, y, strict=True)) == 1
        return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))

    near = {w: [v for v in counts if v != w and is_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w: str) -> str:
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}
