"""Toxicity: a linear-chain conditional random field over words, and document scores from its marginals."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherlake.llm._frames import Workspace, text_or_empty
from cipherlake.llm._text import U64, column, combine, span_hashes, spans, utf8_buffers, words
from cipherlake.shipping import ship_package

#: Slots of the scoring table, as a power of two.
BITS = 20
PREFIX_BYTES = 5
#: Words of a training segment; scoring uses whole texts.
SEGMENT = 96
#: Words of a block in training.
BLOCK_WORDS = 300_000
#: Ratios of the two states' messages are kept within this range.
RATIO = 1e6


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, words per row, and two 64-bit hashes per word: of the word without punctuation around it, and of its first bytes."""
    starts, ends, counts = words(data, offsets)
    if not len(starts):
        return starts, ends, counts, np.zeros((0, 2), dtype=U64)
    # ASCII punctuation around a word is dropped, unless there is nothing else.
    plain = (data >= 128) | (data >= 48) & (data < 58) | (data >= 65) & (data < 91) | (data >= 97) & (data < 123)
    at = np.flatnonzero(plain)
    if len(at):
        head, tail = np.searchsorted(at, starts), np.searchsorted(at, ends) - 1
        some = head <= tail
        begin, stop = np.where(some, at[np.minimum(head, len(at) - 1)], starts), np.where(some, at[tail] + 1, ends)
    else:
        begin, stop = starts, ends
    whole = span_hashes(data, begin, stop)
    # The factor keeps a short word apart from itself as a prefix.
    first = span_hashes(data, begin, np.minimum(stop, begin + PREFIX_BYTES)) * U64(0xC2B2AE3D27D4EB4F)
    return starts, ends, counts, np.stack([whole, first], axis=1)


def in_pieces(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 18) -> tuple[np.ndarray, ...]:
    """`word_features` of many rows, a few rows at a time: the hashes' working memory stays small."""
    made = []
    for i, j in spans(offsets, limit):
        starts, ends, counts, index = word_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        made.append((starts + offsets[i], ends + offsets[i], counts, index))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def messages(emission: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages of the toxic state over the other's at each word, and the words' own factors, by
    passes over all rows at once. Forward ones hold the word's factor, backward ones do not.

    `emission` is the toxic state's log-odds, `trans` the 2 x 2 transition factors. Rows are taken longest first, so
    each step works on the rows that still have words.
    """
    factor = np.exp(np.clip(emission, -12, 12))
    forward, backward = np.ones(len(emission)), np.ones(len(emission))
    order = np.argsort(-counts, kind="stable")
    lengths = counts[order]
    if not len(lengths) or not lengths[0]:
        return forward, backward, factor
    first = (np.cumsum(counts) - counts)[order]
    longest = int(lengths[0])
    alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    (a, b), (c, d) = trans
    r = np.ones(len(lengths))
    for t in range(longest):
        n = alive[t]
        at = first[:n] + t
        r = factor[at] * ((b + d * r[:n]) / (a + c * r[:n]) if t else 1.0)
        r = np.clip(r, 1 / RATIO, RATIO)
        forward[at] = r
    r = np.zeros(0)
    for t in range(longest - 1, 0, -1):
        n, had = alive[t], len(r)
        x = np.ones(n)
        x[:had] = r
        x = factor[first[:n] + t] * x
        r = np.clip((c + d * x) / (a + b * x), 1 / RATIO, RATIO)
        backward[first[:n] + t - 1] = r
    return forward, backward, factor


def chain(emission: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The marginal chance of the toxic state at each word."""
    forward, backward, _ = messages(emission, counts, trans)
    odds = forward * backward
    return odds / (1 + odds)


def pair_chances(emission: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, first words of neighbouring pairs, 4 x pairs chances of clean-clean, clean-toxic, toxic-clean, toxic-toxic)."""
    forward, backward, factor = messages(emission, counts, trans)
    odds = forward * backward
    row = np.repeat(np.arange(len(counts)), counts)
    left = np.flatnonzero(row[1:] == row[:-1])
    r, x = forward[left], factor[left + 1] * backward[left + 1]
    pairs = np.stack([np.ones(len(left)), x, r, r * x]) * trans.reshape(4, 1)
    return odds / (1 + odds), left, pairs / pairs.sum(axis=0)


@dataclass
class ToxicityModel:
    """owner, weights: the toxic state's log-odds of features, by slot; a slot is its owner's alone, so other words
    that fall into it weigh nothing. trans: transition factors; head: of the document score."""

    owner: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    head: np.ndarray

    @classmethod
    def of(cls, features: np.ndarray, weights: np.ndarray, bias: float, trans: np.ndarray) -> ToxicityModel:
        """Each slot goes to its feature of the largest weight."""
        owner, table = np.zeros(1 << BITS, dtype=U64), np.zeros(1 << BITS, dtype=np.float32)
        order = np.argsort(np.abs(weights), kind="stable")
        slot = (features[order] & U64((1 << BITS) - 1)).astype(np.int64)
        owner[slot], table[slot] = features[order], weights[order]
        return cls(owner, table, bias, trans, np.zeros(5))

    def marginals(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        slot = (hashes & U64((1 << BITS) - 1)).astype(np.int64)
        weight = np.where(self.owner[slot] == hashes, self.weights[slot], 0)
        return chain(weight.sum(axis=1, dtype=np.float64) + self.bias, counts, self.trans)

    def document_features(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        # Only words that are rather toxic than not are summed: a long text of unknown words has no score for its length.
        ends = np.cumsum(counts)
        sums = np.concatenate([[0.0], np.cumsum(np.where(p >= 0.5, p, 0.0))])
        sure = np.concatenate([[0.0], np.cumsum(p >= 0.5)])
        total = sums[ends] - sums[ends - counts]
        most = np.zeros(len(counts))
        some = counts > 0
        if some.any():
            most[some] = np.maximum.reduceat(p, (ends - counts)[some])
        share = total / np.maximum(1, counts)
        return np.stack([np.ones(len(counts)), most, np.log1p(total), np.log1p(sure[ends] - sure[ends - counts]), np.sqrt(share)], axis=1)

    def scores(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.document_features(p, counts) @ self.head, -30, 30)))


def families(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number per document that near copies tend to share: its smallest hash of three words in a row."""
    n = len(hashes) - 2
    grams = combine([hashes[k : k + n, 0] for k in range(3)]) if n > 0 else hashes[:0, 0]
    ends = np.cumsum(counts)
    least = np.array([grams[e - c : e - 2].min() if c >= 3 else U64(k) for k, (c, e) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True))], dtype=U64)
    return np.unique(least, return_inverse=True)[1]


def label_words(ids: np.ndarray, n_ids: int, counts: np.ndarray, toxic: np.ndarray, family: np.ndarray, least: int, purity: float) -> np.ndarray:
    """Word labels from document labels: in toxic documents, words one of whose features occurs in at least `least`
    families of toxic documents, or in a fiftieth of these if that is more, and these are at least `purity` of all
    families that have it.

    Families, not documents, are counted: else any rare word of a toxic text with copies would be toxic.
    """
    row = np.repeat(np.arange(len(counts)), counts)
    flagged = np.zeros(len(ids), dtype=bool)
    least = max(least, len(np.unique(family[toxic == 1])) // 50)
    for k in range(ids.shape[1]):
        pair = family[row] * np.int64(n_ids) + ids[:, k]
        bad, good = (np.bincount(np.unique(pair[toxic[row] == label]) % n_ids, minlength=n_ids) for label in (1, 0))
        flagged |= ((bad >= least) & (bad >= purity * (bad + good)))[ids[:, k]]
    return flagged & (toxic[row] == 1)


def transitions(w: np.ndarray) -> np.ndarray:
    """The transition factors of a parameter vector, whose last three entries are their logarithms but for clean-clean."""
    return np.exp(np.clip(np.array([[0.0, w[-3]], [w[-2], w[-1]]]), -6, 6))


def loss_gradient(w: np.ndarray, ids: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The gradient of the labels' negative log-likelihood; `w` holds the features' weights, the bias, three transitions."""
    grad = np.zeros_like(w)
    p, left, pairs = pair_chances(w[:-4][ids].sum(axis=1) + w[-4], counts, transitions(w))
    miss = p - labels
    for k in range(ids.shape[1]):
        grad[:-4] += np.bincount(ids[:, k], weights=miss, minlength=len(w) - 4)
    grad[-4] = miss.sum()
    c, d = labels[left], labels[left + 1]
    grad[-3:] = pairs[1:].sum(axis=1) - np.array([((1 - c) * d).sum(), (c * (1 - d)).sum(), (c * d).sum()])
    return grad


def fit_chain(ids: np.ndarray, n_ids: int, counts: np.ndarray, labels: np.ndarray, rounds: int, decay: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximum likelihood by full-batch Adam, with the exact gradient (scaled by group); returns the features' weights, bias
    and transition factors."""
    counts = np.concatenate([[SEGMENT] * (c // SEGMENT) + [c % SEGMENT] * (c % SEGMENT > 0) for c in counts.tolist()] or [[]]).astype(np.int64)
    y = labels.astype(np.float32)
    seen = np.sqrt(np.maximum(1, sum(np.bincount(ids[:, k], minlength=n_ids) for k in range(ids.shape[1]))))
    rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    w = np.concatenate([np.zeros(n_ids), [np.log(rate / (1 - rate))], np.zeros(3)])
    m, v = np.zeros_like(w), np.zeros_like(w)
    # Blocks of segments bound the memory of a step.
    ends = np.cumsum(counts)
    edges = sorted({0, len(counts), *np.searchsorted(ends, np.arange(BLOCK_WORDS, len(y), BLOCK_WORDS)).tolist()})
    blocks = [(slice(i, j), slice(int(ends[i] - counts[i]), int(ends[j - 1]))) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    for step in range(1, rounds + 1):
        grad = sum((loss_gradient(w, ids[at], y[at], counts[rows]) for rows, at in blocks), np.zeros_like(w))
        grad[:-4] = grad[:-4] / seen + decay * w[:-4]
        grad[-4] *= 50 / max(1, len(y))
        grad[-3:] /= max(1.0, float(y.sum()))
        m, v = 0.8 * m + 0.2 * grad, 0.95 * v + 0.05 * grad**2
        w -= 0.5 * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-3)
    return w[:-4], float(w[-4]), transitions(w)


def fit_head(x: np.ndarray, y: np.ndarray, decay: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (p - y) + decay * w)
    return w


def fit(texts: list[str], toxic: np.ndarray, least: int = 4, purity: float = 0.9, rounds: int = 30, decay: float = 1e-3) -> ToxicityModel:
    """Word labels and chain from two thirds of the texts, the document score's head from the rest.

    Without texts of both labels the model gives every document the labels' mean.
    """
    toxic = np.asarray(toxic, dtype=np.int64)
    flat = ToxicityModel.of(np.zeros(0, U64), np.zeros(0), -12.0, np.ones((2, 2)))
    if len(texts) < 3 or len(set(toxic.tolist())) < 2:
        mean = float(np.clip(toxic.mean() if len(toxic) else 0.0, 1e-6, 1 - 1e-6))
        flat.head[0] = np.log(mean / (1 - mean))
        return flat
    parts = [[i for i in range(len(texts)) if (i % 3 == 2) == late] for late in (False, True)]
    made = []
    for part in parts:
        data, offsets = utf8_buffers(pa.array([texts[i] for i in part], type=pa.large_string()))
        _, _, counts, index = in_pieces(data, offsets)
        made.append((index, counts, toxic[part]))
    hashes, counts, y = made[0]
    features, ids = np.unique(hashes, return_inverse=True)
    ids = ids.reshape(hashes.shape).astype(np.int32)
    weights, bias, trans = fit_chain(ids, len(features), counts, label_words(ids, len(features), counts, y, families(hashes, counts), least, purity), rounds, decay)
    model = ToxicityModel.of(features, weights, bias, trans)
    hashes, counts, y = made[1]
    model.head = fit_head(model.document_features(model.marginals(hashes, counts), counts), y)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, folds: int, held_fold: int, text_col: str, id_col: str) -> tuple[list[str], np.ndarray]:
    """Labelled rows outside the held-out fold, by the order of a hash of the id, up to `max_rows` rows and `max_bytes`
    bytes of whole texts; the driver gets no more. A repeated id counts once."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    known = known.where(fold != held_fold).withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(max_rows)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    rows = Workspace(docs.sparkSession, "toxicity").save(own.groupBy("place", "doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    # A window over at most `max_rows` rows.
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    taken = rows.withColumn("so_far", so_far).where(F.col("so_far") <= max_bytes).select("place", "doc_id", "text", "toxic").collect()
    taken.sort(key=lambda r: (r.place, r.doc_id))
    return [r.text for r in taken], np.array([r.toxic for r in taken], dtype=np.int64)


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = 5000, folds: int = 3, held_fold: int = 1, text_col: str = "text", id_col: str = "doc_id", max_bytes: int = 64 << 20
) -> ToxicityModel:
    """A model from a bounded sample of labelled rows: at most `max_rows` of `max_bytes` in all, none from the held-out fold."""
    model = fit(*training_rows(docs, labels, max_rows, max_bytes, folds, held_fold, text_col, id_col))
    give_back_memory()
    return model


def give_back_memory() -> None:
    """Returns the training's freed memory to the system, where the C library can; the driver lives on for long."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text", id_col: str = "doc_id", keep: bool = False, chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), n_words, toxic_words (expected number), spans (array of start,
    end, chance: runs of words with a marginal of 0.5 or more; code points, end exclusive).

    With `keep`, the input's own columns are returned with `_score` added instead.

    The score is a logistic function of the largest marginal, and of the number, sum and share of words at 0.5 or more.
    Only the text is an input of a score. Texts are whole; memory is bounded by one Arrow batch and a chunk of
    `chunk_bytes` (or one text). Null text is empty and scores as no words. Null ids are carried, repeated rows score
    alike. An empty table gives an empty result.
    """
    ship_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)  # 12 MB of owners and weights, whatever the corpus
    names = df.columns
    place = names.index(text_col)

    def scored(values: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, tuple]]:
        data, offsets = utf8_buffers(values)
        for i, j in spans(offsets, chunk_bytes):
            piece, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, counts, index = in_pieces(piece, own)
            p = sent.value.marginals(index, counts)
            yield i, j, sent.value.scores(p, counts), p, counts, (piece, own, starts, ends)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [s for _, _, s, *_ in scored(batch.column(place))]
            score = pa.array(np.concatenate(made) if made else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())])
        for batch in batches:
            ids = column(batch, "doc_id")
            for i, j, score, p, counts, (piece, own, starts, ends) in scored(column(batch, "text")):
                found = [[] for _ in range(j - i)]
                hot = np.flatnonzero(p >= 0.5)
                if len(hot):
                    row = np.searchsorted(own, starts[hot], side="right") - 1
                    breaks = np.flatnonzero((np.diff(hot) > 1) | (np.diff(row) > 0)) + 1
                    for run_ in np.split(np.arange(len(hot)), breaks):
                        r, a, b = row[run_[0]], starts[hot[run_[0]]], ends[hot[run_[-1]]]
                        before = int(np.count_nonzero((piece[own[r] : a] & 0xC0) != 0x80))
                        inside = int(np.count_nonzero((piece[a:b] & 0xC0) != 0x80))
                        found[r].append({"start": before, "end": before + inside, "chance": round(float(p[hot[run_]].max()), 6)})
                total = np.concatenate([[0.0], np.cumsum(p)])
                stop = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(score), pa.array(counts), pa.array(total[stop] - total[stop - counts]), pa.array(found, type=pa.list_(span))],
                    names=["doc_id", "score", "n_words", "toxic_words", "spans"],
                )

    if keep:
        schema = T.StructType([*df.schema.fields, T.StructField("_score", T.DoubleType())])
        return df.mapInArrow(kept, schema)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    place = 1
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, n_words long, toxic_words double, spans array<struct<start:int,end:int,chance:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 5000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that score under `threshold`, with all their columns."""
    scored = score_toxicity(docs, train(docs, labels, max_rows, text_col=text_col, id_col=id_col), text_col, id_col, keep=True)
    return scored.where(F.col("_score") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
