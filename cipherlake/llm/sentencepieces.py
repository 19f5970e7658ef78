"""SentencePiece encoding and decoding on the tokenizers library."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm._frames import text_or_empty
from cipherlake.llm._text import column, spans, utf8_buffers
from cipherlake.shipping import ship_package

#: The metaspace marker that stands for a space.
MARK = "▁"
# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Threads of the library in each task, unless RAYON_NUM_THREADS is set: tasks run side by side already.
THREADS = "2"


def protobuf_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class SentencePieceModel:
    """What a model file says: pieces with scores and types, and its normaliser's switches."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    drop_extra_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> SentencePieceModel:
        model = cls()
        for number, value in protobuf_fields(data):
            if number == 1:
                got = dict(protobuf_fields(value))
                model.pieces.append(got[1].decode())
                model.scores.append(struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0])
                model.types.append(got.get(3, NORMAL))
            elif number == 2:
                got = dict(protobuf_fields(value))
                model.model_type, model.byte_fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
            elif number == 3:
                got = dict(protobuf_fields(value))
                model.charsmap = got.get(2, b"")
                model.dummy_prefix, model.drop_extra_spaces, model.escape_spaces = (bool(got.get(k, 1)) for k in (3, 4, 5))
        return model

    @property
    def unknown(self) -> int:
        return self.types.index(UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Every split of a piece into two pieces, best score first; what byte-pair training would have merged."""
        usable = {p for p, t in zip(self.pieces, self.types, strict=True) if t in (NORMAL, USER_DEFINED, UNUSED)}
        rank = {p: i for i, p in enumerate(self.pieces)}
        found = []
        for piece, score in zip(self.pieces, self.scores, strict=True):
            if piece in usable:
                pairs = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in usable and piece[k:] in usable]
                found += [(-score, rank[piece], rank[a], rank[b], a, b) for a, b in pairs]
        return [(a, b) for *_, a, b in sorted(found)]


class Codec:
    """Encodes and decodes with a model file's pieces, through the tokenizers library, whole texts at a time."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer, models, normalizers

        self.model = m = SentencePieceModel.parse(data)
        if m.model_type == UNIGRAM:
            core = models.Unigram(list(zip(m.pieces, m.scores, strict=True)), m.unknown, m.byte_fallback)
        elif m.model_type == BPE:
            vocab = {p: i for i, p in enumerate(m.pieces)}
            core = models.BPE(vocab, m.merges(), cache_capacity=0, unk_token=m.pieces[m.unknown], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are read")
        self.tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.drop_extra_spaces:
            steps += [normalizers.Replace(self._regex(" {2,}"), " "), normalizers.Strip()]
        self.normaliser = normalizers.Sequence(steps) if steps else None
        self.raw = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode()
            for p, t in zip(m.pieces, m.types, strict=True)
        ]

    @staticmethod
    def _regex(pattern: str):
        from tokenizers import Regex

        return Regex(pattern)

    def normalise(self, text: str) -> str:
        """The text as the model sees it, with spaces as markers; empty text stays empty."""
        if self.normaliser is not None:
            text = self.normaliser.normalize_str(text)
        if not text:
            return ""
        if self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape_spaces else text

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of each text; the library's threads share the batch."""
        got = self.tokenizer.encode_batch_fast([self.normalise(t) for t in texts], add_special_tokens=False)
        return [np.array(x.ids, dtype=np.int32) for x in got]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; runs of byte pieces form characters, bad ones become U+FFFD; the dummy prefix goes."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def encode_documents(
    df: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id", with_text: bool = False, chunk_bytes: int = 1 << 20
) -> DataFrame:
    """One row per input row: doc_id, ids (array<int>), n_tokens, n_bytes, round_trip; with `with_text` also `decoded`.

    Every text is encoded whole, then decoded again from its ids; round_trip says whether that gave the normalised
    text back. The model file (under 1 MB) is read on the driver and shipped with the task. Chunks of `chunk_bytes`
    are encoded at once by the library's threads. Null text is empty and has no tokens. A marker character in a text
    counts as a space, as in the model's own library. Null ids are carried; repeated rows give equal results; other
    columns are not read. An empty table gives an empty result.
    """
    ship_package(df.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        codec = Codec(model)
        for batch in batches:
            texts = column(batch, "text")
            _, offsets = utf8_buffers(texts)
            for i, j in spans(offsets, chunk_bytes):
                got = texts.slice(i, j - i).to_pylist()
                ids = codec.encode_batch(got)
                back = [codec.decode(x) for x in ids]
                want = [codec.normalise(t).replace(MARK, " ")[codec.model.dummy_prefix :] for t in got]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                arrays = [
                    column(batch, "doc_id").slice(i, j - i),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32())),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array(np.diff(offsets[i : j + 1])),
                    pa.array([a == b for a, b in zip(back, want, strict=True)], type=pa.bool_()),
                ]
                if with_text:
                    arrays.append(pa.array(back, type=pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    kinds = {"doc_id": dict(rows.dtypes)["doc_id"], "ids": "array<int>", "n_tokens": "long", "n_bytes": "long", "round_trip": "boolean"}
    if with_text:
        kinds["decoded"] = "string"
    names = list(kinds)
    return rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def decode_documents(df: DataFrame, model_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text of each row's ids (null ids: empty text)."""
    ship_package(df.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], dtype=np.int32)) for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
