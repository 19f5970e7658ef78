import random

import numpy as np
import pytest

from cipherlake.llm.queries import TOKENIZERS
from cipherlake.llm.sentencepieces import BPE, BYTE, CONTROL, NORMAL, UNIGRAM, UNKNOWN, Codec, SentencePieceModel, decode_documents, encode_documents

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return Codec(f.read())


@pytest.fixture(scope="module")
def reference():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_parity_on_documents(codec, reference, docs):
    texts = [r.text for r in docs.collect()]
    assert [x.tolist() for x in codec.encode_batch(texts)] == reference.encode(texts)


def test_parity_on_random_texts(codec, reference):
    rng = random.Random(4)
    parts = [" ", "  ", "   ", " " * 9, " " * 40, "a", "the", "\n", "\t", "é", "漢", "🙂", "http://x", "==", "____", "0", "\x00", "▁", "<s>", "<0x0A>", "ing", "ﬁ", "​", "z" * 300]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        assert ids.tolist() == reference.encode(text)
        assert codec.decode(ids) == reference.decode(ids.tolist())


def test_decoding_any_ids(codec, reference):
    rng = np.random.default_rng(1)
    for _ in range(200):
        ids = rng.integers(3, 32_000, 20)
        assert codec.decode(ids) == reference.decode(ids.tolist())


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


def unigram_model():
    """A small unigram model file with byte fallback, written by hand."""
    import struct

    pieces = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL)] + [(f"<0x{b:02X}>", 0.0, BYTE) for b in range(256)]
    pieces += [("▁", -2.0, NORMAL), ("▁the", -3.0, NORMAL), ("cat", -4.0, NORMAL), ("s", -3.5, NORMAL), ("c", -6.0, NORMAL), ("a", -6.0, NORMAL), ("t", -6.0, NORMAL), ("▁cat", -4.5, NORMAL), ("h", -7.0, NORMAL), ("e", -5.0, NORMAL)]
    body = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + field(3, t)) for p, s, t in pieces)
    return body + field(2, field(3, UNIGRAM) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))


def test_unigram_parity(tmp_path):
    import sentencepiece

    data = unigram_model()
    (tmp_path / "u.model").write_bytes(data)
    want = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = Codec(data)
    assert codec.model.model_type == UNIGRAM and codec.model.byte_fallback
    for text in ("the cats", "  the   cat ", "chat é", "", "x", "the the\ncat"):
        assert codec.encode_batch([text])[0].tolist() == want.encode(text), text


def test_model_file(codec):
    m = codec.model
    assert m.model_type == BPE and len(m.pieces) == 32_000 and m.dummy_prefix and not m.drop_extra_spaces and m.byte_fallback
    assert SentencePieceModel.parse(b"").pieces == []


def test_nasty_rows(nasty, nothing):
    rows = encode_documents(nasty, MODEL, with_text=True).collect()
    texts = sorted((r.text or "") for r in nasty.collect())
    assert sorted(r.decoded for r in rows) == texts and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert encode_documents(nothing, MODEL).count() == 0
    back = decode_documents(encode_documents(nasty, MODEL), MODEL)
    assert sorted(r.text for r in back.collect()) == texts


def test_whole_table(docs):
    rows = encode_documents(docs, MODEL, chunk_bytes=1000).collect()
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)
