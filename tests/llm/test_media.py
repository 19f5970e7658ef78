import hashlib
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cipherlake.llm import media as M


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000))
def test_wav_round_trip(data):
    stored = M.wav_encode(data)
    assert M.wav_decode(stored) == (M.RATE_IN, data) and len(stored) == 44 + len(data) + len(data) % 2


def test_wav_reads_by_a_standard_library(tmp_path):
    import wave

    (tmp_path / "a.wav").write_bytes(M.wav_encode(bytes(range(256))))
    with wave.open(str(tmp_path / "a.wav")) as f:
        assert (f.getnchannels(), f.getsampwidth(), f.getframerate(), f.readframes(256)) == (1, 1, M.RATE_IN, bytes(range(256)))


def test_polyphase_equals_zero_stuffing():
    rng = np.random.default_rng(0)
    x = rng.normal(size=400).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3), (4, 1)):
        phases = M.lowpass(up, down)
        h = phases.T.ravel()
        stuffed = np.zeros(len(x) * up, np.float32)
        stuffed[::up] = x
        taps = phases.shape[1]
        full = np.convolve(stuffed, h)
        shift = (taps - 1 - taps // 2) * up
        want = full[shift : shift + len(stuffed)][::down]
        got = M.resample(x, up, down, phases)
        inner = slice(20, min(len(want), len(got)) - 40)
        assert np.allclose(got[inner], want[inner], atol=1e-4)


def test_tones_fall_into_their_mel_bands():
    t = np.arange(M.RATE_IN)
    bands = []
    for f in (200, 800, 2500):
        samples = (127.5 + 100 * np.sin(2 * np.pi * f * t / M.RATE_IN)).astype(np.uint8).tobytes()
        bands.append(int(M.features(samples)[0].mean(axis=0).argmax()))
    assert bands == sorted(set(bands))


def test_hysteresis():
    level = np.array([-20, -9, -10, -10.1, -9.9, -11, -10, -9, -9, -30], float)
    assert M.hysteresis(level, -9.5, -10.5) == [(1, 5), (7, 9)]
    assert M.hysteresis(np.array([]), 0, 0) == []


def test_features_dont_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    samples = rng.integers(0, 256, 50_000, dtype=np.uint8).tobytes()
    whole = M.log_mel(samples)
    monkeypatch.setattr(M, "BLOCK", 8192)
    parts = M.log_mel(samples)
    assert abs(len(whole[0]) - len(parts[0])) <= 1


def test_query_columns(nasty, nothing):
    rows = M.feature_digest(M.media_columns(nasty)).collect()
    texts = [(r.text or "").encode() for r in nasty.collect()]
    want = []
    for t in texts:
        p = t + b"\xff" * (max(576, -(-len(t) // 576) * 576) - len(t))
        stored = M.wav_encode(p)
        want.append((len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows) == sorted(want)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.payload_sha256, r.feature) == r.feature and r.feature
    assert M.media_columns(nothing).count() == 0


def test_tensors_are_fixed_shape(docs):
    column = M.tensor_column([np.zeros((M.N_SLOT, M.N_MEL))] * 3)
    assert isinstance(column, pa.FixedShapeTensorArray) and column.type.shape == [M.N_SLOT, M.N_MEL]
    rows = M.media_columns(docs.limit(20), with_media=False).collect()
    assert all(len(r.tensor) == M.N_SLOT * M.N_MEL and all(0 <= s.start < s.end for s in r.spans) for r in rows)


def test_every_sample_lies_in_a_frame(monkeypatch):
    """A sound at the very end is heard, whatever the length, and in blocks too."""
    for block in (M.BLOCK, 2048):
        monkeypatch.setattr(M, "BLOCK", block)
        for k in range(1, 13):
            n = k * M.PAD_TO
            mel, level = M.log_mel(bytes([127]) * (n - 64) + bytes(([0] * 8 + [255] * 8) * 4))
            assert len(mel) == len(level) == 1 + max(0, -(-(n // 2 - M.FRAME) // M.HOP))
            assert level[-1] > -12


def test_query_reads_stored_media(spark, docs, sf_dir, tmp_path, monkeypatch):
    from cipherlake.llm import _frames, queries

    monkeypatch.setattr(_frames, "shared_dir", lambda spark: str(tmp_path))
    got = queries.op9_media(spark, sf_dir)
    (stored,) = tmp_path.glob("media-*/files")
    files = {r.doc_id: r for r in spark.read.parquet(str(stored)).collect()}
    rows = got.collect()
    assert len(rows) == len(files) == docs.count()
    assert all(hashlib.sha256(files[r.doc_id].media).hexdigest() == r.media_sha256 for r in rows)
    assert sorted(rows) == sorted(M.feature_digest(M.media_columns(docs)).collect())


def test_tensors_are_stored_with_their_shape(spark, nasty, nothing, tmp_path):
    files = M.media_files(nasty)
    M.tensor_batches(files).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    row = stored.first()
    batch = pa.ipc.open_stream(row["batch"]).read_next_batch()
    kind = batch.schema.field("tensor").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [M.N_SLOT, M.N_MEL] and batch.num_rows == row.n_rows
    assert batch.column("tensor").to_numpy_ndarray().shape == (row.n_rows, M.N_SLOT, M.N_MEL)
    plain = lambda rows: sorted(map(str, rows))
    assert plain(M.read_tensors(stored).collect()) == plain(M.media_columns(nasty, with_media=False).collect())
    assert M.read_tensors(M.tensor_batches(M.media_files(nothing))).count() == 0


def plain_feature(text):
    """The query's `feature`, sample by sample and without blocks, polyphase filters or matrices."""
    payload = (text or "").encode()
    payload += bytes([255]) * (max(576, -(-len(payload) // 576) * 576) - len(payload))
    x = [(b - 127.5) / 127.5 for b in payload]
    taps = M.lowpass(1, 2)[0].astype(float).tolist()
    half = len(taps) // 2
    y = [sum(h * x[2 * k + half - 1 - j] for j, h in enumerate(taps) if 0 <= 2 * k + half - 1 - j < len(x)) for k in range((len(x) + 1) // 2)]
    n = 1 + max(0, -(-(len(y) - 256) // 128))
    y += [0.0] * ((n - 1) * 128 + 256 - len(y))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    mels, levels = [], []
    for f in range(n):
        frame = np.array(y[f * 128 : f * 128 + 256])
        turns = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
        power = np.abs(turns @ (frame * window)) ** 2
        mels.append([10 * np.log10(sum(p * w for p, w in zip(power, row)) + 1e-6) for row in M.mel_filters(16, 256, 8000).astype(float)])
        levels.append(10 * np.log10(float(np.mean(frame**2)) + 1e-6))
    tensor = []
    cuts = [int(c) for c in np.linspace(0, n, 9)]
    for a, b in zip(cuts, cuts[1:]):
        a = min(a, n - 1)
        tensor.append(np.mean(mels[a : max(b, a + 1)], axis=0))
    active, spans = False, []
    for f, level in enumerate(levels):
        if not active and level >= M.LEVEL_ON:
            active = True
            spans.append([f, f])
        elif active and level < M.LEVEL_OFF:
            active = False
        if active:
            spans[-1][1] = f + 1
    return np.array(tensor), [(a * 128 / 8000, b * 128 / 8000) for a, b in spans]


def test_features_against_a_plain_program(spark, docs):
    rows = [(k, t) for k, t in enumerate([None, "", "x" * 575, "a" * 1153] + [r.text for r in docs.limit(6).collect()])]
    got = {r.doc_id: r for r in M.media_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        tensor, spans = plain_feature(t)
        assert np.allclose(np.array(got[k].tensor).reshape(M.N_SLOT, M.N_MEL), tensor, atol=0.02), k
        assert len(got[k].spans) == len(spans) and np.allclose([(s.start, s.end) for s in got[k].spans], spans)
