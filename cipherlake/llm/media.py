"""Media columns: texts as 8-bit sound, and audio features as fixed-shape tensors with time spans."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm._frames import text_or_empty
from cipherlake.llm._text import column
from cipherlake.shipping import ship_package

PAD_BYTE, PAD_TO = 255, 576
RATE_IN, RATE_OUT = 16_000, 8_000
#: Frames of 32 ms that overlap by half, at RATE_OUT.
FRAME, HOP = 256, 128
N_MEL, N_SLOT = 16, 8
#: A span of sound begins above the first level and ends below the second (dB of a frame's mean energy).
LEVEL_ON, LEVEL_OFF = -9.8, -10.2
#: Samples handled at once.
BLOCK = 1 << 20
#: Rows of a tensor column.
PART = 256
#: The columns of media_columns, beside doc_id.
KINDS = {
    "n_bytes": "long", "media": "binary", "media_bytes": "long", "media_sha256": "string", "payload_bytes": "long",
    "payload_sha256": "string", "tail_crc32": "long", "tensor": "array<float>", "spans": "array<struct<start:double,end:double>>",
}


def wav_encode(samples: bytes, rate: int = RATE_IN) -> bytes:
    """A RIFF file with one channel of unsigned 8-bit PCM; an odd length gets the format's padding byte."""
    n = len(samples)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + samples + b"\0" * (n % 2)


def wav_decode(stored: bytes) -> tuple[int, bytes]:
    """(rate, samples): walks the chunks, as other writers may put more of them."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        kind, n = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif kind == b"data":
            return rate, stored[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def lowpass(up: int, down: int, taps_per_phase: int = 8) -> np.ndarray:
    """A Hann-windowed sinc for a rational change of rate, as `up` phases of equal length."""
    n = 2 * taps_per_phase * max(up, down)
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * cut * np.hanning(n + 2)[1:-1] * up
    h = np.pad(h, (0, -n % up))
    return h.reshape(-1, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, phases: np.ndarray) -> np.ndarray:
    """Polyphase: output k is phase (k * down) mod up of the filter, at input (k * down) // up. No zeros are inserted."""
    taps = phases.shape[1]
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps, np.float32)])
    n_out = (len(x) * up + down - 1) // down
    k = np.arange(up)
    out = np.empty(-(-n_out // up) * up, dtype=np.float32)
    for p in k:
        phase, first = (p * down) % up, (p * down) // up
        count = -(-n_out // up)
        acc = np.zeros(count, dtype=np.float32)
        for j, h in enumerate(phases[phase]):
            at = first + taps - 1 - j
            piece = padded[at : at + count * down : down]
            acc[: len(piece)] += h * piece
        out[p::up] = acc
    return out[:n_out]


def mel_filters(n_mel: int, frame: int, rate: int) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, over the bins of a real Fourier transform."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40.0), mel(rate / 2), n_mel + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(frame, 1 / rate)
    rise = (bins[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def hysteresis(level: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Frame spans [a, b) that begin at a level of `on` or more and last until it falls under `off`."""
    state = np.where(level >= on, 1, np.where(level < off, 0, -1))
    known = np.where(state >= 0, np.arange(len(state)), -1)
    last = np.maximum.accumulate(known)
    active = np.where(last >= 0, state[np.maximum(last, 0)], 0).astype(np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], active, [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_phases = lowpass(1, RATE_IN // RATE_OUT)
_mel = mel_filters(N_MEL, FRAME, RATE_OUT)
_window = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames, N_MEL) log energies in dB and each frame's level, in blocks, so memory doesn't grow with the text.

    The sound is followed by silence up to the end of the last frame, so that every sample lies in a frame.
    """
    x = np.frombuffer(samples, dtype=np.uint8)
    mels, levels = [], []
    step = BLOCK - BLOCK % (2 * HOP)
    n_frames = 1 + max(0, -(-(-(-len(x) * RATE_OUT // RATE_IN) - FRAME) // HOP))
    for a in range(0, len(x), step):
        piece = (x[a : a + step + 2 * (FRAME - HOP)].astype(np.float32) - 127.5) / 127.5
        y = resample(piece, 1, RATE_IN // RATE_OUT, _phases)
        n = min(step // (2 * HOP), n_frames - a // (2 * HOP))
        if n <= 0:
            break
        y = np.pad(y, (0, max(0, (n - 1) * HOP + FRAME - len(y))))[: (n - 1) * HOP + FRAME]
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        spectrum = np.fft.rfft(frames * _window)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels.append(10 * np.log10(power @ _mel.T + 1e-6))
        levels.append(10 * np.log10((frames * frames).mean(axis=1) + 1e-6))
    return np.concatenate(mels), np.concatenate(levels)


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """A tensor (N_SLOT, N_MEL): mean log-mel energies of N_SLOT equal parts of the sound; and its time spans in seconds."""
    mel, level = log_mel(samples)
    cuts = np.linspace(0, len(mel), N_SLOT + 1).astype(int)
    sums = np.concatenate([np.zeros((1, N_MEL)), np.cumsum(mel, axis=0, dtype=np.float64)])
    width = np.maximum(1, np.diff(cuts))
    lo = np.minimum(cuts[:-1], len(mel) - 1)
    tensor = (sums[lo + width] - sums[lo]) / width[:, None]
    seconds = HOP / RATE_OUT
    return tensor.astype(np.float32), [(a * seconds, b * seconds) for a, b in hysteresis(level, LEVEL_ON, LEVEL_OFF)]


def payload_of(text: bytes) -> bytes:
    n = max(PAD_TO, -(-len(text) // PAD_TO) * PAD_TO)
    return text + bytes([PAD_BYTE]) * (n - len(text))


def tensor_column(tensors: list[np.ndarray]) -> pa.Array:
    """Equally shaped tensors as one Arrow fixed-shape tensor column."""
    flat = np.stack(tensors) if tensors else np.zeros((0, N_SLOT, N_MEL), dtype=np.float32)
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(flat, dtype=np.float32))


def media_columns(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", with_media: bool = True) -> DataFrame:
    """One row per input row: the text as a sound file, and its features.

    Columns: doc_id, n_bytes, media (the WAV file; left out if not `with_media`), media_bytes, media_sha256,
    payload_bytes, payload_sha256, tail_crc32, tensor (N_SLOT x N_MEL floats, row by row: mean log-mel energies in
    dB), spans (array of start and end in seconds). Payload figures and features come from the file's bytes, read
    back. In this table tensors are lists, as Spark has no fixed shapes; `tensor_batches` stores them as Arrow
    fixed-shape tensor columns, and `read_tensors` reads these back.

    The text is cut into no windows by content: every byte is a sample. Each text is computed on its own, so equal
    texts give equal values, whatever their batch. Memory is one batch plus blocks of 1 MB. Null text is empty (one
    padded block of 576 bytes). Null ids are carried. Other columns are not read. An empty table gives an empty
    result.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("data"))
    rows = rows.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), "data")
    return described(rows, lambda text: wav_encode(payload_of(text)), with_media)


def media_files(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The media column alone, to be stored: doc_id, n_bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = column(part, "text").cast(pa.large_binary()).to_pylist()
                media = pa.array([wav_encode(payload_of(t)) for t in texts], type=pa.binary())
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([len(t) for t in texts], type=pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    ship_package(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, media binary")


def media_features(files: DataFrame) -> DataFrame:
    """`media_columns` without the media, from a stored media column (doc_id, n_bytes, media) such as `media_files` makes."""
    return described(files.select("doc_id", "n_bytes", F.col("media").alias("data")), bytes, False)


def _figures(part: pa.RecordBatch, store: Callable[[bytes], bytes], with_media: bool) -> pa.RecordBatch:
    """The columns of `media_columns` for a batch (doc_id, n_bytes, data); tensors form a fixed-shape tensor column."""
    span = pa.struct([("start", pa.float64()), ("end", pa.float64())])
    out: dict[str, list] = {k: [] for k in ("media", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "tensor", "spans")}
    for data in column(part, "data").cast(pa.large_binary()).to_pylist():
        stored = store(data)
        _, payload = wav_decode(stored)
        tensor, spans = features(payload)
        out["media"].append(stored if with_media else None)
        out["media_bytes"].append(len(stored))
        out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
        out["payload_bytes"].append(len(payload))
        out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
        out["tail_crc32"].append(zlib.crc32(payload[-32:]))
        out["tensor"].append(tensor)
        out["spans"].append([{"start": a, "end": b} for a, b in spans])
    tensors = tensor_column(out.pop("tensor"))
    kinds = {"media": pa.binary(), "media_sha256": pa.string(), "payload_sha256": pa.string(), "spans": pa.list_(span)}
    arrays = {k: pa.array(v, type=kinds.get(k, pa.int64())) for k, v in out.items()} | {"n_bytes": column(part, "n_bytes"), "tensor": tensors}
    names = [k for k in KINDS if k != "media" or with_media]
    return pa.RecordBatch.from_arrays([column(part, "doc_id"), *(arrays[k] for k in names)], names=["doc_id", *names])


def _flat(batch: pa.RecordBatch) -> pa.RecordBatch:
    """With tensors as lists, as Spark has no fixed shapes."""
    at = batch.schema.get_field_index("tensor")
    return batch.set_column(at, "tensor", batch.column(at).storage.cast(pa.list_(pa.float32())))


def described(rows: DataFrame, store: Callable[[bytes], bytes], with_media: bool) -> DataFrame:
    """The columns of `media_columns` for rows (doc_id, n_bytes, data), where `store` makes the WAV file of `data`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                yield _flat(_figures(batch.slice(at, PART), store, with_media))

    ship_package(rows.sparkSession)
    names = [k for k in KINDS if k != "media" or with_media]
    return rows.mapInArrow(run, ", ".join([f"doc_id {dict(rows.dtypes)['doc_id']}", *(f"{k} {KINDS[k]}" for k in names)]))


def tensor_batches(files: DataFrame) -> DataFrame:
    """Features to be stored: n_rows and `batch`, an Arrow stream of up to PART rows with doc_id, the figures, a fixed-shape
    tensor column and the time spans, from a media column (doc_id, n_bytes, media).

    A row is some 200 KB whatever the texts; any reader of Arrow streams gets the tensors with their shape.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                made = _figures(batch.slice(at, PART), bytes, False)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, made.schema) as writer:
                    writer.write_batch(made)
                yield pa.RecordBatch.from_arrays([pa.array([made.num_rows], type=pa.int64()), pa.array([sink.getvalue().to_pybytes()], type=pa.binary())], names=["n_rows", "batch"])

    ship_package(files.sparkSession)
    return files.select("doc_id", "n_bytes", F.col("media").alias("data")).mapInArrow(run, "n_rows long, batch binary")


def read_tensors(stored: DataFrame, id_type: str = "long") -> DataFrame:
    """The rows of stored `tensor_batches`, with tensors as lists of N_SLOT x N_MEL values; a column of another shape is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in column(batch, "batch"):
                for part in pa.ipc.open_stream(value.as_buffer()):
                    kind = part.schema.field("tensor").type
                    if not isinstance(kind, pa.FixedShapeTensorType) or kind.shape != [N_SLOT, N_MEL]:
                        raise ValueError(f"not a tensor column of {N_SLOT} x {N_MEL}: {kind}")
                    yield _flat(part)

    ship_package(stored.sparkSession)
    names = [k for k in KINDS if k != "media"]
    return stored.select("batch").mapInArrow(run, ", ".join([f"doc_id {id_type}", *(f"{k} {KINDS[k]}" for k in names)]))


def feature_digest(media: DataFrame) -> DataFrame:
    """The contract's columns: `feature` joins the tensor's values, rounded to whole dB, and the number and length of spans."""
    values = F.array_join(F.transform("tensor", lambda v: F.round(v).cast("int").cast("string")), " ")
    length = F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["end"] - s["start"])
    feature = F.concat(F.lit(f"{N_SLOT}x{N_MEL}:"), values, F.lit(";"), F.size("spans").cast("string"), F.lit(" spans "), F.format_number(length, 3))
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
