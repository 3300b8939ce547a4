"""Media columns: 8-bit audio, and features of it as fixed-shape tensors.

``encode_media`` stores bytes as the samples of a WAV file (8-bit, mono, 12 kHz), padded with
255 to a whole number of blocks of 576. ``audio_features`` reads the samples back, resamples
them to 8 kHz by a polyphase filter (2 phases of 24 taps, every third output), and takes the log-mel energies of
overlapping frames (32 ms, half of it shared). They are kept as an Arrow stream of 64 x 32
tensors, each with its time span. Hysteresis on frame energy (begin at mean + half a
deviation, end below the mean) gives the segments that are loud.

Null text counts as empty: one block of padding. Equal texts give equal bytes and features; repeated
rows each have a row; an empty table gives an empty result. Long recordings are worked through in
stretches, so memory beyond the recording itself is bounded.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_and_text

BLOCK = 576
RATE, UP, DOWN = 12_000, 2, 3
FRAME, HOP, MELS, PATCH = 256, 128, 32, 64
_TAPS = 24
_STRETCH = 4_096  # frames
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = (
    "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long,"
    " features binary, tensors int, segments array<struct<start_s: double, end_s: double>>"
)


def to_wav(data: bytes) -> bytes:
    padded = data + b"\xff" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(padded)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth(), r.getframerate()) != (1, 1, RATE):
            raise ValueError("not 8-bit mono at the expected rate")
        return r.readframes(r.getnframes())


@lru_cache(1)
def _phases() -> np.ndarray:
    """(UP, taps): low-pass filter at the lower of the two rates, cut into phases."""
    n = UP * _TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) / DOWN * UP * np.hamming(n)
    return h.reshape(_TAPS, UP).T[:, ::-1].astype(np.float32).copy()


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase: output n lies at input n * DOWN / UP; only wanted outputs are computed."""
    size = -(-len(x) * UP // DOWN)
    padded = np.pad(x, (_TAPS - 1, _TAPS))
    out = np.empty(size, np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(padded, _TAPS)
    for first in range(UP):  # outputs first, first + UP, ... share a phase and step by DOWN inputs
        phase, at = first * DOWN % UP, first * DOWN // UP
        rows = windows[at::DOWN][: len(range(first, size, UP))]
        for a in range(0, len(rows), 1 << 16):
            out[first::UP][a : a + (1 << 16)] = rows[a : a + (1 << 16)] @ _phases()[phase]
    return out


@lru_cache(1)
def _mel() -> np.ndarray:
    """(bins, MELS): triangles even on the mel scale."""
    top = 2595 * np.log10(1 + RATE * UP / DOWN / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, DOWN / (RATE * UP))
    up = (bins[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2])
    down = (hz[2:] - bins[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log energies and each frame's log power; the last frame is padded."""
    n = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    y = np.pad(y, (0, (n - 1) * HOP + FRAME - len(y)))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    shape, mel = np.hanning(FRAME).astype(np.float32), np.empty((n, MELS), np.float32)
    power = np.empty(n, np.float32)
    for a in range(0, n, _STRETCH):
        part = frames[a : a + _STRETCH]
        spectrum = np.abs(np.fft.rfft(part * shape, axis=1)).astype(np.float32) ** 2
        mel[a : a + _STRETCH] = np.log(spectrum @ _mel() + np.float32(1e-6))
        power[a : a + _STRETCH] = np.log((part * part).mean(1) + np.float32(1e-6))
    return np.round(mel, 3), power


def segments(power: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames: from one at ``high`` or more, until one is under ``low``."""
    low = float(power.mean())
    high = low + 0.5 * float(power.std())
    mark = np.where(power >= high, 1, np.where(power < low, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[last] > 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_STEP_S = HOP * DOWN / (RATE * UP)


def tensor_stream(mel: np.ndarray) -> tuple[bytes, int]:
    """Arrow stream of (start_s, end_s, log_mel tensor of PATCH x MELS); the last one is padded with its floor."""
    n = -(-len(mel) // PATCH)
    floor = np.float32(np.log(1e-6))
    patches = np.pad(mel, ((0, n * PATCH - len(mel)), (0, 0)), constant_values=floor).reshape(n, PATCH * MELS)
    tensor = pa.fixed_shape_tensor(pa.float32(), [PATCH, MELS])
    column = pa.ExtensionArray.from_storage(tensor, pa.FixedSizeListArray.from_arrays(pa.array(patches.ravel()), PATCH * MELS))
    start = np.arange(n) * PATCH * _STEP_S
    end = np.minimum(start + PATCH * _STEP_S, len(mel) * _STEP_S)
    batch = pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), column], ["start_s", "end_s", "log_mel"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue(), n


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _groups(b.column("doc_id"), b.column("text")):
                data = [t.encode("utf-8", "replace") for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(d) for d in data], pa.int64()), pa.array([to_wav(d) for d in data], pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return id_and_text(docs).mapInArrow(run, MEDIA)


def _groups(ids: pa.Array, values: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Slices of about ``limit`` bytes, one row at least."""
    at, size = 0, 0
    for i, v in enumerate(values):
        size += len(v.as_buffer())
        if size >= limit:
            yield ids[at : i + 1], values[at : i + 1]
            at, size = i + 1, 0
    if at < len(values):
        yield ids[at:], values[at:]


def audio_features(media: DataFrame) -> DataFrame:
    """Features of (doc_id, n_bytes, media) rows, with digests of the samples as read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loud = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        for b in batches:
            for rows, wavs in _groups(pa.array(range(b.num_rows)), b.column("media"), 1 << 20):
                out: list[list] = [[] for _ in range(6)]
                for wav in wavs.to_pylist():
                    samples = from_wav(wav)
                    mel, power = log_mel(resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128))
                    stream, n = tensor_stream(mel)
                    spans = [{"start_s": a * _STEP_S, "end_s": e * _STEP_S} for a, e in segments(power)]
                    for column, x in zip(out, (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), stream, n, spans)):
                        column.append(x)
                own = b.slice(rows[0].as_py(), len(rows))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int32(), loud)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("n_bytes"), wavs, *(pa.array(c, k) for c, k in zip(out, kinds))],
                    ["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "features", "tensors", "segments"],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
