"""Bytes as audio: lossless 8-bit WAV clips with log-mel features (operator 5).

A payload becomes the samples of an 8-bit PCM WAV clip at ``RATE`` Hz.  From the
stored clip the features are computed: polyphase resampling to 2/3 of the rate,
overlapped log-mel frames cut into patches of one fixed shape, each with its
time span, and segments of sound found by hysteresis on the frame energy.

* null or empty bytes: the payload is one unit of padding
* repeated rows and repeated or null ids: one output row for each input row
* equal bytes give equal clips and equal features; each clip is computed alone, and
  a task holds one clip with some forty bytes for each of its own, whatever else is in
  the batch; a very long text is a clip of its length
* an empty table: no rows; other columns are not read, whatever their names

Patches are stored as the bytes of an Arrow stream, whose ``mel`` column is an array of
fixed-shape tensors and whose other columns are the patches' time spans
(``write_patches``, ``read_patches``).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 192
RATE = 12_000
UP, DOWN = 2, 3
LOW_RATE = RATE * UP // DOWN
FRAME, HOP, MELS = 256, 160, 24
PATCH_FRAMES = 64
FRAMES_AT_ONCE = 8192
ON_DB, OFF_DB, MIN_FRAMES = 3.0, 0.0, 3
#: The header of a WAV file with one chunk of samples.
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wav(payload: bytes) -> bytes:
    return HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(clip: bytes) -> np.ndarray:
    """The sample bytes of a stored clip."""
    riff, _, kind, _, _, coding, channels, _, _, _, bits, _, size = HEADER.unpack_from(clip)
    if (riff, kind, coding, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8) or len(clip) != HEADER.size + size:
        raise ValueError("not an 8-bit mono PCM clip")
    return np.frombuffer(clip, np.uint8, size, HEADER.size)


def _phases(taps_each: int = 8) -> np.ndarray:
    """Taps of a windowed-sinc low-pass at the lower Nyquist frequency, one row for each of the UP phases."""
    n = taps_each * DOWN * UP + 1
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) * np.hamming(n)
    h *= UP / h.sum()
    width = -(-n // UP)
    return np.stack([np.pad(h[p::UP], (0, width - len(h[p::UP]))) for p in range(UP)]).astype(np.float32)


PHASES = _phases()


def resample(x: np.ndarray) -> np.ndarray:
    """``x`` at UP/DOWN of its rate: sample m takes phase (m*DOWN) % UP from input (m*DOWN) // UP on back."""
    width = PHASES.shape[1]
    m = len(x) * UP // DOWN
    padded = np.concatenate([np.zeros(width // 2, np.float32), x, np.zeros(width, np.float32)])
    out = np.empty(m, np.float32)
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)
    for first in range(UP):
        at = np.arange(first, m, UP) * DOWN
        out[first::UP] = rows[(at // UP)[0] :: DOWN][: len(at)] @ PHASES[(first * DOWN) % UP, ::-1] if len(at) else 0
    return out


def _filterbank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(LOW_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / LOW_RATE)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


BANK, WINDOW = _filterbank(), np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Log-mel rows of overlapping frames, the last one padded with silence; one frame at least."""
    n = max(1, 1 + -(-max(0, len(x) - FRAME) // HOP))
    x = np.pad(x, (0, (n - 1) * HOP + FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((n, MELS), np.float32)
    for i in range(0, n, FRAMES_AT_ONCE):
        power = np.abs(np.fft.rfft(frames[i : i + FRAMES_AT_ONCE] * WINDOW, axis=1)).astype(np.float32) ** 2
        out[i : i + FRAMES_AT_ONCE] = np.log(power @ BANK + np.float32(1e-6))
    return out


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that rise ON_DB above the clip's median energy and last until they fall to OFF_DB above it."""
    db = 10 / np.log(10) * np.log(np.exp(mel).mean(axis=1))
    level = db - np.median(db)
    state = np.where(level >= ON_DB, 1, np.where(level < OFF_DB, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(known >= 0, state[np.maximum(known, 0)], 0) == 1
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if b - a >= MIN_FRAMES]


TENSOR = pa.fixed_shape_tensor(pa.float32(), (PATCH_FRAMES, MELS), dim_names=("frame", "mel"))
PATCHES = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("mel", TENSOR)])
_SPAN = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
_OUT = "n_bytes long, media binary, n_frames int, patches binary, segments array<struct<start_s:double,end_s:double>>"


def write_patches(mel: np.ndarray) -> bytes:
    """``mel`` cut to tensors of (PATCH_FRAMES, MELS), the last one padded with zeros, each with the seconds it covers, as an Arrow stream."""
    first = np.arange(0, len(mel), PATCH_FRAMES)
    full = np.zeros((len(first) * PATCH_FRAMES, MELS), np.float32)
    full[: len(mel)] = mel
    last = np.minimum(first + PATCH_FRAMES, len(mel)) - 1
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), PATCH_FRAMES * MELS)
    batch = pa.RecordBatch.from_arrays([pa.array(first * HOP / LOW_RATE), pa.array((last * HOP + FRAME) / LOW_RATE), pa.ExtensionArray.from_storage(TENSOR, storage)], schema=PATCHES)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PATCHES) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_patches(stored: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in seconds, and the tensors (patches, PATCH_FRAMES, MELS)."""
    with pa.ipc.open_stream(stored) as stream:
        rows = stream.read_all()
    mel = rows.column("mel").combine_chunks()
    if mel.type != TENSOR:
        raise ValueError(f"not patches of {TENSOR}")
    return rows.column("start_s").to_numpy(), rows.column("end_s").to_numpy(), mel.to_numpy_ndarray()


def patch_features(clips: DataFrame, rows_at_once: int = 64) -> DataFrame:
    """``clips`` with ``n_patches`` and ``band_means`` in place of ``patches``, from the stored tensors: the mean of each band over the clip's frames."""
    kept = [c for c in clips.columns if c != "patches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(i, rows_at_once)
                count, means = [], []
                for stored, n in zip(part.column("patches"), part.column("n_frames").to_pylist(), strict=True):
                    _, _, mel = read_patches(stored.as_buffer())
                    count.append(len(mel))
                    means.append(mel.reshape(-1, MELS)[:n].mean(axis=0, dtype=np.float64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(count, pa.int32()), pa.array(means, pa.list_(pa.float64()))], [*kept, "n_patches", "band_means"])

    own = ", ".join(f"`{c}` {clips.schema[c].dataType.simpleString()}" for c in kept)
    return clips.mapInArrow(run, f"{own}, n_patches int, band_means array<double>")


def as_audio(rows: DataFrame, bytes_col: Column, id_col: str = "doc_id", rows_at_once: int = 64) -> DataFrame:
    """Clips and features of the bytes in ``bytes_col``: id, n_bytes, media, n_frames, patches, segments."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(i, rows_at_once)
                cols: tuple[list, ...] = ([], [], [], [], [])
                for b in part.column(1):
                    raw = (b.as_buffer().to_pybytes() if b.is_valid else b"") or b""
                    clip = wav(raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT)))
                    mel = log_mel(resample((samples(clip).astype(np.float32) - 128) / 128))
                    spans = [{"start_s": a * HOP / LOW_RATE, "end_s": ((b - 1) * HOP + FRAME) / LOW_RATE} for a, b in segments(mel)]
                    for col, value in zip(cols, (len(raw), clip, len(mel), write_patches(mel), spans), strict=True):
                        col.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.list_(_SPAN))],
                    ["id", "n_bytes", "media", "n_frames", "patches", "segments"],
                )

    return rows.select(rows[id_col].alias("id"), bytes_col.alias("raw")).mapInArrow(run, f"id {id_type}, {_OUT}").withColumnRenamed("id", id_col)


def stored_payload(media: Column) -> Column:
    """The sample bytes of a stored clip, in SQL."""
    return F.substr(media, F.lit(HEADER.size + 1), F.length(media) - HEADER.size)
