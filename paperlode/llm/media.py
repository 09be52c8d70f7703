"""Media columns: audio features as fixed-shape tensors with time spans.

A payload of bytes is stored losslessly as unsigned 8-bit samples (a WAV container), read back, resampled by a polyphase
filter, turned into overlapped log-mel frames and cut into segments by hysteresis on the frames' energy. Windows of
frames are fixed-shape tensors with time spans: windows() has a row for each, its values' shape in the column's metadata,
and as_tensors() gives them Arrow's fixed_shape_tensor type. A payload's feature is computed from its stored tensors, read
back from Arrow's stream format.

Each payload is handled alone, in blocks of a fixed size, so equal payloads have equal values and memory grows with a
payload by a few bytes for each of its bytes.

Defined results: a null or empty text is one block of 64 zero bytes; a very long text is one payload like any other, in
one task; there are no ties; rows are independent, so repeated rows and ids,
and null ids, give a row each; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.llm.common import mapped, per_text, sha256, slices, spark_schema

UNIT = 64
RATE, UP, DOWN = 16_000, 3, 4
HALF_TAPS = 8  # of each phase, on either side
FRAME, HOP, MELS = 256, 128, 32
WINDOW = 32  # frames in a tensor
FLOOR_DB = -100.0
#: A segment is a run of frames of energies above OFF_DB, one of them or more above ON_DB: it is found by ON_DB, and reaches
#: back and forth to OFF_DB. Runs of less than MIN_FRAMES frames are dropped.
ON_DB, OFF_DB, MIN_FRAMES = -18.0, -30.0, 2
BLOCK = 1 << 16
ROWS = 256  # tensors of a batch


def padded(text: bytes) -> bytes:
    """With zero bytes up to a positive multiple of UNIT."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def stored(payload: bytes) -> bytes:
    """A WAV file of one channel of unsigned 8-bit samples; a payload is a multiple of 64 bytes and needs no pad byte."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def read(media: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@functools.cache
def phases() -> np.ndarray:
    """The low-pass filter dealt into its phases: column r makes the outputs r, r + UP, ... from consecutive inputs."""
    n = np.arange(-HALF_TAPS * UP, HALF_TAPS * UP + 1)
    cutoff = 1 / max(UP, DOWN)
    h = cutoff * np.sinc(cutoff * n) * np.kaiser(len(n), 8.0) * UP
    taps = DOWN + 2 * HALF_TAPS + 1
    out = np.zeros((taps, UP), np.float32)
    for r in range(UP):
        for i in range(taps):  # input i - HALF_TAPS against output r, both in units of 1 / (UP * rate)
            k = (i - HALF_TAPS) * UP - r * DOWN
            if abs(k) <= HALF_TAPS * UP:
                out[i, r] = h[k + HALF_TAPS * UP]
    return out


def resampled(x: np.ndarray) -> np.ndarray:
    """x at UP / DOWN times its rate; groups of DOWN inputs make UP outputs."""
    h, groups = phases(), -(-len(x) // DOWN)
    out = np.empty((groups, UP), np.float32)
    for start in range(0, groups, BLOCK):
        stop = min(groups, start + BLOCK)
        lo, hi = start * DOWN - HALF_TAPS, (stop - 1) * DOWN - HALF_TAPS + len(h)
        part = np.zeros(hi - lo, np.float32)
        a, b = max(lo, 0), min(hi, len(x))
        part[a - lo : b - lo] = x[a:b]
        out[start:stop] = as_strided(part, (stop - start, len(h)), (DOWN * 4, 4), writeable=False) @ h
    return out.reshape(-1)


@functools.cache
def filterbank() -> np.ndarray:
    """Overlapped triangles on the mel scale, (FRAME / 2 + 1, MELS)."""
    rate = RATE * UP / DOWN
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1)[:, None] * rate / FRAME
    rise, fall = (f - hz[:-2]) / (hz[1:-1] - hz[:-2]), (hz[2:] - f) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def frames(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel values (frames, MELS) and energies in dB; the last frame is filled with zeros."""
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y), np.float32)]) if (n - 1) * HOP + FRAME > len(y) else np.ascontiguousarray(y)
    hann = np.hanning(FRAME).astype(np.float32)
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for start in range(0, n, 4096):
        stop = min(n, start + 4096)
        part = as_strided(y[start * HOP :], (stop - start, FRAME), (HOP * 4, 4), writeable=False)
        spectrum = np.fft.rfft(part * hann)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) / FRAME
        mel[start:stop] = 10 * np.log10(np.maximum(power @ filterbank(), 1e-10))
        energy[start:stop] = 10 * np.log10(np.maximum(np.einsum("ij,ij->i", part, part) / FRAME, 1e-10))
    return np.maximum(mel, FLOOR_DB), energy


def segments(energy: np.ndarray) -> list[tuple[float, float]]:
    """Time spans in seconds: the runs above OFF_DB that somewhere exceed ON_DB."""
    low = energy > OFF_DB
    edges = np.flatnonzero(np.diff(np.concatenate([[False], low, [False]]).astype(np.int8)))
    above = np.concatenate([[0], np.cumsum(energy > ON_DB)])
    step = HOP * DOWN / UP / RATE
    return [(float(a * step), float(b * step)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= MIN_FRAMES and above[b] > above[a]]


TENSOR = pa.fixed_shape_tensor(pa.float32(), (WINDOW, MELS), dim_names=["frame", "mel"])


def tensors(mel: np.ndarray) -> bytes:
    """Windows of WINDOW frames with their time spans, as an Arrow stream; the last window is filled with FLOOR_DB."""
    n, step = -(-len(mel) // WINDOW), HOP * DOWN / UP / RATE
    full = np.full((n * WINDOW, MELS), FLOOR_DB, np.float32)
    full[: len(mel)] = mel
    values = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), WINDOW * MELS)
    begin = np.arange(n) * WINDOW * step
    end = np.minimum(begin + WINDOW * step, len(mel) * step)
    batch = pa.RecordBatch.from_arrays([pa.array(begin), pa.array(end), pa.ExtensionArray.from_storage(TENSOR, values)], names=["t_start", "t_end", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t_start, t_end, values) of a stored stream: values has the shape (windows, WINDOW, MELS)."""
    table = pa.ipc.open_stream(stream).read_all().combine_chunks()
    return table["t_start"].to_numpy(), table["t_end"].to_numpy(), table["log_mel"].chunk(0).to_numpy_ndarray()


def described(stream: bytes, spans: list[tuple[float, float]]) -> str:
    """Windows, seconds, segments and voiced seconds, and the mean and deviation of the tensors' values in their spans."""
    begin, end, values = read_tensors(stream)
    step = HOP * DOWN / UP / RATE
    n = np.rint((end - begin) / step).astype(int)
    inside = values[np.arange(WINDOW) < n[:, None]].astype(np.float64)
    voiced = sum(b - a for a, b in spans)
    return f"windows={len(values)};frames={n.sum()};seconds={end[-1]:.3f};segments={len(spans)};voiced={voiced:.3f};mel={inside.mean():.2f}~{inside.std():.2f}"


def analysed(text: bytes | None, keep: bool) -> tuple:
    text = text or b""
    media = stored(padded(text))
    payload = read(media)
    samples = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = frames(resampled(samples))
    spans, windows = segments(energy), tensors(mel)
    feature = described(windows, spans)
    row = (len(text), len(payload), sha256(payload), zlib.crc32(payload[-UNIT:]), len(media), sha256(media), feature)
    return (*row, media, windows, [{"t_start": a, "t_end": b} for a, b in spans]) if keep else row


FIELDS = [pa.field(n, pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")]
KEPT = [pa.field("media", pa.binary()), pa.field("log_mel", pa.binary()), pa.field("segments", pa.list_(pa.struct([("t_start", pa.float64()), ("t_end", pa.float64())])))]


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """(id, sizes, digests, feature); with `keep` the stored media, the tensors' Arrow stream and the segments as well."""
    return per_text(df, id_col, text_col, lambda t: analysed(t, keep), FIELDS + KEPT * keep)


def windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, window, t_start, t_end, log_mel): a row for each tensor, log_mel being WINDOW * MELS floats in rows of MELS, as
    the column's metadata says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BLOCK):
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                begin, end, values = read_tensors(analysed(text, True)[-2])
                for a in range(0, len(values), ROWS):
                    n = len(values[a : a + ROWS])
                    flat = pa.array(values[a : a + ROWS].reshape(-1), pa.float32())
                    mel = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * WINDOW * MELS, pa.int32()), flat)
                    own = batch.column(0).take(pa.array([i] * n, pa.int64()))
                    yield pa.RecordBatch.from_arrays([own, pa.array(np.arange(a, a + n)), pa.array(begin[a : a + n]), pa.array(end[a : a + n]), mel], names=[id_col, "window", "t_start", "t_end", "log_mel"])

    schema = pa.schema([pa.field("x", pa.int64()), ("window", pa.int64()), ("t_start", pa.float64()), ("t_end", pa.float64()), ("log_mel", pa.list_(pa.float32()))])
    out = mapped(df.select(F.col(id_col), F.col(text_col).cast("string")), run, spark_schema(df, id_col, schema))
    return out.withMetadata("log_mel", {"shape": [WINDOW, MELS], "dim_names": ["frame", "mel"]})


def as_tensors(table: pa.Table) -> pa.Table:
    """windows() as an Arrow table whose log_mel has the type fixed_shape_tensor."""
    at = table.schema.get_field_index("log_mel")
    flat = table["log_mel"].combine_chunks()
    values = pa.FixedSizeListArray.from_arrays((flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten(), WINDOW * MELS)
    return table.set_column(at, pa.field("log_mel", TENSOR), pa.ExtensionArray.from_storage(TENSOR, values))
