import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest

import cases
from paperlode.llm import entries, media


def test_container_is_read_by_another_reader():
    payload = media.padded("Grüße".encode())
    with wave.open(io.BytesIO(media.stored(payload))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
    assert media.read(media.stored(payload)) == payload


def test_padding():
    assert [len(media.padded(b"x" * n)) for n in (0, 1, 63, 64, 65)] == [64, 64, 64, 64, 128]


def test_polyphase_equals_insert_filter_drop():
    x = np.random.default_rng(1).standard_normal(1000).astype(np.float32)
    n = np.arange(-media.HALF_TAPS * media.UP, media.HALF_TAPS * media.UP + 1)
    h = np.sinc(n / max(media.UP, media.DOWN)) / max(media.UP, media.DOWN) * np.kaiser(len(n), 8.0) * media.UP
    up = np.zeros(len(x) * media.UP)
    up[:: media.UP] = x
    direct = np.convolve(up, h)[len(n) // 2 :][: len(up) : media.DOWN]
    own = media.resampled(x)
    assert np.allclose(own[: len(direct)], direct, atol=1e-4)


def test_blocks_make_no_difference(monkeypatch):
    x = np.random.default_rng(2).standard_normal(5000).astype(np.float32)
    whole = media.resampled(x)
    monkeypatch.setattr(media, "BLOCK", 17)
    assert np.allclose(media.resampled(x), whole, atol=1e-5)


def test_frames_and_segments():
    t = np.arange(12_000 * 2) / 12_000
    y = np.where((t > 0.5) & (t < 1.2), np.sin(2 * np.pi * 440 * t), 0).astype(np.float32)
    mel, energy = media.frames(y)
    assert mel.shape == (len(energy), media.MELS)
    ((a, b),) = media.segments(energy)
    assert abs(a - 0.5) < 0.03 and abs(b - 1.2) < 0.03
    bank, loud = media.filterbank(), mel[len(mel) * 85 // 200]
    centre = bank[round(440 / 12_000 * media.FRAME)].argmax()
    assert abs(int(loud.argmax()) - int(centre)) <= 1


def test_hysteresis_by_loop():
    rng = np.random.default_rng(3)
    for _ in range(50):
        energy = rng.uniform(-50, 0, 40)
        expected, start, on = [], None, False
        for i, e in enumerate([*energy, -999.0]):
            if e > media.OFF_DB:
                start, on = (i if start is None else start), on or e > media.ON_DB
            else:
                if start is not None and on and i - start >= media.MIN_FRAMES:
                    expected.append((start, i))
                start, on = None, False
        step = media.HOP * media.DOWN / media.UP / media.RATE
        assert np.allclose(media.segments(energy), np.array(expected).reshape(-1, 2) * step if expected else []) or not expected


def test_tensors(spark):
    row = media.features(cases.table(spark, [(1, "some text that is read " * 400)])).first()
    batch = pa.ipc.open_stream(bytes(row.log_mel)).read_all()
    kind = batch.schema.field("log_mel").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [media.WINDOW, media.MELS]
    values = batch.column("log_mel").combine_chunks().to_numpy_ndarray()
    assert values.shape == (batch.num_rows, media.WINDOW, media.MELS)
    begin, end = batch.column("t_start").to_pylist(), batch.column("t_end").to_pylist()
    assert begin == sorted(begin) and all(a < b for a, b in zip(begin, end, strict=True))
    assert media.read(bytes(row.media))[: row.n_bytes] == ("some text that is read " * 400).encode()


def digests(text):
    payload = (text or "").encode()
    payload += bytes(-len(payload) % 64 if payload else 64)
    return len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_odd_rows(spark):
    out = media.features(cases.odd(spark), keep=False).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == sorted((str(d), *digests(t)) for d, t in cases.ODD)
    assert len({r.feature for r in out if r.n_bytes == 0}) == 1
    assert media.features(cases.odd(spark).limit(0)).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in entries.op3_media_features(spark, "/root/testdata/sf0.001").collect():
        n, size, sha, crc = digests(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == (n, size, sha, crc, size + 44)
        assert r.media_sha256 == hashlib.sha256(media.stored(media.padded((texts[r.doc_id] or "").encode()))).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 500, 30_000])
def test_feature_by_brute_force(n):
    """From the log-mel values and energies, frame by frame, without the tensors."""
    text = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    payload = media.padded(text)
    mel, energy = media.frames(media.resampled((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128))
    step = media.HOP * media.DOWN / media.UP / media.RATE
    spans, i = [], 0
    while i < len(energy):
        j = i
        while j < len(energy) and energy[j] > media.OFF_DB:
            j += 1
        if j - i >= media.MIN_FRAMES and any(e > media.ON_DB for e in energy[i:j]):
            spans.append((j - i) * step)
        i = max(j, i + 1)
    flat = [float(x) for row in mel for x in row]
    mean = sum(flat) / len(flat)
    deviation = (sum((x - mean) ** 2 for x in flat) / len(flat)) ** 0.5
    expected = f"windows={-(-len(mel) // media.WINDOW)};frames={len(mel)};seconds={len(mel) * step:.3f};segments={len(spans)};voiced={sum(spans):.3f};mel={mean:.2f}~{deviation:.2f}"
    assert media.analysed(text, False)[-1] == expected


def test_windows_are_fixed_shape_tensors(spark):
    df = cases.odd(spark).filter("doc_id IS NULL OR doc_id <> 9")
    out = media.windows(df)
    assert out.schema["log_mel"].metadata["shape"] == [media.WINDOW, media.MELS] and media.windows(df.limit(0)).count() == 0
    table = media.as_tensors(out.filter("doc_id = 8").orderBy("window").toArrow())
    assert table.schema.field("log_mel").type == media.TENSOR
    begin, end, values = media.read_tensors(media.analysed(cases.LONG.encode(), True)[-2])
    own = table["log_mel"].combine_chunks()
    assert np.array_equal((own.chunk(0) if isinstance(own, pa.ChunkedArray) else own).to_numpy_ndarray(), values)
    assert np.array_equal(table["t_start"].to_numpy(), begin) and np.array_equal(table["t_end"].to_numpy(), end)
