"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. Each byte is an embedding plus two channels that
tell whether the last GRAM bytes stood shortly before; learned filters slide over a chunk, and each filter's largest
response is its value for the chunk. The means and the maxima over a document's chunks make one probability.

Fitting takes a bounded sample: MOST labelled rows of each class, and of these rows every chunk. Equal chunks of a text
pass through the network once and count as often as they stand there, and so does a row that a batch draws repeatedly.
Long texts pass in slices, so that memory doesn't follow a text's length. Scoring takes every chunk too.

Defined results: a null or empty text is one chunk of zero bytes; a very long text is scored by all of its chunks; there
are no ties: in fitting, the first of equal responses and of equal chunks counts; without labelled rows of both classes,
or in empty tables, every score is the share of class 1; a row labelled both ways counts as class 1; a repeated row is
scored alike; a null id isn't held out; further columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.llm import labelled
from paperlode.llm.common import per_text

FOLDS, FOLD = 3, 1
#: Bound of the fit, in rows of each class; its length.
MOST, STEPS, BATCH = 2000, 500, 48
#: Chunks that pass through the network at once.
SLICE = 512
CHUNK, STRIDE = 256, 192  # bytes; chunks overlap by 64
WIDTH, HOP, FILTERS, DIMS = 8, 4, 24, 6
POSITIONS = (CHUNK - WIDTH) // HOP + 1
GRAM, LAGS = 4, ((2, 9), (9, 33))  # a gram is compared as one 32-bit integer
CHANNELS = DIMS + len(LAGS)


def chunked(text: bytes | None) -> np.ndarray:
    """(chunks, CHUNK): overlapping, and filled with zero bytes at the end."""
    text = text or b""
    n = 1 + max(0, -(-(len(text) - CHUNK) // STRIDE))
    data = np.frombuffer(text.ljust((n - 1) * STRIDE + CHUNK, b"\0"), np.uint8)
    return np.ascontiguousarray(as_strided(data, (n, CHUNK), (STRIDE, 1), writeable=False))


def repeats(chunks: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK, len(LAGS)): 1 where the last GRAM bytes equal those some bytes before; zero bytes don't count."""
    n, out, there = len(chunks), np.zeros((*chunks.shape, len(LAGS)), np.float32), chunks != 0
    grams = np.ndarray((n, CHUNK - GRAM + 1), np.uint32, np.ascontiguousarray(chunks), strides=(CHUNK, 1)).copy()
    whole = functools.reduce(np.logical_and, (there[:, k : CHUNK - GRAM + 1 + k] for k in range(GRAM)))
    for k, (first, last) in enumerate(LAGS):
        found = np.zeros(grams.shape, bool)
        for lag in range(first, last):
            found[:, lag:] |= grams[:, lag:] == grams[:, :-lag]
        out[:, GRAM - 1 :, k] = found & whole
    return out


def coded(chunks: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK): a byte and its repeats as one row of Model.table()."""
    out = chunks.astype(np.int32)
    for k in range(len(LAGS)):
        out += extra[:, :, k].astype(np.int32) << (8 + k)
    return out


@dataclass
class Model:
    embedding: np.ndarray  # 256, DIMS
    filters: np.ndarray  # WIDTH * CHANNELS, FILTERS
    bias: np.ndarray
    mean: np.ndarray  # the weights of the means over chunks
    top: np.ndarray  # and of the maxima
    offset: np.ndarray

    def table(self) -> np.ndarray:
        """(256 * 2 ** len(LAGS), CHANNELS): the channels of each byte with each combination of repeats."""
        bits = np.indices((2,) * len(LAGS))[::-1].reshape(len(LAGS), -1).T
        return np.concatenate([np.tile(self.embedding, (len(bits), 1)), np.repeat(bits, 256, axis=0).astype(self.embedding.dtype)], axis=1)

    def patches(self, chunks: np.ndarray, extra: np.ndarray) -> np.ndarray:
        x = self.table().take(coded(chunks, extra), axis=0)
        step = x.itemsize * CHANNELS
        return np.ascontiguousarray(as_strided(x, (len(chunks), POSITIONS, WIDTH * CHANNELS), (CHUNK * step, HOP * step, x.itemsize), writeable=False))

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS): each filter's largest response in a chunk, at least 0."""
        response = self.patches(chunks, repeats(chunks)).reshape(-1, WIDTH * CHANNELS) @ self.filters
        return np.maximum(response.reshape(len(chunks), POSITIONS, FILTERS).max(axis=1) + self.bias, 0)

    def probability(self, text: bytes | None) -> float:
        chunks, total, top = chunked(text), np.zeros(FILTERS), np.zeros(FILTERS, np.float32)
        for start in range(0, len(chunks), SLICE):
            values = self.pooled(chunks[start : start + SLICE])
            total += values.sum(axis=0, dtype=np.float64)
            top = np.maximum(top, values.max(axis=0))
        z = float(self.mean @ (total / len(chunks)) + self.top @ top + self.offset[0])
        return round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 6)


NAMES = ("embedding", "filters", "bias", "mean", "top", "offset")


def distinct(chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's different chunks, in order of first place, and how often each stands there."""
    places: dict[bytes, int] = {}
    at = np.array([places.setdefault(c.tobytes(), len(places)) for c in chunks])
    first = np.unique(at, return_index=True)[1]
    return chunks[first], np.bincount(at)


def gradient(model: Model, texts: list[np.ndarray], seen: list[np.ndarray], labels: np.ndarray, times: list[np.ndarray] | None = None, drawn: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """The mean logistic loss over texts (each as its chunks, with their repeats), and its gradient.

    `times` says how often each chunk stands in its text, `drawn` how often each text counts; once by default.
    """
    n, per = np.array([len(c) for c in texts]), SLICE
    doc, starts = np.repeat(np.arange(len(texts)), n), np.cumsum(n) - n
    times = np.ones(len(doc)) if times is None else np.concatenate(times)
    drawn = np.ones(len(texts)) if drawn is None else drawn
    share = (times / np.add.reduceat(times, starts)[doc])[:, None].astype(np.float32)  # of its text's chunks
    chunks, extra = np.concatenate(texts), np.concatenate(seen)
    value, at = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64)
    for i in range(0, len(chunks), per):
        part = chunks[i : i + per]
        response = (model.filters.T @ model.patches(part, extra[i : i + per]).reshape(-1, WIDTH * CHANNELS).T).reshape(FILTERS, len(part), POSITIONS)
        best = response.argmax(axis=2)
        at[i : i + per] = best.T
        value[i : i + per] = np.maximum(np.take_along_axis(response, best[:, :, None], 2)[:, :, 0].T + model.bias, 0)
    mean, top = np.add.reduceat(value * share, starts), np.maximum.reduceat(value, starts)
    z = mean @ model.mean + top @ model.top + model.offset
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    d = (drawn * (p - labels) / drawn.sum()).astype(np.float32)
    first = np.zeros_like(value)  # 1 where a chunk has its document's maximum
    for start, size in zip(starts.tolist(), n.tolist(), strict=True):
        first[start + value[start : start + size].argmax(axis=0), np.arange(FILTERS)] = 1
    back = (d[doc, None] * (model.mean * share + first * model.top)) * (value > 0)
    out = {"offset": d.sum(keepdims=True), "mean": d @ mean, "top": d @ top, "bias": back.sum(axis=0), "filters": np.zeros_like(model.filters), "embedding": np.zeros_like(model.embedding)}
    for i in range(0, len(chunks), per):
        part, own = chunks[i : i + per], back[i : i + per]
        bytes_of = at[i : i + per, :, None] * HOP + np.arange(WIDTH)  # chunks, FILTERS, WIDTH
        codes = np.take_along_axis(coded(part, extra[i : i + per]), bytes_of.reshape(len(part), -1), axis=1)
        best, bytes_at = model.table().take(codes, axis=0).reshape(len(part), FILTERS, -1), codes & 255
        out["filters"] += np.matmul(own.T[:, None, :], best.transpose(1, 0, 2))[:, 0].T
        into = (own[:, :, None] * model.filters.T[None]).reshape(len(part), FILTERS, WIDTH, CHANNELS)
        for c in range(DIMS):
            out["embedding"][:, c] += np.bincount(bytes_at.reshape(-1), weights=into[..., c].reshape(-1), minlength=256)
    return float((drawn * (np.logaddexp(0, z) - labels * z)).sum() / drawn.sum()), out


def start(rng: np.random.Generator) -> Model:
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Model(normal(256, DIMS, scale=0.5), normal(WIDTH * CHANNELS, FILTERS, scale=0.15), np.zeros(FILTERS, np.float32), normal(FILTERS, scale=0.1), normal(FILTERS, scale=0.1), np.zeros(1, np.float32))


def fit(texts: list[bytes], labels: np.ndarray, share: float, seed: int = 7) -> Model:
    """Adam on the logistic loss; batches have as many rows of either class, and the offset is set for `share` at last."""
    rng, (chunks, times) = np.random.default_rng(seed), zip(*(distinct(chunked(t)) for t in texts), strict=True)
    seen = [repeats(c).astype(np.uint8) for c in chunks]
    model, of_class = start(rng), [np.flatnonzero(labels == y) for y in (0, 1)]
    moments = {n: (np.zeros_like(getattr(model, n)), np.zeros_like(getattr(model, n))) for n in NAMES}
    for step in range(1, STEPS + 1):
        rows, drawn = np.unique(np.concatenate([rng.choice(c, BATCH // 2) for c in of_class]), return_counts=True)
        _, slope = gradient(model, [chunks[i] for i in rows], [seen[i] for i in rows], labels[rows], [times[i] for i in rows], drawn)
        for name in NAMES:
            m, v = moments[name]
            g = slope[name].astype(np.float32) + 1e-5 * getattr(model, name)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            setattr(model, name, getattr(model, name) - 0.01 * min(1, 2 - 2 * step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7))
    model.offset = (model.offset + np.log(share / (1 - share))).astype(np.float32)
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    examples, share = labelled.sample(docs, labels, "quality", FOLDS, FOLD, MOST)
    rows = sorted(examples.collect(), key=lambda r: (str(r.doc_id), r.text or ""))
    texts, y = [(r.text or "").encode() for r in rows], np.array([r.y for r in rows], np.int64)
    model = fit(texts, y, min(max(share, 1e-6), 1 - 1e-6)) if 0 < y.sum() < len(y) else None
    out = per_text(docs, "doc_id", "text", lambda t: (model.probability(t) if model else share,), [pa.field("score", pa.float64())])
    return out.select("doc_id", labelled.in_fold(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
