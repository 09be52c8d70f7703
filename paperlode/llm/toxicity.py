"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting takes a bounded sample of labelled rows: MOST of each class, whole texts. All terms of the examples are terms of
the index: words, prefixes of longer words, and prefixes that are frequent in their text. A term weighs
(1 + log tf) * idf * relevance. Document frequencies are counted over all documents; a term's relevance is the likelihood
ratio statistic of its occurrence against the examples' labels, so that words of both classes hardly count, but none is
left out. The examples' unit vectors are postings: sparse ones for most terms, a row of all examples for the few terms
that one in OFTEN examples has, with the largest weight of each block of BLOCK examples. A text's sparse postings are
summed first; the blocks' largest weights bound what its frequent terms can add, and only blocks that can still hold one
of the nearest NEAREST get their full cosines, so the neighbours are exact.

The neighbours vote with their cosines. A logistic curve turns votes into calibrated scores; it is fitted on the examples'
votes, each cast by examples of the other INNER - 1 of INNER folds with relevances of those folds. The evidence names the
neighbours.

Defined results: a null or empty text, or one without terms of the examples, has no neighbours and gets the score of no
votes; a very long text is scored by all of its terms; without labelled rows of both classes, or in empty tables, every
score is the share of class 1; ties between neighbours go to the smaller place in the index, which follows id and text; a
repeated row is scored alike; a row labelled both ways counts as class 1; a null id isn't held out; further columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.llm import labelled
from paperlode.llm.common import mapped, per_text, slices
from paperlode.llm.licenses import TO_WORDS

FOLDS, FOLD = 5, 0
#: Bound of the fit: examples of each class.
MOST = 1000
PREFIX = 5  # bytes
#: A prefix is frequent in a text that has it so often, and once in so many words or more.
FREQUENT, PER = 2, 100
NEAREST, BLOCK = 15, 64
OFTEN = 16
INNER = 4
SHOWN = 3


def terms(text: bytes | None) -> Counter:
    """Words, the prefixes of longer words after a zero byte, and those that are frequent in the text once more after a
    one byte, with their counts."""
    out = Counter((text or b"").translate(TO_WORDS).split())
    prefixes: dict[bytes, int] = {}
    for w, n in out.items():
        if len(w) > PREFIX:
            prefix = w[:PREFIX]
            prefixes[prefix] = prefixes.get(prefix, 0) + n
    least = max(FREQUENT, out.total() / PER)
    # no word begins with a zero or a one byte, so nothing has to be added up
    dict.update(out, {b"\0" + t: n for t, n in prefixes.items()})
    dict.update(out, {b"\1" + t: n for t, n in prefixes.items() if n >= least})
    return out


def spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers of many spans, one after another, and the span that each is from."""
    n = stop - start
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - (np.cumsum(n) - n - start)[which], which


class Examples:
    """Rows of term numbers and counts: of row i the places starts[i] to starts[i + 1]."""

    def __init__(self, texts: list[bytes]):
        self.vocabulary: dict[bytes, int] = {}
        term, count, starts = [], [], [0]
        for text in texts:
            own = terms(text)
            term.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in own], np.int64))
            count.append(np.array([*own.values()], np.int64))
            starts.append(starts[-1] + len(own))
        self.starts = np.array(starts)
        self.term, self.count = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (term, count))
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.starts))

    def relevance(self, labels: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of each term: twice the log likelihood ratio of its occurrence in class 1 and 0, among the chosen rows."""
        own = rows[self.row]
        m = np.bincount(self.term[own], minlength=len(self.vocabulary)).astype(float)
        a = np.bincount(self.term[own], weights=labels[self.row[own]], minlength=len(self.vocabulary))
        share = labels[rows].mean()
        part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(e, 1e-9)), 0)
        return np.maximum(2 * (part(a, m * share) + part(m - a, m * (1 - share))), 0)


class Index:
    """The rows of `examples` that are chosen, as block-max postings of unit vectors."""

    def __init__(self, examples: Examples, labels: np.ndarray, rows: np.ndarray, idf: np.ndarray):
        self.vocabulary, self.places, self.labels = examples.vocabulary, np.flatnonzero(rows), labels[rows]
        self.weight = (idf * examples.relevance(labels, rows)).astype(np.float64)
        own = rows[examples.row]
        term, doc = examples.term[own], (np.cumsum(rows) - 1)[examples.row[own]]
        raw = (1 + np.log(examples.count[own])) * self.weight[term]
        norm = np.sqrt(np.bincount(doc, weights=raw * raw, minlength=len(self.places)))
        value = raw / np.where(norm > 0, norm, 1)[doc]
        often = np.bincount(term, minlength=len(self.vocabulary)) * OFTEN >= len(self.places)
        blocks = -(-len(self.places) // BLOCK)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        dense = np.zeros((int(often.sum()), blocks * BLOCK), np.float32)
        dense[self.row[term[often[term]]], doc[often[term]]] = value[often[term]]
        self.dense = dense.reshape(-1, blocks, BLOCK)
        self.highest = self.dense.max(axis=2)
        order = np.lexsort((doc, term))
        order = order[~often[term[order]]]
        self.doc, self.posted, self.lists = doc[order], value[order], np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        self.slope, self.bias = 1.0, 0.0

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, in order, and weights of unit length."""
        at = np.array([*map(self.vocabulary.get, counts, itertools.repeat(-1))], np.int64)
        n = np.array([*counts.values()], np.int64)
        order = np.argsort(at)
        order = order[np.searchsorted(at[order], 0) :]
        at = at[order]
        raw = (1 + np.log(n[order])) * self.weight[at]
        some = raw > 0
        norm = np.sqrt((raw * raw).sum())
        return at[some], raw[some] / (norm or 1)

    def nearest(self, at: np.ndarray, q: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples with a cosine above 0, the nearest first."""
        blocks, row = self.dense.shape[1], self.row[at]
        place, which = spans(self.lists[at], self.lists[at + 1])
        scores = np.bincount(self.doc[place], weights=self.posted[place] * q[which], minlength=blocks * BLOCK).reshape(blocks, BLOCK)
        chosen = np.arange(blocks)
        if (row >= 0).any():
            row, q = row[row >= 0], q[row >= 0].astype(np.float32)
            kth = np.partition(scores.reshape(-1), -k)[-k] if scores.size > k else 0.0
            # a margin for the rounding of sums in another order
            chosen = np.flatnonzero(scores.max(axis=1) + 1.0001 * (q @ self.highest[row]) + 1e-5 >= kth)
            some = self.dense[row] if len(chosen) == blocks else self.dense[row[:, None], chosen]
            scores = scores[chosen] + (q @ some.reshape(len(row), -1)).reshape(-1, BLOCK)
        scores = np.round(scores.reshape(-1), 6)
        rows = (chosen[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
        if len(rows) > k:
            near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
            rows, scores = rows[near], scores[near]
        best = np.lexsort((rows, -scores))[:k]
        best = best[scores[best] > 0]
        return rows[best], scores[best]

    def vote(self, rows: np.ndarray, scores: np.ndarray) -> float:
        """The mean of 1 or -1 by the neighbours' labels, weighted by cosine; half a neighbour of cosine 1 votes 0."""
        return float(((2.0 * self.labels[rows] - 1) * scores).sum() / (scores.sum() + 0.5))

    def scored(self, text: bytes | None, ids: list) -> tuple[float, str]:
        rows, scores = self.nearest(*self.vector(terms(text)))
        p = 1 / (1 + np.exp(-np.clip(self.slope * self.vote(rows, scores) + self.bias, -30, 30)))
        shown = ",".join(f"{ids[self.places[i]]}:{self.labels[i]}:{s:.3f}" for i, s in zip(rows[:SHOWN].tolist(), scores.tolist(), strict=False))
        return round(float(p), 6), shown


def logistic(votes: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and bias of the curve that fits best; the classes weigh as they do among all labelled rows."""
    y = labels.astype(float)
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    x, theta = np.stack([votes, np.ones(len(y))], axis=1), np.array([1.0, np.log(share / (1 - share))])
    for _ in range(50):  # Newton's steps with a weak pull to 0
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 1e-2 * theta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(theta[0]), float(theta[1])


def fitted(texts: list[bytes], labels: np.ndarray, frequencies, share: float) -> Index:
    """The index over all examples, calibrated. frequencies(vocabulary): (documents with each term, documents)."""
    examples = Examples(texts)
    found, n = frequencies(examples.vocabulary)
    idf = np.log((1 + n) / (1 + found)) + 1
    votes, fold = np.zeros(len(labels)), np.arange(len(labels)) % INNER
    for f in range(INNER):
        others = fold != f
        if 0 < labels[others].sum() < others.sum():
            index = Index(examples, labels, others, idf)
            for i in np.flatnonzero(~others).tolist():
                votes[i] = index.vote(*index.nearest(*index.vector(terms(texts[i]))))
    index = Index(examples, labels, np.ones(len(labels), bool), idf)
    index.slope, index.bias = logistic(votes, labels, min(max(share, 1e-6), 1 - 1e-6))
    return index


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """How many of all documents have each term, and how many documents there are."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, get = np.zeros(len(held.value), np.int64), 0, held.value.get
        for batch in slices(batches, 0):
            found: list[int] = []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found += map(get, terms(text), itertools.repeat(-1))
            n += batch.num_rows
            found = np.array(found, np.int64)
            counts += np.bincount(found[found >= 0], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at])), pa.array(np.concatenate([[n], counts[at]]))], names=["at", "n"])

    rows = mapped(docs.select(F.col("text").cast("string")), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows["at"].to_numpy(), rows["n"].to_numpy()
    out = np.zeros(len(vocabulary))
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence): evidence lists the nearest as id:label:cosine."""
    examples, share = labelled.sample(docs, labels, "toxic", FOLDS, FOLD, MOST)
    rows = sorted(examples.collect(), key=lambda r: (str(r.doc_id), r.text or ""))
    y = np.array([r.y for r in rows], np.int64)
    index = fitted([(r.text or "").encode() for r in rows], y, lambda v: document_frequencies(docs, v), share) if 0 < y.sum() < len(y) else None
    held = docs.sparkSession.sparkContext.broadcast((index, [r.doc_id for r in rows]))

    def row(text: bytes | None) -> tuple[float, str]:
        own, ids = held.value
        return own.scored(text, ids) if own else (share, "")

    out = per_text(docs, "doc_id", "text", row, [pa.field("score", pa.float64()), pa.field("evidence", pa.string())])
    return out.select("doc_id", labelled.in_fold(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")
