"""Toxicity and quality: parts against brute force, and accuracy on held-out rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
from paperlode.llm import entries, labelled, quality_model, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.mark.parametrize(("folds", "fold"), [(5, 0), (3, 1)])
def test_folds(spark, folds, fold):
    df = spark.range(200).select(F.col("id").alias("doc_id"), labelled.in_fold(F.col("id"), folds, fold).alias("x"))
    assert all(r.x == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in df.collect())


def test_sample_is_bounded_and_skips_the_fold(tables):
    docs, labels = tables
    some, _ = labelled.sample(docs, labels, "toxic", 5, 0, 20)
    assert 0 < some.count() <= 40 and some.filter(labelled.in_fold(F.col("doc_id"), 5, 0)).isEmpty()


def made_texts(n, seed):
    rng = cases.seeded(seed)
    return [" ".join(f"word{int(rng.paretovariate(0.6)) % 3000}" for _ in range(rng.choice([0, 1, 5, 40]))).encode() for _ in range(n)]


def full_cosines(texts, labels, rows, idf, text):
    """Every cosine to the chosen rows, term by term."""
    counts, terms = [toxicity.terms(t) for t in texts], {}
    share = sum(labels[i] for i in rows) / len(rows)
    for i in rows:
        for t in counts[i]:
            terms.setdefault(t, [0, 0])[1 - labels[i]] += 1

    def weight(t):
        a, b = terms[t]
        out = sum(x * np.log(x / ((a + b) * e)) for x, e in ((a, share), (b, 1 - share)) if x)
        return idf[t] * max(2 * out, 0)

    def vector(c):
        raw = {t: (1 + np.log(n)) * weight(t) for t, n in c.items() if t in terms}
        norm = np.sqrt(sum(w * w for w in raw.values())) or 1
        return {t: w / norm for t, w in raw.items()}

    q = vector(toxicity.terms(text))
    return np.array([sum(w * q.get(t, 0) for t, w in vector(counts[i]).items()) for i in rows])


@pytest.mark.parametrize(("often", "block"), [(1, 64), (16, 4), (16, 64), (10**6, 8)])
def test_from_texts_to_scores_by_brute_force(monkeypatch, often, block):
    """Frequencies, relevances, cosines, votes, the curve and the scores, over all terms and all examples."""
    monkeypatch.setattr(toxicity, "OFTEN", often)
    monkeypatch.setattr(toxicity, "BLOCK", block)
    texts = made_texts(260, 7)
    labels = np.array([int(b"word1 " in t or i % 9 == 0) for i, t in enumerate(texts)])
    everywhere = texts * 2 + made_texts(100, 8)
    df = {}
    for t in everywhere:
        for x in toxicity.terms(t):
            df[x] = df.get(x, 0) + 1
    idf = {t: np.log((1 + len(everywhere)) / (1 + n)) + 1 for t, n in df.items()}
    index = toxicity.fitted(texts, labels, lambda v: (np.array([df.get(t, 0) for t in v]), len(everywhere)), 0.2)
    assert len(index.vocabulary) == len(set().union(*map(toxicity.terms, texts)))  # no term is left out

    def vote(rows, text):
        cosines = np.round(full_cosines(texts, labels, rows, idf, text), 6)
        best = sorted((-c, j) for j, c in enumerate(cosines) if c > 0)[: toxicity.NEAREST]
        total = sum(-c for c, _ in best)
        return sum(-c * (1 if labels[rows[j]] else -1) for c, j in best) / (total + 0.5), [-c for c, _ in best]

    votes = np.array([vote([j for j in range(260) if j % toxicity.INNER != i % toxicity.INNER], t)[0] for i, t in enumerate(texts)])
    w = np.where(labels == 1, 0.2 / labels.sum(), 0.8 / (260 - labels.sum())) * 260
    loss = lambda s, b: (w * (np.log1p(np.exp(s * votes + b)) - labels * (s * votes + b))).sum() + 5e-3 * (s * s + b * b)
    at = loss(index.slope, index.bias)
    assert all(at <= loss(index.slope + x, index.bias + y) + 1e-6 for x in (-0.02, 0, 0.02) for y in (-0.02, 0, 0.02))
    for text in [*texts[:60], *made_texts(60, 9), b"", None]:
        expected, cosines = vote(range(260), text)
        rows, scores = index.nearest(*index.vector(toxicity.terms(text)))
        assert np.allclose(scores, cosines, atol=2e-5)
        p, evidence = index.scored(text, [*range(260)])
        assert abs(p - 1 / (1 + np.exp(-(index.slope * expected + index.bias)))) < 2e-3
        assert evidence.count(":") == 2 * min(toxicity.SHOWN, len(rows))


def test_labels_that_contradict(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (None, 1), (3, 7), (6, 0)], "doc_id long, toxic int")
    some, share = labelled.sample(docs, labels, "toxic", 5, 99, 10)
    assert cases.rows_of(some, "doc_id", "text", "y") == [(1, "a", 1), (1, "b", 1), (2, "c", 0)] and share == pytest.approx(1 / 3)


def test_terms():
    out = toxicity.terms("Abcdefg abcdexy ab ab".encode())
    assert out == {b"abcdefg": 1, b"abcdexy": 1, b"ab": 2, b"\0abcde": 2, b"\1abcde": 2}
    assert b"\1abcde" not in toxicity.terms(b"abcdefg " * 2 + b"x " * 300)


def test_document_frequencies(spark, tables):
    docs, _ = tables
    vocabulary = {b"the": 0, b"die": 1, b"nowhere": 2}
    counts, n = toxicity.document_frequencies(docs, vocabulary)
    texts = [toxicity.terms((r.text or "").encode()) for r in docs.collect()]
    assert n == len(texts) and counts.tolist() == [sum(t in x for x in texts) for t in vocabulary]


def held_out(df, labels, label):
    rows = df.join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").filter("held_out").toPandas()
    good = (rows.predicted == rows.y).mean()
    a, b = rows.score[rows.y == 1].to_numpy(), rows.score[rows.y == 0].to_numpy()
    auc = ((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2) if len(a) and len(b) else 1.0
    return good, auc


def test_toxicity(spark, tables):
    docs, labels = tables
    out = entries.op5_toxicity(spark, FOLDER)
    assert out.count() == docs.count() and out.filter("score < 0 OR score > 1 OR (score >= 0.5) != (predicted = 1)").isEmpty()
    turned = labels.withColumn("toxic", F.when(labelled.in_fold(F.col("doc_id"), 5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    columns = ("doc_id", "score", "evidence")
    assert cases.rows_of(toxicity.scored(docs.drop("lang", "source"), turned), *columns) == cases.rows_of(out, *columns)


def test_toxicity_held_out(spark):
    """On the tables with 825 held-out rows."""
    folder = "/root/testdata/sf0.1"
    out = entries.op5_toxicity(spark, folder)
    good, auc = held_out(out, spark.read.parquet(f"{folder}/labels.parquet"), "toxic")
    assert good > 0.97 and auc > 0.93


def test_quality(spark, tables):
    docs, labels = tables
    out = entries.op6_quality_model(spark, FOLDER)
    assert out.count() == docs.count() and out.filter("score < 0 OR score > 1 OR (score >= 0.5) != (predicted = 1)").isEmpty()
    good, auc = held_out(out, labels, "quality")
    assert good > 0.95 and auc > 0.95


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 256, 257, 448, 449, 5000):
        text = bytes(np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8))
        chunks = quality_model.chunked(text)
        for i, c in enumerate(chunks):
            part = text[i * quality_model.STRIDE : i * quality_model.STRIDE + quality_model.CHUNK]
            assert c.tobytes().rstrip(b"\0") == part.rstrip(b"\0")
        assert (len(chunks) - 1) * quality_model.STRIDE + quality_model.CHUNK >= n
        assert len(chunks) == 1 or (len(chunks) - 2) * quality_model.STRIDE + quality_model.CHUNK < n


def test_convolution_by_loop():
    q, rng = quality_model, np.random.default_rng(5)
    model = q.Model(*(rng.standard_normal(s).astype(np.float32) for s in ((256, q.DIMS), (q.WIDTH * q.CHANNELS, q.FILTERS), q.FILTERS, q.FILTERS, q.FILTERS, 1)))
    chunks = q.chunked(b"abcabcabc some bytes some bytes " * 20)[:2]
    for c, row in zip(chunks, model.pooled(chunks), strict=True):
        seen = np.zeros((q.CHUNK, len(q.LAGS)))
        for i in range(q.CHUNK):
            for k, (lo, hi) in enumerate(q.LAGS):
                seen[i, k] = any(i - lag - q.GRAM + 1 >= 0 and all(c[i - j] == c[i - j - lag] != 0 for j in range(q.GRAM)) for lag in range(lo, hi))
        x = np.concatenate([model.embedding[c], seen], axis=1)
        every = [x[p * q.HOP : p * q.HOP + q.WIDTH].reshape(-1) @ model.filters for p in range(q.POSITIONS)]
        assert np.allclose(row, np.maximum(np.max(every, axis=0) + model.bias, 0), atol=1e-3)


def test_gradient_by_differences(monkeypatch):
    """Each parameter's slope is what a small step changes, also where a text passes in slices."""
    q, rng = quality_model, np.random.default_rng(3)
    model = q.start(rng)
    for name in q.NAMES:
        setattr(model, name, getattr(model, name).astype(np.float64) + (0.05 if name == "bias" else 0))
    model.patches = lambda chunks, extra: patches64(q, model, chunks, extra)
    texts = [q.chunked(bytes(rng.integers(97, 110, n, dtype=np.uint8))) for n in (30, 900, 2500, 300)]
    labels = np.array([0, 1, 0, 1])
    loss, slope = q.gradient(model, texts, [q.repeats(c) for c in texts], labels)
    monkeypatch.setattr(q, "SLICE", 3)
    again, sliced = q.gradient(model, texts, [q.repeats(c) for c in texts], labels)
    assert loss == pytest.approx(again) and all(np.allclose(slope[n], sliced[n], atol=1e-6) for n in q.NAMES)
    for name in q.NAMES:
        own = getattr(model, name)
        for at in [np.unravel_index(np.abs(slope[name]).argmax(), own.shape), tuple(0 for _ in own.shape)]:
            kept, sides = own[at], []
            for step in (1e-5, -1e-5):
                own[at] = kept + step
                sides.append(q.gradient(model, texts, [q.repeats(c) for c in texts], labels)[0])
            own[at] = kept
            assert slope[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=2e-3, rel=0.05)


def test_gradient_of_repeated_chunks_and_rows():
    """Different chunks with their counts, and rows with theirs, give the gradient of all chunks of all rows."""
    q, rng = quality_model, np.random.default_rng(4)
    model = q.start(rng)
    texts = [q.chunked(t) for t in (b"abc " * 700, bytes(rng.integers(97, 120, 1500, dtype=np.uint8)), b"", b"xy" * 900)]
    labels, drawn = np.array([0, 1, 1, 0]), np.array([3, 1, 2, 1])
    some, times = zip(*map(q.distinct, texts), strict=True)
    assert [len(x) for x in some] != [len(x) for x in texts] and [t.sum() for t in times] == [len(x) for x in texts]
    every = np.repeat(np.arange(4), drawn)
    loss, slope = q.gradient(model, [texts[i] for i in every], [q.repeats(texts[i]) for i in every], labels[every])
    again, counted = q.gradient(model, [*some], [q.repeats(x) for x in some], labels, [*times], drawn)
    assert loss == pytest.approx(again, rel=1e-5) and all(np.allclose(slope[n], counted[n], atol=1e-5) for n in q.NAMES)


def patches64(q, model, chunks, extra):
    x = np.concatenate([model.embedding[chunks], extra.astype(np.float64)], axis=2)
    return np.stack([x[:, p * q.HOP : p * q.HOP + q.WIDTH].reshape(len(chunks), -1) for p in range(q.POSITIONS)], axis=1)


def test_quality_scores_by_loop():
    """From a text to its probability, chunk by chunk, with the network's values by loops."""
    q, rng = quality_model, np.random.default_rng(8)
    model = q.start(rng)
    for text in (b"", b"some text " * 90, bytes(rng.integers(0, 256, 1500, dtype=np.uint8))):
        values = np.stack([model.pooled(c[None])[0] for c in q.chunked(text)]).astype(np.float64)
        z = float(model.mean @ values.mean(axis=0) + model.top @ values.max(axis=0) + model.offset[0])
        assert model.probability(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


@pytest.mark.parametrize("scored", [toxicity.scored, quality_model.scored])
def test_odd_rows(spark, scored):
    df = cases.odd(spark)
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 10)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for labels in (nothing, some):
        out = scored(df, labels).collect()
        assert len(out) == len(cases.ODD) and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id in (5, 6)}) == 1
    assert scored(df.limit(0), some).count() == 0
