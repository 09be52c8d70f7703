import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import cases
from paperlode.llm import entries, graph, near_dedup, shingles


def compare(spark, docs):
    expected = cases.near_groups(docs)
    out = near_dedup.groups(cases.table(spark, docs)).collect()
    assert {r.doc_id: r.component_id for r in out} == expected
    assert all(r.n_shingles == len(cases.shingles(dict(docs)[r.doc_id])) and r.kept == (r.doc_id == r.component_id) for r in out)
    return expected


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rng = cases.seeded(seed)
    docs, i = [], 0
    for _ in range(25):
        text = cases.prose(rng, rng.choice([3, 5, 8, 60, 300]), 10**5)
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            docs.append((i, cases.changed(rng, text, rng.choice([0, 0.005, 0.01, 0.02, 0.1])) if rng.random() < 0.8 else text.upper()))
            i += 1
    rng.shuffle(docs)
    groups = compare(spark, docs)
    assert len(set(groups.values())) < len(docs)


def test_large_group_and_chain(spark):
    """A group over several blocks, and a chain whose ends aren't alike."""
    rng = cases.seeded(3)
    text = cases.prose(rng, 200, 10**5)
    docs = [(i, cases.changed(rng, text, 0.004)) for i in range(400)]
    words = cases.prose(rng, 300, 10**5).split(" ")
    for i in range(30):
        docs.append((1000 + i, " ".join(words)))
        words[i * 9] = f"c{i}"
    compare(spark, docs)


def test_blocks(spark, monkeypatch):
    """With tiny blocks every pair of blocks meets."""
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 3)
    rng = cases.seeded(4)
    text = cases.prose(rng, 100, 10**5)
    compare(spark, [(i, cases.changed(rng, text, 0.01)) for i in range(60)])


def test_threshold_is_exact(spark):
    """Sets of 17 of 20 shingles in common stand at the threshold, of 16 of 20 below it."""
    a = [f"a{i}" for i in range(22)]  # 18 shingles
    at = [*a[:21], "z1", "z2"]  # 17 in common, 19 of its own: 17 of 20
    below = [*a[:20], "y1", "y2"]  # 16 in common, 18 of its own: 16 of 20
    assert set(compare(spark, [(0, " ".join(a)), (1, " ".join(at))]).values()) == {0}
    assert set(compare(spark, [(0, " ".join(a)), (1, " ".join(below))]).values()) == {0, 1}


def test_shingle_sets(spark):
    rng = random.Random(5)
    for text in ["", " \n", "One", "one two three four", "a b c d e", "A b C d E f", cases.prose(rng, 3000, 20), "ü" * 50, cases.LONG]:
        assert len(shingles.shingles(text.encode())) == len(cases.shingles(text))
    a, b = "x y z é w v", "X Y Z é W V"
    assert np.array_equal(shingles.shingles(a.encode()), shingles.shingles(b.encode()))


def test_pieces_make_no_difference(monkeypatch):
    text = cases.prose(random.Random(6), 500, 50).encode()
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "PIECE", 37)
    assert np.array_equal(shingles.word_hashes(text), whole)


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(50)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    found = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found.keys() == parent.keys() and all(top(x) == top(y) for x, y in found.items())
    assert len(set(found.values())) == len({top(x) for x in parent})


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    """Of nodes in order, each linked with the next: the worst order for pointers at smaller nodes."""
    tables = []
    monkeypatch.setattr(graph, "cut", lambda df, own=graph.cut: (tables.append(1), own(df))[1])
    chain = spark.range(1, 20_000).selectExpr("id AS a", "id + 1 AS b")
    assert graph.components(chain).select("label").distinct().count() == 1
    assert len(tables) <= 2 + 3 * 16


def test_odd_rows(spark):
    df = cases.odd(spark)
    out = near_dedup.groups(df).collect()
    assert len(out) == len(cases.ODD)
    by = {(r.doc_id, r.n_shingles): r for r in out}
    assert all(by[d, 0].component_id == d and by[d, 0].kept for d in (1, 2, 3))
    assert by[6, 1].component_id == 5 and not by[6, 1].kept and by[9, by_size(out, 9)].component_id == 8
    kept = near_dedup.deduped(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "8", "None", "None"]
    assert near_dedup.groups(df.limit(0)).count() == 0 and near_dedup.deduped(df.limit(0)).count() == 0


def test_candidates_are_the_next_four(monkeypatch):
    """Of classes that share a prefix, also over the ends of batches."""
    keys = [bytes([i]) for i in range(12)]
    batches = [pa.RecordBatch.from_arrays([pa.array([0] * len(ks)), pa.array([b"p" * 32] * len(ks)), pa.array(ks), pa.array([bytes([k[0]] * 60) for k in ks])], names=["tree", "prefix", "set_key", "low"]) for ks in (keys[:5], keys[5:7], keys[7:])]
    judged = []
    monkeypatch.setattr(near_dedup, "ALIKE", -1)  # all are alike
    monkeypatch.setattr(near_dedup, "forest_of", lambda pairs: judged.extend(pairs) or pairs)
    found = [r for batch in near_dedup.neighbours(iter(batches)) for r in zip(*(c.to_pylist() for c in batch.columns))]
    assert sorted(judged) == sorted((a, b) for _, a, b, _ in found if b is not None) == [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 : i + 5]]
    assert {(t, a, s) for t, a, b, s in found if b is None} == {(0, k, False) for k in keys}  # more than four share the whole prefix
    monkeypatch.setattr(near_dedup, "ALIKE", 0.65)
    found = [r for batch in near_dedup.neighbours(iter(batches)) for r in zip(*(c.to_pylist() for c in batch.columns))]
    assert {(t, a, s) for t, a, b, s in found if b is None} == {(0, k, True) for k in keys} and all(b is None for _, _, b, _ in found)


def test_spanning_forest():
    pairs = [(b"a", b"b"), (b"c", b"d"), (b"b", b"a"), (b"b", b"d"), (b"a", b"c"), (b"e", b"e")]
    assert near_dedup.forest_of(pairs) == [(b"a", b"b"), (b"c", b"d"), (b"b", b"d")]


@pytest.mark.parametrize("n", [2000, 6000])
def test_dense_region(spark, n):
    """Sets that share a template (similarity 0.42) stay apart, and links between them are found."""
    rng = np.random.default_rng(n)
    hashes = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64)
    template, rows, planted = hashes(118), [], []

    def put(own):
        x = np.unique(np.concatenate([template, own]))
        sig = shingles.minhash(x, near_dedup.HASHES).astype(">u4").tobytes()
        rows.append((shingles.set_key(x), sig, near_dedup.low_bits(sig)))
        return rows[-1][0]

    for i in range(n):
        own = hashes(82)
        a = put(own)
        if i % (n // 50) == 0:
            own = own.copy()
            own[:15] = hashes(15)  # 185 of 215 are common
            planted.append((a, put(own)))
    classes = spark.createDataFrame([tuple(map(bytearray, r)) for r in rows], "set_key binary, sig binary, low binary")
    family = {bytes(r.node): bytes(r.label) for r in near_dedup.families(classes).collect()}
    assert sum(a in family and family[a] == family.get(b) for a, b in planted) >= 0.98 * len(planted)
    assert max(sum(f == x for f in family.values()) for x in set(family.values())) <= 8


def test_solid_blocks_do_not_meet(spark, monkeypatch):
    """A large family whose links are found at random isn't copied to all of its blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 20)
    member = spark.createDataFrame([(bytearray([i // 256, i % 256]), bytearray(b"f"), f"k{i}", 10) for i in range(400)], "set_key binary, family binary, key string, n_shingles long")
    texts = member.select("set_key", "family", F.lit(b"x").alias("hashes"))
    joined = member.filter("set_key < X'0186'").select("family", F.lit(b"one").alias("label"), "set_key", "n_shingles")
    dealt = near_dedup.dealt_pairs(texts, member, joined).collect()
    pairs = {}
    for r in dealt:
        pairs.setdefault((r.i, r.j), set()).add(bytes(r.set_key))
    loose = {bytes([i // 256, i % 256]) for i in range(390, 400)}
    every = {bytes([i // 256, i % 256]) for i in range(400)}
    assert all(any({a, b} <= x for x in pairs.values()) for a in loose for b in every)
    assert len(dealt) == 390 + 20 * 10  # 20 blocks of what is joined, which meet the one loose block only


def test_rows_of_an_id_go_by_their_text(spark):
    """Of rows that share an id, only the one that another document stands for goes."""
    rng = cases.seeded(11)
    a, b = (cases.prose(rng, 60, 10**6) for _ in range(2))
    out = near_dedup.deduped(cases.table(spark, [(3, a), (5, a.upper()), (5, b), (5, None), (5, "")]))
    assert cases.rows_of(out, "doc_id", "text") == sorted([(3, a), (5, b), (5, None), (5, "")], key=lambda r: (r[0], r[1] is not None, r[1] or ""))


def by_size(out, doc):
    return next(r.n_shingles for r in out if r.doc_id == doc)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.col("text")).collect()]
    expected = cases.near_groups(docs)
    assert {r.doc_id: r.component_id for r in entries.op10_near_dedup(spark, folder).collect()} == expected
    assert sum(a != b for a, b in expected.items())
