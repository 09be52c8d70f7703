from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import cases
from paperlode.llm import entries, mixing


def docs(seed, sources=5, n=300):
    rng = cases.seeded(seed)
    names = ["zeta", "alpha", "Äther", None, "beta"][:sources]
    return [(i, cases.prose(rng, rng.choice([0, 3, 50, 400])), names[min(rng.randrange(sources * 2), sources - 1)]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute_force(spark, seed):
    own = docs(seed)
    copies = dict(cases.mix_copies(own))
    sizes = Counter()
    for _, t, s in own:
        sizes[s] += len(t.split())
    targets = cases.mix_targets(sizes)
    assert sum(targets.values()) <= sum(sizes.values()) + 1e-6
    for r in mixing.taken(cases.table(spark, own)).join(cases.table(spark, own).select("doc_id", "source"), "doc_id").collect():
        assert r.source_size == sizes[r.source] and abs(r.target - float(targets[r.source])) < 1e-6 * (1 + r.target)
        assert r.taken == r.size * copies[r.doc_id] <= 3 * r.size
    mixed = Counter(r.doc_id for r in mixing.mix(cases.table(spark, own)).collect())
    assert mixed == {d: n for d, n in copies.items() if n}


def test_partitions_make_no_difference(spark):
    df = cases.table(spark, docs(4))
    first = cases.rows_of(mixing.taken(df), "doc_id", "taken")
    assert first == cases.rows_of(mixing.taken(df.repartition(7).orderBy(F.desc("doc_id"))), "doc_id", "taken")


def test_taken_is_near_the_target(spark):
    taken = mixing.taken(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source"))
    for r in taken.groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.sum(F.col("size") * F.col("size")).alias("v")).collect():
        assert abs(r.t - r.target) <= 4 * (0.25 * r.v) ** 0.5 + 1  # four standard deviations of the coin's tosses


def test_odd_rows(spark):
    df = cases.odd(spark)
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert mixing.taken(df).count() == df.count() and mixing.taken(df).filter("size = 0 AND taken != 0").isEmpty()
    same = mixing.taken(df).filter("doc_id = 6").select("taken").distinct().count()
    assert same == 1
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.taken(df.limit(0)).count() == 0
    blank = cases.table(spark, [(1, "", "a"), (2, None, None)])
    assert cases.rows_of(mixing.mix(blank), "doc_id") == [(1,), (2,)]


def test_query(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    rows = con.sql(mixing.SQL).select("doc_id, size, source_size, target, taken").fetchall()
    own = cases.rows_of(entries.op4_mixing(spark, "/root/testdata/sf0.01"), "doc_id", "size", "source_size", "target", "taken")
    assert own == sorted(rows)
