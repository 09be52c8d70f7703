import duckdb
import pytest
from pyspark.sql import functions as F

import cases
from paperlode.llm import entries, line_dedup


def docs(seed, n=14, kinds=6):
    """Documents of lines from a few kinds, so that runs repeat within and between them."""
    rng = cases.seeded(seed)
    lines = ["", " ", *(cases.prose(rng, rng.randrange(1, 6), 3) for _ in range(kinds))]
    return [(d, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 18)))) for d in range(n)]


def listed(gone):
    out, runs = sorted(gone), []
    for p in out:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return ",".join(f"{a}-{b}" for a, b in runs)


def test_long_runs_between_documents(spark):
    """Without repeats inside a document all stretches, and not windows only, are compared."""
    rng = cases.seeded(8)
    passages = [[cases.prose(rng, rng.randrange(3, 9)) for _ in range(6)] for _ in range(5)]
    own = []
    for d in range(12):
        parts = rng.sample(passages, 3)
        own.append((d, "\n".join(x for p in parts for x in ([cases.prose(rng, 7, 10**6)] + p[rng.randrange(3) :]))))
    gone = cases.line_removals(own, 12)
    out = line_dedup.removed(cases.table(spark, own), least=12).collect()
    assert any(gone.values())
    for r in out:
        lines = dict(own)[r.doc_id].split("\n")
        assert r.removed == listed(gone[r.doc_id]) and r.n_removed == len(gone[r.doc_id])
        assert r.text == "\n".join(x for p, x in enumerate(lines) if p not in gone[r.doc_id])


@pytest.mark.parametrize("seed", range(6))
def test_repeats_everywhere(spark, seed):
    own = docs(seed)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", own)
    sql = line_dedup.SQL.replace(f">= {line_dedup.MIN_WORDS}", ">= 8")
    rows = con.sql(sql).select("doc_id, n_lines, n_removed, removed, text").fetchall()
    assert cases.rows_of(line_dedup.removed(cases.table(spark, own), least=8), "doc_id", "n_lines", "n_removed", "removed", "text") == sorted(rows)


def test_a_planted_passage(spark):
    rng = cases.seeded(2)
    passage = "\n".join(cases.prose(rng, 11) for _ in range(6))
    texts = [(i, f"{cases.prose(rng, 30, 10**6)}\n{passage}\n{cases.prose(rng, 30, 10**6)}") for i in range(5)]
    out = {r.doc_id: r for r in line_dedup.removed(cases.table(spark, texts)).collect()}
    assert out[0].n_removed == 0 and all(out[i].removed == "1-6" for i in range(1, 5))


def test_odd_rows(spark):
    passage = "\n".join(f"line {i} of this passage has some eight words" for i in range(8))
    rows = [*cases.ODD, (30, passage), (31, f"own words\n{passage}"), (31, f"own words\n{passage}"), (None, passage), (33, passage)]
    df = cases.table(spark, rows)
    out = line_dedup.deduped(df)
    assert out.columns == df.columns
    left = {(r.doc_id, r.text) for r in out.collect()}
    assert (30, passage) in left and (31, "own words") in left and (8, cases.LONG) in left
    assert not [x for x in left if x[0] == 33] and (None, "no id at all") in left and (1, None) in left and (2, "") in left
    assert out.filter("doc_id = 31").count() == 2 and out.filter("doc_id IS NULL").count() == 2
    digest = line_dedup.removed(df)
    assert digest.count() == len(rows) and digest.filter("doc_id = 1").first().text is None
    assert line_dedup.deduped(df.limit(0)).count() == 0 and line_dedup.removed(df.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = line_dedup.removed(cases.odd(spark).filter(F.col("doc_id") < 8))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_query(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    names = ("doc_id", "n_lines", "n_removed", "removed", "text")
    own = cases.rows_of(entries.op8_line_dedup(spark, "/root/testdata/sf0.01"), *names)
    assert own == sorted(con.sql(line_dedup.SQL).select(", ".join(names)).fetchall()) and any(r[2] for r in own)
