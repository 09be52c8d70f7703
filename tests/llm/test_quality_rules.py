import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import cases
from paperlode.llm import entries, quality_rules

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def check(spark, texts):
    out = quality_rules.verdicts(cases.table(spark, [*enumerate(texts)])).collect()
    assert len(out) == len(texts)
    for r in out:
        expected = cases.metrics(texts[r.doc_id])
        assert {n: r[n] for n in NAMES} == expected
        failed = expected["n_words"] < 10 or 100 * expected["n_repeat_words"] > 20 * expected["n_words"]
        assert r.base_failed == failed and not (failed and r.kept) and r.kept == (r.failed == "")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "Wörter", "#", " ", "  ", "\n", "\t", "\x0b", "\x85", " ", "\U0001f600", "the"]), max_size=80).map("".join), min_size=1, max_size=40))
def test_metrics(spark, texts):
    check(spark, texts)


def test_documents(spark):
    check(spark, [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_rules():
    text = quality_rules.Rule("x", "n_symbols", "n_words", 25).sql()
    assert text == "(n_words >= 0 AND 100 * n_symbols > 25 * n_words)"


def test_clean_text_stays_and_junk_goes(spark):
    rng = cases.seeded(1)
    clean = "The river was low in the summer, and it is said that the town had by then lost most of its mills. " + cases.prose(rng, 60, 10**6)
    junk = ["buy now " * 40, "# $ % & " * 30, "FREE " * 3, "A! " + " ".join("WORD" + chr(65 + i % 26) * (1 + i // 26) for i in range(60))]
    out = {r.doc_id: r.kept for r in quality_rules.verdicts(cases.table(spark, [(0, clean), *enumerate(junk, 1)])).collect()}
    assert out == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_odd_rows(spark):
    df = cases.odd(spark)
    out = quality_rules.verdicts(df).collect()
    assert len(out) == len(cases.ODD) and all(r.base_failed and not r.kept for r in out if r.doc_id in (1, 2, 3, 4))
    assert quality_rules.accepted(df).columns == df.columns
    assert quality_rules.accepted(df.limit(0)).count() == 0 and quality_rules.verdicts(df.limit(0)).count() == 0


def test_no_user_functions(spark):
    plan = quality_rules.verdicts(cases.odd(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))


def test_query(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    names = ("doc_id", *NAMES, "base_failed", "kept", "failed")
    own = cases.rows_of(entries.op9_quality_rules(spark, "/root/testdata/sf0.001"), *names)
    assert own == sorted(con.sql(quality_rules.SQL).select(", ".join(names)).fetchall())
