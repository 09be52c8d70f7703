"""The stored full-text index: the same postings as the plain ones, made in one pass without a shuffle."""

import itertools

import pytest
from pyspark.sql import functions as F

from paperlode.functions import fulltext
from paperlode.functions.stemmer import stem
from paperlode.plans import registry, search
from paperlode.sources import corpus as model

CHARACTERS = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x11000)]))
TEXTS = [
    (1, "Licensed under", "under LICENSED mit9"), (2, "a", "b a a"), (3, None, None), (4, "", ""), (5, "ab", "cd"), (6, "The title", None),
    (7, None, "x " * (fulltext.MOST_POSITION + 70_000)), (8, "İstanbul Kelvin ſ é", "İKKk ıİ"), (9, "x", "a".join(CHARACTERS)), (10, "-", "--a--"), (2, "a", "b again"),
]


def papers(spark):
    return spark.createDataFrame(TEXTS, "paper_id long, title string, abstract string").repartition(2)


def rows(df):
    return sorted(map(tuple, df.select("paper_id", "lexeme", "pos", "weight").collect()))


@pytest.mark.parametrize("most", [1, 1 << 12, 1 << 30])
def test_inverted_postings_are_the_postings(spark, most):
    df = papers(spark)
    assert rows(fulltext.flat(fulltext.inverted(df, batch_bytes=most))) == rows(fulltext.postings(df))


def test_english_postings_are_stems_of_the_simple_ones(spark):
    df = papers(spark).union(spark.createDataFrame([(20, "The licenses", "applied under the running of s")], "paper_id long, title string, abstract string"))
    plain = rows(fulltext.postings(df))
    expected = sorted((i, stem(w), p, f) for i, w, p, f in plain if w not in fulltext.STOP_WORDS)
    assert rows(fulltext.postings(df, "english")) == expected


@pytest.mark.parametrize("mode", ["simple", "english"])
def test_index_is_built_without_a_shuffle(spark, mode):
    """A shuffle by lexeme put all places of a frequent one into one task, after a second pass for its bounds."""
    built = fulltext.by_lexeme(fulltext.inverted(model.from_test_tables(spark, "/root/testdata/sf0.001").papers, mode))
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString()


def test_rows_of_the_index_are_bounded(spark):
    assert fulltext.inverted(papers(spark)).agg(F.max(F.size("places"))).first()[0] == fulltext.MOST_HELD


def test_nothing_to_index(spark):
    df = papers(spark).filter("paper_id IN (3, 4)")
    assert rows(fulltext.flat(fulltext.by_lexeme(fulltext.inverted(df)))) == []


def test_english_search_finds_what_plain_postings_have(spark):
    folder = "/root/testdata/sf0.001"
    own = registry.QUERIES["fts_rank_english"](spark, folder).collect()
    wanted = {stem("licenses"), stem("applied")}
    has = {r[0] for r in rows(fulltext.postings(model.from_test_tables(spark, folder).papers)) if r[1] not in fulltext.STOP_WORDS and stem(r[1]) in wanted}
    assert len(own) == min(20, len(has)) and {r.paper_id for r in own} <= has


def test_ranked_page_is_that_of_plain_postings(spark):
    folder = "/root/testdata/sf0.01"
    c = model.from_test_tables(spark, folder)
    stored = registry.stored_postings(c, spark, folder)
    assert stored.columns == ["paper_id", "lexeme", "pos", "weight"] and "places" in stored._jdf.queryExecution().optimizedPlan().toString()
    pages = [search.keyword_search(registry.KEYWORDS, c.papers, t).select("paper_id", F.round("rank", 6), "created").collect() for t in (stored, fulltext.postings(c.papers))]
    assert len(pages[0]) == 20 and pages[0] == pages[1]


@pytest.mark.parametrize("query", ["license apache inea:*", '"licensed under"', '"a b" cd'])
def test_matches_are_those_of_plain_postings(spark, query):
    """Through an index of one row of papers a batch, as texts are cut anywhere."""
    parsed = fulltext.lexemes(fulltext.parse(query), "simple")
    index = fulltext.flat(fulltext.by_lexeme(fulltext.inverted(papers(spark), batch_bytes=1)))
    found = [sorted(r[0] for r in fulltext.matching(t, *parsed).collect()) for t in (index, fulltext.postings(papers(spark)))]
    assert found[0] == found[1] and (found[0] or "apache" in query)


@pytest.mark.parametrize("query", ["a b c d", '"a b c d"'])
def test_rank_does_not_follow_the_order_of_rows(spark, query):
    """Sums and products of doubles in the order of arrival differ in their last bits, and a page of ties follows these."""
    if query[0] == "a":
        texts = [" ".join(f"{w} " * n for w, n in zip("abcd", counts)) for counts in itertools.permutations((1, 2, 3, 5))]
    else:
        texts = [f"a{' x' * 9} b{' x' * 10} c{' x' * 14} d"] * 24
    table = fulltext.postings(spark.createDataFrame([*enumerate(texts)], "paper_id long, abstract string").withColumn("title", F.lit(""))).cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = fulltext.rank(table, *fulltext.lexemes(fulltext.parse(query), "simple")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        table.unpersist()
    assert len(rows) == len(texts) and len({r.rank for r in rows}) == 1
