"""Queries by name, over the driver's tables, and the DuckDB SQL that each is held against."""

from __future__ import annotations

import dataclasses
from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperlode.functions import fulltext, text, vectors
from paperlode.operators import ingest, knn, latency, pages, tables
from paperlode.operators.candidates import candidates
from paperlode.plans import search
from paperlode.shared import built
from paperlode.sources import corpus as model
from paperlode.sources import harvest

AS_OF = datetime(2026, 3, 10)
DIMS, SEED, USER, TAG, PAPER = 64, 7, 5, 52, 0
QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: The mapping of sources.corpus.from_test_tables, as DuckDB's common table expressions.
WITH = {
    "papers": """papers AS (SELECT doc_id AS paper_id, 'arx.' || lpad(doc_id::VARCHAR, 6, '0') AS arxiv_id,
      TIMESTAMP '2024-01-01' + to_days((doc_id % 800)::INT) AS created, regexp_split_to_array(text, '[.\\n]')[1] AS title, text AS abstract,
      [lang, source] AS categories, CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((doc_id % 800 + doc_id % 30)::INT) END AS updated FROM documents)""",
    "authors": "authors AS (SELECT s_suppkey AS author_id, s_name AS keyname, CASE WHEN s_suppkey % 5 <> 0 THEN n_name END AS forenames FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "paper_author": "paper_author AS (SELECT l_orderkey AS paper_id, l_suppkey AS author_id, min(l_linenumber)::INT AS ord FROM lineitem JOIN documents ON l_orderkey = doc_id GROUP BY ALL)",
    "tags": "tags AS (SELECT user_id * 10 + list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS tag_id, user_id, event_type AS name, min(ts) AS created_at FROM events GROUP BY ALL)",
    "tagged_papers": "tagged_papers AS (SELECT user_id * 10 + list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS tag_id, event_id % (SELECT count(*) FROM documents) AS paper_id, min(ts) AS added_at FROM events GROUP BY ALL)",
    "citations": "citations AS (SELECT DISTINCT l_orderkey AS citing_id, l_partkey AS cited_id FROM lineitem WHERE l_orderkey < (SELECT count(*) FROM documents) AND l_partkey < (SELECT count(*) FROM documents) AND l_orderkey <> l_partkey)",
    "emb": "emb AS (SELECT vec_id AS paper_id, embedding AS v FROM embeddings)",
}
HAMMING = "len(list_filter(range(1, 65), lambda i: (e.v[i] > 0) <> (q.v[i] > 0)))"
L2 = "round(list_distance(e.v::DOUBLE[], q.v::DOUBLE[]), 6)"


def query(sql: str | None = None, *ctes: str):
    """Registers a function of (corpus, spark, sf_dir) under its name, with its SQL."""

    def put(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(model.from_test_tables(spark, sf_dir), spark, sf_dir)
        if sql is not None:
            ORACLE[function.__name__] = (f"WITH {', '.join(WITH[c] for c in ctes)} " if ctes else "") + sql
        return function

    return put


def many(names_and_sql: dict[str, str], *ctes: str):
    """Registers a function of (corpus, argument) once for each argument, as name_argument."""

    def put(function):
        for argument, sql in names_and_sql.items():
            name = f"{function.__name__}_{argument}"
            QUERIES[name] = lambda spark, sf_dir, a=argument: function(model.from_test_tables(spark, sf_dir), a)
            ORACLE[name] = f"WITH {', '.join(WITH[c] for c in ctes)} {sql}"
        return function

    return put


def with_bits(c, spark, sf_dir):
    """The corpus with stored bits beside the vectors, packed once for each application."""
    stored = built(spark, ("bits", sf_dir), lambda: ingest.derived(c.embeddings, 32, DIMS))
    return dataclasses.replace(c, embeddings=stored)


def stored_postings(c, spark, sf_dir, mode="simple"):
    """The papers' postings, of a table in order of lexemes that is built once for each application."""
    return fulltext.flat(built(spark, ("postings", mode, sf_dir), lambda: fulltext.by_lexeme(fulltext.inverted(c.papers, mode))))


def rounded(c: str):
    return F.round(F.col(c), 6).alias(c)


# scans and filters


@query("SELECT paper_id, abstract FROM papers", "papers")
def scan_project(c, spark, sf_dir):
    return c.papers.select("paper_id", "abstract")


@query("SELECT count(*) AS n FROM documents")
def scan_count(c, spark, sf_dir):
    return c.papers.agg(F.count("*").alias("n"))


CUTOFFS = {k: f"SELECT paper_id, arxiv_id, created FROM papers WHERE created >= TIMESTAMP '2026-03-10' - to_days({d})" for k, d in {"1day": 1, "3day": 3, "1week": 7, "1month": 30, "3months": 90, "6months": 180, "1year": 365, "2years": 730}.items()}


@many(CUTOFFS | {"all": "SELECT paper_id, arxiv_id, created FROM papers", "unknown": "SELECT paper_id, arxiv_id, created FROM papers", "default": CUTOFFS["1week"]}, "papers")
def date_cutoff(c, key):
    return candidates(c.papers, AS_OF, "" if key == "default" else key).select("paper_id", "arxiv_id", "created")


@query("SELECT paper_id FROM papers WHERE list_contains(categories, 'fr')", "papers")
def category_contains(c, spark, sf_dir):
    return candidates(c.papers, AS_OF, "all", "fr").select("paper_id")


@query("SELECT doc_id AS paper_id FROM documents WHERE doc_id NOT IN (0, 3, 5, 8)")
def exclude_ids_anti(c, spark, sf_dir):
    return candidates(c.papers, AS_OF, "all", exclude={0, 3, 5, 8}).select("paper_id")


FILTERED = f"created >= TIMESTAMP '2026-03-10' - to_days(365) AND list_contains(categories, 'en') AND paper_id NOT IN (1, 2, {PAPER}) AND paper_id NOT IN (SELECT paper_id FROM tagged_papers WHERE tag_id = {TAG})"


@query(f"SELECT paper_id, created FROM papers WHERE {FILTERED}", "papers", "tagged_papers")
def candidate_filter(c, spark, sf_dir):
    drawer = c.tagged_papers.filter(F.col("tag_id") == TAG)
    return candidates(c.papers, AS_OF, "1year", "en", {1, 2}, drawer, PAPER).select("paper_id", "created")


@query("SELECT paper_id, title, created FROM papers WHERE contains(upper(title), 'THE') ORDER BY created DESC, paper_id LIMIT 20", "papers")
def title_icontains(c, spark, sf_dir):
    return search.title_search("the", c.papers).select("paper_id", "title", "created")


@query("SELECT paper_id, arxiv_id FROM papers WHERE arxiv_id = 'arx.000042'", "papers")
def lookup_arxiv_id(c, spark, sf_dir):
    return c.papers.filter(F.col("arxiv_id") == "arx.000042").select("paper_id", "arxiv_id")


@query(f"SELECT tag_id, user_id, name FROM tags WHERE user_id = {USER} AND name = 'purchase'", "tags")
def lookup_tag(c, spark, sf_dir):
    return tables.owned(c.tags, USER).filter(F.col("name") == "purchase").select("tag_id", "user_id", "name")


# vectors


@query("SELECT paper_id, array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM emb", "emb")
def sign_quantise(c, spark, sf_dir):
    return c.embeddings.select("paper_id", vectors.sign_bits(F.col("vector")).alias("bits"))


@query("SELECT paper_id, i AS word, list_sum(list_transform(range(1, 33), lambda b: CASE WHEN v[32 * i + b] > 0 THEN 1 << (32 - b) ELSE 0 END))::BIGINT AS bits FROM emb, unnest(range(2)) AS r(i)", "emb")
def packed_words(c, spark, sf_dir):
    words = c.embeddings.select("paper_id", F.posexplode(vectors.packed(F.col("vector"), DIMS)).alias("word", "bits"))
    return words.select("paper_id", F.col("word").cast("long").alias("word"), "bits")


@query("SELECT paper_id, i AS place, round((CASE WHEN n > 0 THEN (v[i]::DOUBLE / n)::FLOAT ELSE v[i] END)::DOUBLE, 5) AS x FROM (SELECT paper_id, v, sqrt(list_sum(list_transform(v[1:32], lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM emb), unnest(range(1, 33)) AS r(i)", "emb")
def truncate_renormalise(c, spark, sf_dir):
    parts = c.embeddings.select("paper_id", F.posexplode(vectors.truncated(F.col("vector"), 32)).alias("at", "y"))
    return parts.select("paper_id", (F.col("at") + 1).cast("long").alias("place"), F.round(F.col("y").cast("double"), 5).alias("x"))


def topk_sql(distance: str, where: str = "true") -> str:
    return f"SELECT e.paper_id, {distance} AS distance FROM emb e JOIN papers USING (paper_id), (SELECT v FROM emb WHERE paper_id = {PAPER}) q WHERE e.paper_id <> {PAPER} AND {where} ORDER BY {distance}, e.paper_id LIMIT 20"


@query(topk_sql(HAMMING), "papers", "emb")
def hamming_topk(c, spark, sf_dir):
    c = with_bits(c, spark, sf_dir)
    return knn.knn(c.embeddings, c.papers.filter(F.col("paper_id") != PAPER), PAPER, 20, "hamming", DIMS)


@query(topk_sql(L2), "papers", "emb")
def l2_topk(c, spark, sf_dir):
    return knn.knn(c.embeddings, c.papers.filter(F.col("paper_id") != PAPER), PAPER, 20, "l2").select("paper_id", rounded("distance"))


@query(f"SELECT near.paper_id, arxiv_id, title, created, distance FROM ({topk_sql(HAMMING)}) near JOIN papers USING (paper_id)", "papers", "emb")
def paper_search(c, spark, sf_dir):
    c = with_bits(c, spark, sf_dir)
    page = search.paper_search(c, PAPER, candidates(c.papers, AS_OF, "all", current=PAPER))
    return page.select("paper_id", "arxiv_id", "title", "created", "distance")


@query(f"SELECT near.paper_id, title, distance FROM ({topk_sql(HAMMING, 'created >= TIMESTAMP ' + chr(39) + '2026-03-10' + chr(39) + ' - to_days(730) AND list_contains(categories, ' + chr(39) + 'en' + chr(39) + ')')}) near JOIN papers USING (paper_id)", "papers", "emb")
def paper_search_filtered(c, spark, sf_dir):
    c = with_bits(c, spark, sf_dir)
    page = search.paper_search(c, PAPER, candidates(c.papers, AS_OF, "2years", "en", current=PAPER))
    return page.select("paper_id", "title", "distance")


SOURCES = f"""src AS (SELECT paper_id, row_number() OVER (ORDER BY md5(paper_id::VARCHAR || ':{SEED}'), paper_id) AS src_ord FROM (SELECT DISTINCT paper_id FROM tagged_papers WHERE tag_id = {TAG})),
k AS (SELECT greatest(1, 20 // greatest(1, count(*))) + 1 AS k FROM src),
ranked AS (SELECT src_ord, e.paper_id, {HAMMING} AS distance, row_number() OVER (PARTITION BY src_ord ORDER BY {HAMMING}, e.paper_id) AS rk
  FROM emb e JOIN papers USING (paper_id), (SELECT src_ord, v FROM src JOIN emb USING (paper_id)) q),
found AS (SELECT * FROM ranked WHERE rk <= (SELECT k FROM k))"""


@query(f", {SOURCES} SELECT src_ord, rk, paper_id, distance FROM found", "papers", "tagged_papers", "emb")
def per_source_topk(c, spark, sf_dir):
    c = with_bits(c, spark, sf_dir)
    sources = search.shuffled_sources(c, TAG, SEED)
    found = knn.per_source(c.embeddings, c.papers, sources, knn.share(sources.count()))
    return found.select(F.col("src_ord").cast("long").alias("src_ord"), F.col("rk").cast("long").alias("rk"), "paper_id", "distance")


DEALT = """new AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY src_ord) = 1),
counts AS (SELECT src_ord, count(*) AS n FROM new GROUP BY src_ord),
used AS (SELECT src_ord FROM counts a WHERE (SELECT coalesce(sum(n), 0) FROM counts b WHERE b.src_ord < a.src_ord) < 20),
dealt AS (SELECT *, row_number() OVER (PARTITION BY src_ord ORDER BY rk) AS turn FROM new SEMI JOIN used USING (src_ord))
SELECT row_number() OVER (ORDER BY turn, src_ord) AS place, paper_id, src_ord, distance FROM dealt"""


@query(f", {SOURCES}, {DEALT}", "papers", "tagged_papers", "emb")
def tag_search(c, spark, sf_dir):
    c = with_bits(c, spark, sf_dir)
    page = search.tag_search(c, TAG, candidates(c.papers, AS_OF, "all"), SEED)
    return page.select("place", "paper_id", F.col("src_ord").cast("long").alias("src_ord"), "distance")


# full text

TOKENS = """tok AS (SELECT paper_id, lexeme, least(i + CASE f WHEN 'B' THEN nt ELSE 0 END, 16383)::INT AS pos, f AS weight FROM (
  SELECT paper_id, 'A' AS f, regexp_extract_all(lower(title), '[a-z0-9]+') AS ws, 0 AS nt FROM papers UNION ALL
  SELECT paper_id, 'B', regexp_extract_all(lower(abstract), '[a-z0-9]+'), len(regexp_extract_all(lower(title), '[a-z0-9]+')) FROM papers) x,
  unnest(ws) WITH ORDINALITY AS r(lexeme, i))"""
KEYWORDS = 'license apache "licensed under"'
PHRASE = "a.lexeme = 'licensed' AND b.lexeme = 'under' AND b.pos = a.pos + 1"
HITS = f"hits AS (SELECT paper_id FROM tok WHERE lexeme IN ('license', 'apache') UNION SELECT a.paper_id FROM tok a JOIN tok b USING (paper_id) WHERE {PHRASE})"
RANKED = """numbered AS (SELECT paper_id, lexeme, CASE weight WHEN 'A' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS w, row_number() OVER (PARTITION BY paper_id, lexeme ORDER BY pos) AS j
  FROM tok WHERE lexeme IN ('license', 'apache', 'licensed', 'under')),
each AS (SELECT paper_id, lexeme, sum(w / (j * j)) AS s, max(w) AS wm, min(j) FILTER (w = m) AS jm FROM (SELECT *, max(w) OVER (PARTITION BY paper_id, lexeme) AS m FROM numbered WHERE j <= 256) GROUP BY ALL),
ranked AS (SELECT paper_id, sum((wm + s - wm / (jm * jm)) / 1.64493406685) / 4 AS rank FROM each GROUP BY paper_id)"""


@query(f", {TOKENS} SELECT paper_id, lexeme, pos, weight FROM tok", "papers")
def fts_postings(c, spark, sf_dir):
    return fulltext.postings(c.papers)


@query(f", {TOKENS} SELECT DISTINCT paper_id FROM tok WHERE lexeme IN ('license', 'apache') OR starts_with(lexeme, 'inea')", "papers")
def fts_match_terms(c, spark, sf_dir):
    return fulltext.matching(stored_postings(c, spark, sf_dir), *fulltext.lexemes(fulltext.parse("license apache inea:*"), "simple"))


@query(f", {TOKENS} SELECT DISTINCT a.paper_id FROM tok a JOIN tok b USING (paper_id) WHERE {PHRASE}", "papers")
def fts_match_phrase(c, spark, sf_dir):
    return fulltext.matching(stored_postings(c, spark, sf_dir), *fulltext.lexemes(fulltext.parse('"licensed under"'), "simple"))


@query(f", {TOKENS}, {HITS}, {RANKED} SELECT paper_id, round(rank, 6) AS rank, created FROM ranked SEMI JOIN hits USING (paper_id) JOIN papers USING (paper_id) ORDER BY ranked.rank DESC, created DESC, paper_id LIMIT 20", "papers")
def fts_rank_topk(c, spark, sf_dir):
    page = search.keyword_search(KEYWORDS, c.papers, stored_postings(c, spark, sf_dir))
    return page.select("paper_id", rounded("rank"), "created")


@query(
    f""", {TOKENS}, pairs AS (SELECT a.paper_id, abs(a.pos - b.pos)::DOUBLE AS d, CASE a.weight WHEN 'A' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END * CASE b.weight WHEN 'A' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS w
  FROM tok a JOIN tok b USING (paper_id) WHERE a.lexeme = 'licensed' AND b.lexeme = 'under')
SELECT paper_id, round(1 - product(1 - sqrt(w * CASE WHEN d > 100 THEN 1e-30 ELSE 1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(d / 1.5::DOUBLE - 2)) END)), 6) AS rank FROM pairs
SEMI JOIN (SELECT a.paper_id FROM tok a JOIN tok b USING (paper_id) WHERE {PHRASE}) h USING (paper_id) GROUP BY paper_id""",
    "papers",
)
def fts_rank_phrase(c, spark, sf_dir):
    table = stored_postings(c, spark, sf_dir)
    terms, phrases = fulltext.lexemes(fulltext.parse('"licensed under"'), "simple")
    ranked = fulltext.rank(table, terms, phrases).join(fulltext.matching(table, terms, phrases), "paper_id", "left_semi")
    return ranked.select("paper_id", rounded("rank"))


@query()
def fts_rank_english(c, spark, sf_dir):
    page = search.keyword_search("licenses applied", c.papers, stored_postings(c, spark, sf_dir, "english"), "english")
    return page.select("paper_id", rounded("rank"), "created")


# pages


@query("SELECT DISTINCT unnest(categories) AS category FROM (SELECT * FROM papers WHERE contains(upper(title), 'THE') ORDER BY created DESC, paper_id LIMIT 20)", "papers")
def facet_categories(c, spark, sf_dir):
    return pages.categories(search.title_search("the", c.papers))


@query(f"SELECT paper_id, string_agg(name, ',' ORDER BY added_at DESC, tag_id DESC) AS tags FROM tagged_papers JOIN tags USING (tag_id) WHERE user_id = {USER} GROUP BY paper_id", "tags", "tagged_papers")
def facet_tags(c, spark, sf_dir):
    return pages.tag_lists(c.papers, c, USER).select("paper_id", F.array_join("tags", ",").alias("tags"))


NAMED = "named AS (SELECT paper_id, list(CASE WHEN coalesce(forenames, '') <> '' THEN forenames || ' ' || keyname ELSE keyname END ORDER BY ord, author_id) AS names FROM paper_author JOIN authors USING (author_id) GROUP BY paper_id)"


@query(f", {NAMED} SELECT paper_id, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' et al.' ELSE '' END AS authors, len(names)::BIGINT AS n FROM named", "authors", "paper_author")
def author_list_et_al(c, spark, sf_dir):
    return pages.author_lists(c.papers, c).select("paper_id", pages.first_authors(F.col("authors")).alias("authors"), F.size("authors").cast("long").alias("n"))


@query(f", {NAMED} SELECT p.paper_id, arxiv_id, title, coalesce(array_to_string(names, '; '), '') AS authors, created, updated, array_to_string(categories, ' ') AS categories, abstract, EXISTS (SELECT 1 FROM emb e WHERE e.paper_id = p.paper_id) AS has_embedding FROM papers p LEFT JOIN named USING (paper_id) WHERE p.paper_id = 7", "papers", "authors", "paper_author", "emb")
def paper_detail(c, spark, sf_dir):
    return pages.detail(c, 7).select("paper_id", "arxiv_id", "title", F.array_join("authors", "; ").alias("authors"), "created", "updated", F.array_join("categories", " ").alias("categories"), "abstract", "has_embedding")


DRAWER = f"SELECT row_number() OVER (ORDER BY {{}}) AS place, paper_id, title, CASE WHEN length(title) > 60 THEN title[1:60] || '...' ELSE title END AS short_title, created, updated, added_at FROM tagged_papers JOIN papers USING (paper_id) WHERE tag_id = {TAG}"


@many({k: DRAWER.format(o) for k, o in {"added": "added_at DESC, paper_id", "alpha": "title, paper_id", "submitted": "created DESC, paper_id", "updated": "updated DESC NULLS FIRST, paper_id"}.items()}, "papers", "tagged_papers")
def drawer_sort(c, sort):
    place = F.row_number().over(Window.orderBy(*pages.ORDERS[sort]())).cast("long")  # one tag's papers
    return pages.drawer(c, TAG, sort).select(place.alias("place"), "paper_id", "title", "short_title", "created", "updated", "added_at")


@query(f"SELECT tag_id, name, count(paper_id) AS n FROM tags LEFT JOIN tagged_papers USING (tag_id) WHERE user_id = {USER} GROUP BY ALL", "tags", "tagged_papers")
def tag_counts(c, spark, sf_dir):
    return pages.tag_sizes(c, USER)


@query("SELECT paper_id, strftime(created, '%b %Y') AS month, strftime(created, '%B %-d, %Y') AS day FROM papers", "papers")
def date_display(c, spark, sf_dir):
    return c.papers.select("paper_id", text.month(F.col("created")).alias("month"), text.day(F.col("created")).alias("day"))


@query("SELECT paper_id, arxiv_id || ': ' || title[1:100] AS label, CASE WHEN length(title) > 50 THEN title[1:49] || '…' ELSE title END AS short_title FROM papers", "papers")
def paper_labels(c, spark, sf_dir):
    return c.papers.select("paper_id", text.paper_label(F.col("arxiv_id"), F.col("title")).alias("label"), text.shortened_within(F.col("title"), 50).alias("short_title"))


@query()
def latex_to_html(c, spark, sf_dir):
    """Over whole titles and abstracts; tests/test_engine.py holds it against a version of its own."""
    return c.papers.select("paper_id", text.latex_to_html(F.col("title")).alias("title"), text.latex_to_html(F.col("abstract")).alias("abstract"))


# changes to tables


@query("SELECT paper_id FROM papers ANTI JOIN emb USING (paper_id)", "papers", "emb")
def missing_embedding_anti(c, spark, sf_dir):
    return tables.missing(c.papers, c.embeddings, "paper_id").select("paper_id")


@query("SELECT paper_id FROM papers WHERE NOT EXISTS (SELECT 1 FROM citations WHERE cited_id = paper_id)", "papers", "citations")
def missing_citation_anti(c, spark, sf_dir):
    return tables.missing(c.papers, c.citations, "cited_id").select("paper_id")


@query("SELECT arxiv_id, title FROM papers WHERE paper_id % 2 = 0 UNION ALL SELECT arxiv_id, 'new ' || title FROM papers WHERE paper_id % 2 = 1", "papers")
def insert_if_absent(c, spark, sf_dir):
    here = c.papers.filter("paper_id % 2 = 0").select("arxiv_id", "title")
    incoming = c.papers.select("arxiv_id", F.concat(F.lit("new "), "title").alias("title"))
    return tables.inserted(incoming.union(incoming), here, "papers")


@query("SELECT arxiv_id, CASE WHEN paper_id % 3 = 0 THEN 'new ' || title ELSE title END AS title FROM papers", "papers")
def upsert_papers(c, spark, sf_dir):
    incoming = c.papers.filter("paper_id % 3 = 0").select("arxiv_id", F.concat(F.lit("new "), "title").alias("title"))
    return tables.upserted(incoming, c.papers.select("arxiv_id", "title"), "papers")


@query("SELECT x.paper_id, a.author_id, x.ord FROM (SELECT paper_id, ord, keyname, forenames FROM paper_author JOIN authors USING (author_id)) x JOIN authors a ON x.keyname = a.keyname AND x.forenames IS NOT DISTINCT FROM a.forenames", "authors", "paper_author")
def author_resolve_nullsafe(c, spark, sf_dir):
    named = c.paper_author.join(c.authors, "author_id").select("paper_id", "ord", "keyname", "forenames")
    return named.join(c.authors, tables.same(named, c.authors, ("keyname", "forenames"))).select("paper_id", "author_id", "ord")


@query("SELECT paper_id, unnest(range(len(string_split(trim(title), ' ')))) AS ord, unnest(string_split(trim(title), ' ')) AS keyname FROM papers", "papers")
def posexplode_authors(c, spark, sf_dir):
    placed = c.papers.select("paper_id", F.posexplode(F.split(F.trim("title"), " ")).alias("ord", "keyname"))
    return placed.select("paper_id", F.col("ord").cast("long").alias("ord"), "keyname")


@query("SELECT citing_id, cited_id FROM citations", "citations")
def citation_edges(c, spark, sf_dir):
    found = c.citations.join(c.papers.select(F.col("paper_id").alias("citing_id"), "arxiv_id"), "citing_id").join(c.papers.select(F.col("paper_id").alias("cited_id"), F.col("arxiv_id").alias("cited_arxiv_id")), "cited_id")
    nothing = model.Corpus(c.papers, c.authors, c.paper_author, c.citations.limit(0), c.tags, c.tagged_papers, c.embeddings)
    return ingest.cited(found.select("cited_arxiv_id", "arxiv_id"), nothing, AS_OF).select("citing_id", "cited_id")


@query(f"SELECT tag_id, CASE WHEN tag_id = {TAG} THEN 'to read' ELSE name END AS name FROM tags", "tags")
def rename_tag(c, spark, sf_dir):
    return tables.renamed(c.tags, TAG, "to read", AS_OF).select("tag_id", "name")


@query(f"SELECT tag_id, -1::BIGINT AS paper_id FROM tags WHERE tag_id <> {TAG} UNION ALL SELECT tag_id, paper_id FROM tagged_papers WHERE tag_id <> {TAG}", "tags", "tagged_papers")
def delete_tag_cascade(c, spark, sf_dir):
    tags, tagged = tables.without_tag(c, TAG)
    return tags.select("tag_id", F.lit(-1).cast("long").alias("paper_id")).union(tagged.select("tag_id", "paper_id"))


@query(f"SELECT tag_id, paper_id FROM tagged_papers WHERE NOT (tag_id = {TAG} AND paper_id = (SELECT min(paper_id) FROM tagged_papers WHERE tag_id = {TAG}))", "tagged_papers")
def remove_from_tag(c, spark, sf_dir):
    first = c.tagged_papers.filter(F.col("tag_id") == TAG).agg(F.min("paper_id")).first()[0]
    if first is None:
        return c.tagged_papers.select("tag_id", "paper_id")
    return tables.remove_from_tag(c, USER, TAG, first).select("tag_id", "paper_id")


@query("SELECT 'authors' AS name, count(*) AS n FROM (SELECT 1 FROM authors GROUP BY keyname, forenames HAVING count(*) > 1) UNION ALL SELECT 'lineitem', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)", "authors")
def unique_violations(c, spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("tag_id"), F.col("l_linenumber").alias("paper_id"))
    count = lambda df, name, table: tables.violations(df, table).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count(c.authors, "authors", "authors").union(count(lines, "lineitem", "tagged_papers"))


@query("SELECT max(created) AS created, max(coalesce(updated, created)) AS changed FROM papers", "papers")
def high_water_mark(c, spark, sf_dir):
    return ingest.high_water_mark(c.papers)


@query("SELECT paper_id, (row_number() OVER (ORDER BY paper_id) - 1) // 128 AS chunk FROM papers ANTI JOIN emb USING (paper_id)", "papers", "emb")
def id_chunks(c, spark, sf_dir):
    return ingest.batches(tables.missing(c.papers, c.embeddings, "paper_id"), 128)


@query("SELECT event_type AS date_filter, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS least, max(value) AS greatest, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM events GROUP BY event_type")
def latency_stats(c, spark, sf_dir):
    measured = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("date_filter"), F.col("value").alias("ms"))
    s = latency.statistics(measured)
    return s.select("date_filter", rounded("mean"), rounded("median"), "least", "greatest", rounded("deviation"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_source(c, spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT arxiv_id, CASE WHEN paper_id % 2 = 0 THEN 'Ada Byron' ELSE 'Noname' END AS author, created::DATE::VARCHAR AS created FROM papers", "papers")
def xml_records(c, spark, sf_dir):
    author = F.when(F.col("paper_id") % 2 == 0, F.lit("<author><keyname>Byron</keyname><forenames>Ada</forenames></author>")).otherwise(F.lit("<author><keyname>Noname</keyname></author>"))
    body = F.concat(F.lit("<record><metadata><arXiv><id>"), "arxiv_id", F.lit("</id><created>"), F.date_format("created", "yyyy-MM-dd"), F.lit("</created><categories>a b</categories><authors>"), author, F.lit("</authors></arXiv></metadata></record>"))
    parsed = c.papers.select(F.from_xml(body, harvest.RECORD).alias("r")).select("r.metadata.arXiv.*")
    first = F.col("authors")[0]
    return harvest.shaped(parsed).select("arxiv_id", text.author_name(first["keyname"], first["forenames"]).alias("author"), F.date_format("created", "yyyy-MM-dd").alias("created"))


@query()
def embedding_backfill(c, spark, sf_dir):
    made = ingest.embedded(c.papers, c.embeddings, ingest.stub_model(DIMS), calls_per_second=1e6)
    return ingest.derived(made, 32, DIMS).select("paper_id", F.size("short_vector").alias("dims"), F.element_at("bits", 1).alias("bits"))


@query(f", {TOKENS} SELECT paper_id, lexeme, pos, weight FROM tok", "papers")
def fts_refreshed(c, spark, sf_dir):
    """Postings of older texts, refreshed for the papers that have changed since."""
    older = c.papers.withColumn("abstract", F.when(F.col("paper_id") % 3 == 0, F.lit("an older text")).otherwise(F.col("abstract")))
    return fulltext.refreshed(fulltext.postings(older), c.papers.filter("paper_id % 3 = 0"))


@query("SELECT paper_id, coalesce(updated, created) AS updated FROM papers", "papers")
def backfill_nulls(c, spark, sf_dir):
    return tables.backfilled(c.papers, "updated", F.col("created")).select("paper_id", "updated")


@query("SELECT paper_id FROM papers WHERE updated IS NULL", "papers")
def without_value(c, spark, sf_dir):
    return tables.without_value(c.papers, "updated").select("paper_id")


@query("SELECT count(*) AS n FROM papers WHERE paper_id % 2 = 1", "papers")
def inserted_count(c, spark, sf_dir):
    return tables.inserted_count(c.papers.union(c.papers), c.papers.filter("paper_id % 2 = 0"), "papers")


@query("SELECT tag_id, user_id || ' - ' || name AS label FROM tags", "tags")
def tag_labels(c, spark, sf_dir):
    return c.tags.select("tag_id", text.tag_label(F.col("user_id").cast("string"), F.col("name")).alias("label"))


@query(
    f"""SELECT tag_id, paper_id FROM tagged_papers UNION SELECT {TAG}, paper_id FROM (SELECT max(doc_id) AS paper_id FROM documents)""",
    "tagged_papers",
)
def add_to_tag(c, spark, sf_dir):
    last = c.papers.agg(F.max("paper_id")).first()[0]
    _, tagged = tables.add_to_tag(c, USER, last, AS_OF, tag_id=TAG)
    return tagged.select("tag_id", "paper_id")


@query(
    f""", {NAMED}, mine AS (SELECT paper_id, string_agg(name, ',' ORDER BY added_at DESC, tag_id DESC) AS tags FROM tagged_papers JOIN tags USING (tag_id) WHERE user_id = {USER} GROUP BY paper_id)
SELECT paper_id, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' et al.' ELSE '' END AS authors, tags, strftime(created, '%b %Y') AS month FROM papers LEFT JOIN named USING (paper_id) LEFT JOIN mine USING (paper_id)""",
    "papers", "authors", "paper_author", "tags", "tagged_papers",
)
def result_cards(c, spark, sf_dir):
    shown = pages.cards(c.papers, c, USER)
    return shown.select("paper_id", F.col("authors_shown").alias("authors"), F.array_join("tags", ",").alias("tags"), "month")


@query("SELECT arxiv_id, keyname, forenames FROM papers JOIN paper_author USING (paper_id) JOIN authors USING (author_id) WHERE paper_id % 2 = 1", "papers", "authors", "paper_author")
def harvest_authors(c, spark, sf_dir):
    """Records of half of the papers, harvested into a corpus that lacks them: new papers, authors, and their bridge."""
    named = c.paper_author.join(c.authors, "author_id").groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("ord", "author_id", "keyname", "forenames"))).alias("x"))
    some = c.papers.filter("paper_id % 2 = 1").join(named, "paper_id")
    records = some.select("arxiv_id", "created", "updated", "title", "abstract", "categories", F.transform("x", lambda a: F.struct(a["keyname"].alias("keyname"), a["forenames"].alias("forenames"))).alias("authors"))
    nothing = dataclasses.replace(c, papers=c.papers.filter("paper_id % 2 = 0"), authors=c.authors.filter("author_id % 2 = 0"), paper_author=c.paper_author.limit(0))
    out = ingest.harvested(records, nothing)
    return out.paper_author.join(out.papers, "paper_id").join(out.authors, "author_id").select("arxiv_id", "keyname", "forenames")
