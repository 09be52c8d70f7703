"""Golden and property tests of the paper search engine."""

import random
import re
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paperlode.functions import fulltext, text, vectors
from paperlode.functions.stemmer import stem
from paperlode.operators import ingest, knn, latency, pages, tables
from paperlode.operators.candidates import candidates, date_cutoff
from paperlode.plans import registry, search
from paperlode.settings import Settings
from paperlode.sources import corpus as model
from paperlode.sources import harvest

AS_OF = datetime(2026, 3, 10)


@pytest.fixture(scope="module")
def corpus(spark):
    return model.from_test_tables(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize(
    ("q", "expected"),
    [
        ("latent attention", "latent | attention"),
        ('foo "a b c" bar', "foo | bar | (a <-> b <-> c)"),
        ('foo"a b"bar', "foobar | (a <-> b)"),
        ('"a" x', "x | (a)"),
        ('" "', ""),
        ("a & b", "a | & | b"),
        ('""', '""'),
    ],
)
def test_query_text(q, expected):
    assert fulltext.parse(q).text() == expected


@pytest.mark.parametrize(
    ("q", "expected"),
    [("tag: x", ("tag", "x")), ("tag:\tx", ("tag", "x")), ("tag:  x", ("tag", " x")), ("tag:x", ("keyword", "tag:x")), ("Tag: x", ("keyword", "Tag: x")), ("paper: 2301.1", ("paper", "2301.1")), ("title:  a b ", ("title", "a b"))],
)
def test_prefixes(q, expected):
    assert search.prefixed(q) == expected


def test_operators_are_rejected():
    with pytest.raises(fulltext.QueryError):
        fulltext.lexemes(fulltext.parse("a & b"), "simple")
    assert fulltext.lexemes(fulltext.parse("Foo:* bar"), "simple") == ([("foo", True), ("bar", False)], [])


@pytest.mark.parametrize(
    ("word", "expected"),
    {"consigned": "consign", "consistency": "consist", "knightly": "knight", "kneeling": "kneel", "generate": "generat", "communism": "communism", "hopping": "hop", "hoping": "hope", "skies": "sky", "dying": "die", "relational": "relat", "happy": "happi", "says": "say", "cries": "cri", "ties": "tie", "agreed": "agre", "national": "nation", "sensational": "sensat", "networks": "network", "adversarial": "adversari"}.items(),
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_latex(spark):
    df = spark.createDataFrame([("a ` b",)], "s string")
    assert df.select(text.latex_to_html(F.col("s"))).first()[0] == "a ` b"
    assert df.select(text.latex_to_html(F.col("s"), strict_reference=True)).first()[0] == f"a {text.STRAY} b"


def test_scalars(spark):
    row = spark.createDataFrame([("12", "x", " a ", "  ", "2024-02-30")], "n string, m string, f string, e string, d string").select(
        text.whole_number(F.col("n")), text.whole_number(F.col("m")), text.filled(F.col("f")), text.filled(F.col("e")), text.iso_day(F.col("d"))
    ).first()
    assert tuple(row) == (12, None, "a", None, None)


def test_vectors(spark):
    rng = random.Random(1)
    rows = [([rng.uniform(-1, 1) for _ in range(96)], [rng.uniform(-1, 1) for _ in range(96)]) for _ in range(20)] + [([0.0] * 96, [1.0] * 96)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    out = df.select(vectors.hamming(vectors.packed(F.col("a"), 96), vectors.packed(F.col("b"), 96), 96).alias("d"), vectors.truncated(F.col("a"), 8).alias("t"), vectors.l2(F.col("a"), F.col("b")).alias("l")).collect()
    for (a, b), r in zip(rows, out, strict=True):
        assert r.d == sum((x > 0) != (y > 0) for x, y in zip(a, b, strict=True))
        assert abs(r.l - sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5) < 1e-5
        norm = sum(x * x for x in a[:8]) ** 0.5
        assert all(abs(x - (y / norm if norm else y)) < 1e-6 for x, y in zip(r.t, a[:8], strict=True))


def test_dates():
    assert date_cutoff("1week", AS_OF) == datetime(2026, 3, 3)
    assert date_cutoff("all", AS_OF) is None and date_cutoff("soon", AS_OF) is None


def simulated(found, n, page=20):
    """Tag search as one source after another."""
    groups, seen, count = [], set(), 0
    for source in range(1, n + 1):
        new = [p for p in found.get(source, []) if p not in seen]
        seen.update(new)
        count += len(new)
        if new:
            groups.append(new)
        if count >= page:
            break
    return [g[i] for i in range(max(map(len, groups), default=0)) for g in groups if i < len(g)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_interleaving(spark, n):
    rng = random.Random(n)
    k = knn.share(n)
    found = {s: rng.sample(range(60), k) for s in range(1, n + 1) if rng.random() < 0.9}
    rows = [(s, i, p, i) for s, ps in found.items() for i, p in enumerate(ps, 1)]
    df = spark.createDataFrame(rows, "src_ord int, rk int, paper_id long, distance long")
    assert [r.paper_id for r in knn.interleaved(df).orderBy("place").collect()] == simulated(found, n)


def test_shares():
    assert [knn.share(n) for n in (1, 2, 3, 4, 5, 6, 7, 10, 11, 50)] == [21, 11, 7, 6, 5, 4, 3, 3, 2, 2]


def test_dispatch(spark, corpus):
    go = lambda **k: search.search(corpus, search.SearchRequest(date_filter="all", **k), AS_OF, user_id=5)
    assert go(q="").kind is None
    assert go(q="tag: nothing").error and go(q="paper: nothing").error
    assert go(q="paper: arx.000003").kind == "paper" and go(single_paper="3").kind == "paper"
    assert go(q="title: the").kind == "title"
    hit = go(q="license the")
    assert hit.kind == "keyword" and hit.papers.count() == 20 and hit.has_more
    assert not go(q="license the", exclude_ids=set(range(1000, 1380))).has_more
    assert search.search(corpus, search.SearchRequest(q="tag: view"), AS_OF).error


def test_pagination(corpus):
    req = search.request({"query_params": {"q": " title: the ", "date_filter": "all"}, "exclude_ids": ["1"]}, ajax=True)
    first = [r.paper_id for r in search.search(corpus, req, AS_OF).papers.collect()]
    second = [r.paper_id for r in search.search(corpus, search.more(req, first), AS_OF).papers.collect()]
    assert 1 not in first and not set(first) & set(second)


def test_candidates_with_many_exclusions(corpus):
    assert candidates(corpus.papers, AS_OF, "all", exclude=set(range(5, 5000))).count() == 5


XML = """<OAI-PMH><ListRecords>
<record><metadata><arXiv><id>a1</id><created>2024-01-02</created><updated>2024-02-03</updated><title>T1</title><abstract>A</abstract><categories>cs.AI cs.LG</categories>
<authors><author><keyname>Byron</keyname><forenames>Ada</forenames></author><author><keyname>Solo</keyname></author></authors></arXiv></metadata></record>
<record><metadata><arXiv><id>a2</id><created>2024-01-03</created><title>T2</title><abstract>B</abstract><categories>cs.AI</categories>
<authors><author><keyname>Solo</keyname></author></authors></arXiv></metadata></record>
<record><header status="deleted"/></record><resumptionToken>{}</resumptionToken></ListRecords></OAI-PMH>"""


def empty(spark):
    return model.Corpus(**{n: spark.createDataFrame([], s) for n, s in model.SCHEMAS.items()})


def test_harvest(spark, tmp_path):
    asked = []

    def fetch(url):
        asked.append(url)
        return XML.format("next" if len(asked) == 1 else "  ")

    assert harvest.land(harvest.pages(fetch, "http://x", date(2024, 2, 5)), str(tmp_path / "in")) == 2
    assert asked == ["http://x?verb=ListRecords&metadataPrefix=arXiv", "http://x?verb=ListRecords&resumptionToken=next"]
    once = ingest.harvested(harvest.records(spark, str(tmp_path / "in")), empty(spark))
    again = ingest.harvested(harvest.records(spark, str(tmp_path / "in")), once)
    for c in (once, again):
        assert [(r.arxiv_id, r.categories) for r in c.papers.orderBy("arxiv_id").collect()] == [("a1", ["cs.AI", "cs.LG"]), ("a2", ["cs.AI"])]
        assert c.authors.count() == 2 and c.paper_author.count() == 3
    lists = {r.paper_id: r.authors for r in pages.author_lists(once.papers, once).collect()}
    assert sorted(lists.values()) == [["Ada Byron", "Solo"], ["Solo"]]
    assert ingest.high_water_mark(empty(spark).papers).first().created is None
    spark.dataSource.register(harvest.LandedPages)
    assert spark.read.format("oai_pages").load(str(tmp_path / "in")).count() == 2


def test_restart():
    asked = []

    def fetch(url):
        asked.append(url)
        return XML.format("")

    list(harvest.pages(fetch, "http://x", date(2025, 1, 1)))
    assert asked[1:] == ["http://x?verb=ListRecords&metadataPrefix=arXiv&from=2024-02-03"]


def test_stream(spark, tmp_path):
    from paperlode.streaming.harvest import harvest as stream
    from paperlode.streaming.harvest import record_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.xml").write_text(XML.format(""))
    state = [empty(spark)]

    def store(c):
        rows = {n: (getattr(c, n).collect(), s) for n, s in model.SCHEMAS.items()}
        state[0] = model.Corpus(**{n: spark.createDataFrame(r, s) for n, (r, s) in rows.items()})

    stream(record_stream(spark, str(tmp_path / "in")), lambda: state[0], store, str(tmp_path / "checkpoint")).awaitTermination()
    assert state[0].papers.count() == 2


def test_citations(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"arxiv_id":"a1","status":200,"data":[{"citingPaper":{"paperId":"p","externalIds":{"ArXiv":"a2"}}},{"citingPaper":{"paperId":"q","externalIds":null}},{"citingPaper":{"paperId":"r","externalIds":{"ArXiv":"zz"}}}]}\n{"arxiv_id":"a2","status":404,"data":[{"citingPaper":{"paperId":"p","externalIds":{"ArXiv":"a1"}}}]}\n')
    found = harvest.citing_ids(spark, str(tmp_path / "c.json"))
    base = empty(spark)
    papers = spark.createDataFrame([(1, "a1"), (2, "a2")], "paper_id long, arxiv_id string")
    c = model.Corpus(papers, base.authors, base.paper_author, base.citations, base.tags, base.tagged_papers, base.embeddings)
    assert [(r.citing_id, r.cited_id) for r in ingest.cited(found, c, AS_OF).collect()] == [(2, 1)]
    assert [r[0] for r in ingest.unknown_citing(found, papers).collect()] == ["zz"]


def test_tags(spark, corpus):
    tags, tagged = tables.add_to_tag(corpus, 5, 1, AS_OF, tag_name=" mine ")
    assert tags.filter("name = 'mine' AND user_id = 5").count() == 1 and tagged.count() == corpus.tagged_papers.count() + 1
    some = corpus.tags.filter("user_id = 5").first()
    with pytest.raises(tables.Refused):
        tables.rename_tag(corpus, 5, some.tag_id, "  ", AS_OF)
    with pytest.raises(tables.Refused):
        tables.delete_tag(corpus, 6, some.tag_id)
    assert tables.rename_tag(corpus, 5, some.tag_id, "other", AS_OF).filter("name = 'other'").count() == 1
    assert tables.delete_tag(corpus, 5, some.tag_id)[1].filter(F.col("tag_id") == some.tag_id).isEmpty()
    users = spark.createDataFrame([(1, "a@x", "a@x")], "user_id long, username string, email string")
    assert tables.user_of(tables.user_of(users, "B@x"), " b@X ").count() == 2


def test_backfill(spark, corpus):
    few = corpus.papers.limit(30)
    calls = []

    def failing(texts):
        raise RuntimeError("no service")

    none = corpus.embeddings.limit(0)
    assert ingest.embedded(few, none, failing, calls_per_second=1e6).count() == 0 and not calls
    made = ingest.embedded(few, none, ingest.stub_model(64), batch=4, calls_per_second=1e6)
    assert made.count() == 30 and ingest.embedded(few, made, ingest.stub_model(64), calls_per_second=1e6).count() == 0


def test_rate():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    r = harvest.RateLimiter(2, lambda: now[0], sleep)
    for _ in range(3):
        r.acquire()
    assert slept == [0.5, 0.5]


def test_latency(corpus):
    s = latency.statistics(latency.trials(corpus, AS_OF, paper_id=0, n_trials=1, k=5))
    assert s.count() == 9 and s.filter("deviation = 0").count() == 9


def test_deletion(corpus):
    c = tables.without_paper(corpus, 3)
    assert c.citations.filter("citing_id = 3 OR cited_id = 3").isEmpty() and c.paper_author.filter("paper_id = 3").isEmpty()


LATEX = {
    r"\textbf{a} and \textit{b} \emph{c} \texttt{d} \underline{e}": "<strong>a</strong> and <em>b</em> <em>c</em> <code>d</code> <u>e</u>",
    r"see \url{http://x.org/a_b}": 'see <a href="http://x.org/a_b" target="_blank">http://x.org/a_b</a>',
    r"\href{https://x.org}{here} it is": '<a href="https://x.org" target="_blank">here</a> it is',
    "code at https://x.org/a.": 'code at <a href="https://x.org/a" target="_blank">https://x.org/a</a>.',
    "http://x.org/a>b https://y.org": 'http://x.org/a>b <a href="https://y.org" target="_blank">https://y.org</a>',
    r"50\% of R\&D \$5 \#1 a\_b \{x\}": "50% of R&D $5 #1 a_b {x}",
    "``quoted'' it's a ` tick": "\"quoted\" it's a ` tick",
    r"a\,b~c \~d \^e": "a b&nbsp;c &nbsp;d ^e",
    r"x\textbackslash{}y \\ z": r"x\y <br> z",
}


def test_latex(spark, corpus):
    df = spark.createDataFrame([(k, v) for k, v in LATEX.items()], "source string, html string")
    assert df.select("html", text.latex_to_html(F.col("source")).alias("own")).filter("html <> own").collect() == []
    for r in registry.QUERIES["latex_to_html"](spark, "/root/testdata/sf0.001").join(corpus.papers.select("paper_id", F.col("title").alias("t"), F.col("abstract").alias("a")), "paper_id").collect():
        for own, raw in ((r.title, r.t), (r.abstract, r.a)):
            # the papers have no commands and no addresses, so what is left are quotes, escapes and ties
            assert own == re.sub(r"\\([%&$#_{}])", r"\1", raw).replace("``", '"').replace("''", '"').replace("~", "&nbsp;")


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    out = tables.numbered(df, "n", ("x",)).collect()
    assert sorted(r.n for r in out) == [*range(1000)] and all(r.n == r.x for r in out)
    assert tables.numbered(df.limit(0), "n", ("x",)).count() == 0


def test_sources_are_visited_until_the_page_is_full(spark, corpus, monkeypatch):
    sources = search.shuffled_sources(corpus, 52, 7)
    n = sources.count()
    whole = knn.interleaved(knn.per_source(corpus.embeddings, corpus.papers, sources, 3)).collect()
    monkeypatch.setattr(knn, "CHUNK", 2)
    part = knn.interleaved(knn.first_found(corpus.embeddings, corpus.papers, sources, n, 3)).collect()
    assert [(r.place, r.paper_id) for r in sorted(part)] == [(r.place, r.paper_id) for r in sorted(whole)]
    empty = knn.first_found(corpus.embeddings, corpus.papers, sources.limit(0), 0, 3)
    assert empty.count() == 0


def test_stored_index_is_read(spark):
    """Postings are read by lexeme, and bits as they are stored."""
    folder = "/root/testdata/sf0.001"
    plan = registry.QUERIES["fts_match_terms"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "lexeme" in plan and "PushedFilters: [Or(In(lexeme" in plan
    plan = registry.QUERIES["hamming_topk"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "bits" in plan


def test_settings():
    own = Settings.from_environment({"PAPERLODE_TABLES": "/t", "PAPERLODE_KEY_VOYAGE": "k", "OTHER": "x"})
    assert own.tables == "/t" and dict(own.keys) == {"voyage": "k"} and Settings.from_environment({}) == Settings()


@pytest.mark.parametrize("name", [*registry.ORACLE])
def test_oracle(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "events", "lineitem", "orders", "customer", "part", "supplier", "nation", "region", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    own = registry.QUERIES[name](spark, folder)
    columns = sorted(own.columns)
    rows = con.sql(registry.ORACLE[name]).select(", ".join(columns)).fetchall()
    assert sorted(map(str, map(tuple, own.select(*columns).collect()))) == sorted(map(str, rows))


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
