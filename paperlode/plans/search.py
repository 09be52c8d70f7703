"""Search: a request is parsed, its mode chosen, and one plan for its page is made."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlode.functions import fulltext
from paperlode.operators import knn
from paperlode.operators.candidates import candidates
from paperlode.sources.corpus import Corpus

PAGE, MOST_RESULTS, MOST_SHOWN = 20, 400, 1000


@dataclass
class SearchRequest:
    q: str = ""
    date_filter: str = ""
    category: str = ""
    single_paper: str = ""
    search_all: str = ""
    tag: int | None = None  # the tag whose drawer is open
    sort: str = "added"
    exclude_ids: set[int] = field(default_factory=set)


@dataclass
class SearchResult:
    papers: DataFrame
    has_more: bool
    kind: str | None = None
    error: str | None = None


def request(params: dict, ajax: bool = False) -> SearchRequest:
    """Of a query string's parameters, or of the body of a request for more results."""
    own = dict(params.get("query_params") or {}) if ajax else dict(params)
    shown = {int(i) for i in params.get("exclude_ids") or ()} if ajax else set()
    tag = own.get("tag")
    text = lambda k: (own.get(k) or "").strip() if k == "q" else own.get(k) or ""
    return SearchRequest(text("q"), text("date_filter"), text("category"), text("single_paper"), text("search_all"), int(tag) if tag and str(tag).isdigit() else None, own.get("sort") or "added", shown)


def prefixed(q: str) -> tuple[str, str]:
    """(mode, rest): exactly one white-space character follows a prefix; a tag's name isn't stripped."""
    if m := re.match(r"(tag|paper|title):\s(.+)$", q):
        return m[1], m[2] if m[1] == "tag" else m[2].strip()
    return "keyword", q


def resolved(papers: DataFrame, ref: str) -> int | None:
    """A paper's id of an internal id or else an arXiv id."""
    if re.fullmatch(r"\s*[+-]?\d+\s*", ref) and not (hit := papers.filter(F.col("paper_id") == int(ref)).select("paper_id").limit(1)).isEmpty():
        return hit.first()[0]
    row = papers.filter(F.col("arxiv_id") == ref).select("paper_id").first()
    return row[0] if row else None


def newest(papers: DataFrame) -> DataFrame:
    return papers.orderBy(F.desc("created"), "paper_id").limit(PAGE)


def title_search(query: str, cand: DataFrame) -> DataFrame:
    return newest(cand.filter(F.upper("title").contains(query.upper())))


def keyword_search(query: str, cand: DataFrame, postings: DataFrame, mode: str = "simple") -> DataFrame:
    """The page by rank, then date; each row with its rank. The ranks are of the matching candidates only."""
    terms, phrases = fulltext.lexemes(fulltext.parse(query), mode)
    if not terms and not phrases:
        return cand.withColumn("rank", F.lit(None).cast("double")).limit(0)
    hits = fulltext.matching(postings, terms, phrases)
    ranked = fulltext.rank(postings, terms, phrases).join(hits, "paper_id", "left_semi")
    return cand.join(ranked, "paper_id").orderBy(F.desc("rank"), F.desc("created"), "paper_id").limit(PAGE)


def paper_search(corpus: Corpus, paper_id: int, cand: DataFrame, metric: str = "hamming", dims: int = 64) -> DataFrame:
    """The nearest papers; their other columns are joined to the page only."""
    page = knn.knn(corpus.embeddings, cand.filter(F.col("paper_id") != paper_id), paper_id, PAGE, metric, dims)
    return page.join(corpus.papers, "paper_id").orderBy("distance", "paper_id")


def shuffled_sources(corpus: Corpus, tag_id: int, seed: int) -> DataFrame:
    """(src_ord, paper_id): a tag's papers in an order that the seed gives. The window holds one tag's papers."""
    own = corpus.tagged_papers.filter(F.col("tag_id") == tag_id).select("paper_id").distinct()
    mixed = F.md5(F.concat(F.col("paper_id").cast("string"), F.lit(f":{seed}")))
    return own.withColumn("src_ord", F.row_number().over(Window.orderBy(mixed, "paper_id")))


def tag_search(corpus: Corpus, tag_id: int, cand: DataFrame, seed: int = 0, exclude_sources: bool = False, metric: str = "hamming", dims: int = 64, k_override: int | None = None) -> DataFrame:
    """(place, paper_id, src_ord, distance, ...): may exceed a page, and has the tag's own papers unless excluded.

    k_override: neighbours of each source, where a caller wants more than the page's share.
    """
    sources = shuffled_sources(corpus, tag_id, seed)
    n = sources.count()
    if exclude_sources:
        cand = cand.join(sources.select("paper_id"), "paper_id", "left_anti")
    found = knn.first_found(corpus.embeddings, cand, sources, n, k_override or knn.share(n), metric, dims)
    return knn.interleaved(found).join(corpus.papers, "paper_id").orderBy("place")


def search(corpus: Corpus, req: SearchRequest, as_of: datetime, user_id: int | None = None, seed: int = 0, postings: DataFrame | None = None, mode: str = "simple", dims: int = 64) -> SearchResult:
    """Precedence: an error, one paper, a tag, a title, keywords, nothing."""
    nothing = lambda error=None: SearchResult(corpus.papers.limit(0), False, None, error)
    kind, rest = prefixed(req.q.strip()) if req.q.strip() else ("", "")
    tag_id, paper_ref = None, req.single_paper
    if kind == "tag":
        if user_id is None:
            return nothing("a search by tag needs a user")
        row = corpus.tags.filter((F.col("user_id") == user_id) & (F.col("name") == rest)).first()
        if row is None:
            return nothing(f"there is no tag '{rest}'")
        tag_id = row.tag_id
    elif kind == "paper":
        row = corpus.papers.filter(F.col("arxiv_id") == rest).select("paper_id").first()
        if row is None:
            return nothing(f"there is no paper '{rest}'")
        paper_ref = str(row[0])
    drawer = None
    if req.tag is not None and user_id is not None and not corpus.tags.filter((F.col("user_id") == user_id) & (F.col("tag_id") == req.tag)).isEmpty():
        drawer = corpus.tagged_papers.filter(F.col("tag_id") == req.tag)
    current = resolved(corpus.papers, paper_ref) if paper_ref else None
    if paper_ref and current is None:
        return nothing(f"there is no paper '{paper_ref}'")
    cand = candidates(corpus.papers, as_of, req.date_filter, req.category, req.exclude_ids, drawer, current)
    if paper_ref:
        kind, page = "paper", paper_search(corpus, current, cand, dims=dims)
    elif tag_id is not None:
        page = tag_search(corpus, tag_id, cand, seed, dims=dims)
    elif kind == "title" and rest:
        page = title_search(rest, cand)
    elif kind in ("keyword", "title") and req.q.strip():
        kind, page = "keyword", keyword_search(req.q.strip(), cand, postings if postings is not None else fulltext.postings(cand, mode), mode)
    else:
        return nothing()
    # the drawer's papers and the current one count as excluded, once each
    extra = {current} - {None}
    n_excluded = len(req.exclude_ids | extra) if drawer is None else drawer.select("paper_id").union(corpus.papers.sparkSession.createDataFrame([(i,) for i in req.exclude_ids | extra], "paper_id long")).distinct().count()
    return SearchResult(page, n_excluded + PAGE < MOST_RESULTS and not page.isEmpty(), kind)


def more(req: SearchRequest, shown: list[int]) -> SearchRequest:
    """The request for the next page: what has been shown is excluded, up to what a client keeps."""
    ids = req.exclude_ids | set(shown)
    if len(ids) > MOST_SHOWN:
        raise ValueError(f"a client shows at most {MOST_SHOWN} papers")
    return SearchRequest(req.q, req.date_filter, req.category, req.single_paper, req.search_all, req.tag, req.sort, ids)
