"""What a page of results or a paper's page shows: authors, tags, categories, details, a tag's drawer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.functions import text
from paperlode.sources.corpus import Corpus


def author_lists(page: DataFrame, corpus: Corpus) -> DataFrame:
    """(paper_id, authors): names in order, for the papers of a page only."""
    rows = corpus.paper_author.join(page.select("paper_id"), "paper_id", "left_semi").join(corpus.authors, "author_id")
    named = rows.select("paper_id", F.struct("ord", "author_id", text.author_name(F.col("keyname"), F.col("forenames")).alias("name")).alias("x"))
    return named.groupBy("paper_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["name"]).alias("authors"))


def first_authors(authors: Column, most: int = 3) -> Column:
    """The first names, comma-joined, and "et al." if there are more."""
    return F.when(F.size(authors) > most, F.concat(F.array_join(F.slice(authors, 1, most), ", "), F.lit(" et al."))).otherwise(F.array_join(authors, ", "))


def tag_lists(page: DataFrame, corpus: Corpus, user_id: int) -> DataFrame:
    """(paper_id, tags): the user's tags of a page's papers, the latest added first."""
    own = corpus.tags.filter(F.col("user_id") == user_id).select("tag_id", "name")
    rows = corpus.tagged_papers.join(page.select("paper_id"), "paper_id", "left_semi").join(own, "tag_id")
    ordered = F.sort_array(F.collect_list(F.struct("added_at", "tag_id", "name")), asc=False)
    return rows.groupBy("paper_id").agg(F.transform(ordered, lambda x: x["name"]).alias("tags"))


def categories(page: DataFrame) -> DataFrame:
    """The categories of a page's papers, sorted."""
    return page.select(F.explode("categories").alias("category")).filter("category IS NOT NULL").distinct().orderBy("category")


def tag_sizes(corpus: Corpus, user_id: int) -> DataFrame:
    """(tag_id, name, n): all tags of a user, empty ones too, by name."""
    own = corpus.tags.filter(F.col("user_id") == user_id)
    return own.join(corpus.tagged_papers, "tag_id", "left").groupBy("tag_id", "name").agg(F.count("paper_id").alias("n")).orderBy("name")


ORDERS = {
    "alpha": lambda: (F.col("title").asc(), F.col("paper_id")),
    "submitted": lambda: (F.col("created").desc(), F.col("paper_id")),
    "updated": lambda: (F.col("updated").desc_nulls_first(), F.col("paper_id")),
    "added": lambda: (F.col("added_at").desc(), F.col("paper_id")),
}


def drawer(corpus: Corpus, tag_id: int, sort: str = "added") -> DataFrame:
    """(paper_id, arxiv_id, title, short_title, created, updated, added_at) of a tag's papers, in one of four orders."""
    rows = corpus.tagged_papers.filter(F.col("tag_id") == tag_id).select("paper_id", "added_at").join(corpus.papers, "paper_id")
    shown = rows.select("paper_id", "arxiv_id", "title", text.shortened(text.latex_to_html(F.col("title")), 60).alias("short_title"), "created", "updated", "added_at")
    return shown.orderBy(*ORDERS.get(sort, ORDERS["added"])())


def detail(corpus: Corpus, paper_id: int, user_id: int | None = None) -> DataFrame:
    """One row about a paper; no rows if there is none."""
    one = corpus.papers.filter(F.col("paper_id") == paper_id)
    has = corpus.embeddings.select("paper_id").distinct().withColumn("has_embedding", F.lit(True))
    out = one.join(author_lists(one, corpus), "paper_id", "left").join(has, "paper_id", "left")
    if user_id is not None:
        out = out.join(tag_lists(one, corpus, user_id), "paper_id", "left")
    else:
        out = out.withColumn("tags", F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    return out.select("paper_id", "arxiv_id", "title", F.coalesce("authors", empty).alias("authors"), "created", "updated", "categories", "abstract", F.coalesce("has_embedding", F.lit(False)).alias("has_embedding"), F.coalesce("tags", empty).alias("tags"))


def cards(page: DataFrame, corpus: Corpus, user_id: int | None = None) -> DataFrame:
    """A page's rows with authors, tags and texts to show."""
    out = page.join(author_lists(page, corpus), "paper_id", "left")
    out = out.join(tag_lists(page, corpus, user_id), "paper_id", "left") if user_id is not None else out.withColumn("tags", F.lit(None).cast("array<string>"))
    return out.withColumns({"authors_shown": first_authors(F.col("authors")), "processed_title": text.latex_to_html(F.col("title")), "processed_abstract": text.latex_to_html(F.col("abstract")), "month": text.month(F.col("created"))})
