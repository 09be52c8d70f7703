"""The corpus's tables, with their keys, and their mapping onto the driver's test tables.

A table is a lazy DataFrame; column pruning and filters reach the Parquet scan below it. Timestamps stay TIMESTAMP_NTZ
(UTC) from end to end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unique keys; NULL equals NULL in them.
KEYS = {
    "papers": ("arxiv_id",),
    "authors": ("keyname", "forenames"),
    "paper_author": ("paper_id", "author_id", "ord"),
    "citations": ("citing_id", "cited_id"),
    "tags": ("user_id", "name"),
    "tagged_papers": ("tag_id", "paper_id"),
    "embeddings": ("paper_id",),
}
#: A longer value is refused at ingestion.
LENGTHS = {"arxiv_id": 50, "keyname": 200, "forenames": 200, "name": 100}
SCHEMAS = {
    "papers": "paper_id long, arxiv_id string, created timestamp_ntz, title string, abstract string, categories array<string>, updated timestamp_ntz",
    "authors": "author_id long, keyname string, forenames string",
    "paper_author": "paper_id long, author_id long, ord int",
    "citations": "citing_id long, cited_id long, created_at timestamp_ntz",
    "tags": "tag_id long, user_id long, name string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "tagged_papers": "tag_id long, paper_id long, added_at timestamp_ntz",
    "embeddings": "paper_id long, vector array<float>",
}


@dataclass(frozen=True)
class Corpus:
    papers: DataFrame
    authors: DataFrame
    paper_author: DataFrame
    citations: DataFrame
    tags: DataFrame
    tagged_papers: DataFrame
    embeddings: DataFrame


def stored(spark: SparkSession, folder: str) -> Corpus:
    """A corpus whose tables are Parquet directories of a folder."""
    return Corpus(**{n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in SCHEMAS.items()})


def from_test_tables(spark: SparkSession, sf_dir: str) -> Corpus:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs, events = read("documents"), read("events")
    first_day, days = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), lambda n: F.expr(f"make_dt_interval(CAST({n} AS INT))")
    papers = docs.select(
        F.col("doc_id").alias("paper_id"),
        F.concat(F.lit("arx."), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("arxiv_id"),
        (first_day + days("doc_id % 800")).alias("created"),
        F.split("text", r"[.\n]")[0].alias("title"),
        F.col("text").alias("abstract"),
        F.array("lang", "source").alias("categories"),
        F.when(F.col("doc_id") % 3 != 0, first_day + days("doc_id % 800 + doc_id % 30")).alias("updated"),
    )
    kinds = ("click", "error", "purchase", "signup", "view")
    kind = F.element_at(F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i)))), F.col("event_type"))
    tag_id = (F.col("user_id") * 10 + kind).alias("tag_id")
    tags = events.groupBy("user_id", "event_type").agg(F.min("ts").alias("created_at"))
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    marked = events.crossJoin(F.broadcast(n_docs))  # one row
    tagged = marked.groupBy("user_id", "event_type", (F.col("event_id") % F.col("n_docs")).alias("paper_id")).agg(F.min("ts").alias("added_at"))
    lines = read("lineitem")
    written = lines.join(docs.select(F.col("doc_id").alias("l_orderkey")), "l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").cast("int").alias("ord"))
    cited = lines.select(F.col("l_orderkey").alias("citing_id"), F.col("l_partkey").alias("cited_id")).crossJoin(F.broadcast(n_docs)).filter("citing_id < n_docs AND cited_id < n_docs AND citing_id <> cited_id").drop("n_docs").distinct()
    suppliers = read("supplier").join(F.broadcast(read("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return Corpus(
        papers=papers,
        authors=suppliers.select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("keyname"), F.when(F.col("s_suppkey") % 5 != 0, F.col("n_name")).alias("forenames")),
        paper_author=written.select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id"), "ord"),
        citations=cited.withColumn("created_at", first_day),
        tags=tags.select(tag_id, "user_id", F.col("event_type").alias("name"), "created_at", F.col("created_at").alias("updated_at")),
        tagged_papers=tagged.select(tag_id, "paper_id", "added_at"),
        embeddings=read("embeddings").select(F.col("vec_id").alias("paper_id"), F.col("embedding").alias("vector")),
    )
