"""Ingestion: papers with their authors, citations, embeddings. Each is a set-based, repeatable change."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.functions import vectors
from paperlode.operators import tables
from paperlode.packaging import ship
from paperlode.sources.corpus import LENGTHS, Corpus

#: Bytes of text of a task that calls a model, about; more make more tasks.
TASK_BYTES = 32 << 20
#: A model takes texts and returns a row of numbers for each.
Model = Callable[[list[str]], np.ndarray]


def high_water_mark(papers: DataFrame) -> DataFrame:
    """(created, changed): the latest creation and the latest change; null for an empty table (harvest everything)."""
    return papers.agg(F.max("created").alias("created"), F.max(F.coalesce("updated", "created")).alias("changed"))


def valid(records: DataFrame) -> DataFrame:
    return records.filter((F.length("arxiv_id") <= LENGTHS["arxiv_id"]) & F.forall("authors", lambda a: (F.length(a["keyname"]) <= LENGTHS["keyname"]) & (F.coalesce(F.length(a["forenames"]), F.lit(0)) <= LENGTHS["forenames"])))


def new_records(records: DataFrame, papers: DataFrame) -> DataFrame:
    """The records whose paper is new, once each; papers that are there are never changed."""
    return tables.absent(valid(records), papers.select("arxiv_id"), ("arxiv_id",), ("arxiv_id", "created", "updated", "title"))


def resolved_authors(records: DataFrame, authors: DataFrame) -> DataFrame:
    """The author table with the authors that it lacks, NULL forenames being equal to NULL."""
    named = records.select(F.explode("authors").alias("a")).select("a.keyname", "a.forenames").distinct()
    new = tables.absent(named, authors, ("keyname", "forenames"))
    return authors.unionByName(tables.with_ids(new, authors, "author_id", ("keyname", "forenames")))


def bridge(records: DataFrame, papers: DataFrame, authors: DataFrame) -> DataFrame:
    """(paper_id, author_id, ord) of records whose papers and authors are stored."""
    placed = records.select("arxiv_id", F.posexplode("authors").alias("ord", "a")).select("arxiv_id", "ord", "a.keyname", "a.forenames")
    known = placed.join(authors, tables.same(placed, authors, ("keyname", "forenames"))).select("arxiv_id", "ord", "author_id")
    return known.join(papers.select("arxiv_id", "paper_id"), "arxiv_id").select("paper_id", "author_id", "ord").distinct()


def harvested(records: DataFrame, corpus: Corpus) -> Corpus:
    """The corpus with new papers, their authors and the bridge between them. Running it again changes nothing."""
    new = new_records(records, corpus.papers)
    papers = tables.with_ids(new.select("arxiv_id", "created", "title", "abstract", "categories", "updated"), corpus.papers, "paper_id", ("created", "arxiv_id"))
    papers = corpus.papers.unionByName(papers)
    authors = resolved_authors(new, corpus.authors)
    links = corpus.paper_author.unionByName(bridge(new, papers, authors))
    return Corpus(papers, authors, links, corpus.citations, corpus.tags, corpus.tagged_papers, corpus.embeddings)


def cited(found: DataFrame, corpus: Corpus, as_of: datetime) -> DataFrame:
    """citations with the edges of (cited_arxiv_id, arxiv_id); papers that aren't stored are skipped."""
    citing = corpus.papers.select("arxiv_id", F.col("paper_id").alias("citing_id"))
    target = corpus.papers.select(F.col("arxiv_id").alias("cited_arxiv_id"), F.col("paper_id").alias("cited_id"))
    edges = found.join(citing, "arxiv_id").join(target, "cited_arxiv_id").select("citing_id", "cited_id", F.lit(as_of).cast("timestamp_ntz").alias("created_at"))
    return tables.inserted(edges, corpus.citations, "citations")


def unknown_citing(found: DataFrame, papers: DataFrame) -> DataFrame:
    """The citing ids that no paper has, for the log."""
    return found.select("arxiv_id").distinct().join(papers, "arxiv_id", "left_anti")


def batches(ids: DataFrame, size: int) -> DataFrame:
    """(paper_id, chunk): ids in order, `size` to a chunk."""
    at = tables.numbered(ids.select(F.col("paper_id").cast("long").alias("paper_id")), "at", ("paper_id",))
    return at.select("paper_id", F.expr(f"at div {size}").alias("chunk"))


def embedded(papers: DataFrame, embeddings: DataFrame, model: Model, batch: int = 128, workers: int = 4, calls_per_second: float = 1.0, task_bytes: int = TASK_BYTES, at_once: int | None = None) -> DataFrame:
    """(paper_id, vector) of the papers that have none yet.

    At least `workers` tasks call the model, and so many that each has about `task_bytes` of text, each with its part of
    the allowed rate. Where a cluster runs fewer tasks than these at once, `at_once` says how many, and those share the rate.
    A batch that fails is left out; as what is missing is found by an anti-join, the next run takes it up.
    """
    ship(papers.sparkSession)
    held = tables.missing(papers.select("paper_id", F.octet_length("abstract").alias("held")), embeddings, "paper_id").agg(F.sum("held")).first()[0] or 0
    n_tasks = max(workers, -(-held // task_bytes))
    pause = min(n_tasks, at_once or n_tasks) / calls_per_second

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free_at = 0.0
        for part in parts:
            for start in range(0, len(part), batch):
                some = part.iloc[start : start + batch]
                if (wait := free_at - time.monotonic()) > 0:
                    time.sleep(wait)
                free_at = time.monotonic() + pause
                try:
                    rows = model(some["abstract"].tolist())
                except Exception as e:  # noqa: BLE001  any failure of a service leaves its batch for the next run
                    print(f"a batch of {len(some)} papers failed: {e}")
                    continue
                yield pd.DataFrame({"paper_id": some["paper_id"].to_numpy(), "vector": list(np.asarray(rows, np.float32))})

    todo = tables.missing(papers, embeddings, "paper_id").select("paper_id", F.coalesce("abstract", F.lit("")).alias("abstract"))
    return todo.repartition(n_tasks).mapInPandas(run, "paper_id long, vector array<float>")


def stub_model(dims: int) -> Model:
    """Vectors of unit length from a text's digest, for tests and offline runs."""
    import hashlib

    def model(texts: list[str]) -> np.ndarray:
        rows = [np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).standard_normal(dims) for t in texts]
        return np.array([r / np.linalg.norm(r) for r in rows], np.float32)

    return model


def derived(embeddings: DataFrame, short: int, dims: int) -> DataFrame:
    """(paper_id, vector, short_vector, bits): all of them follow from the stored vector, so none can be left behind."""
    v = F.col("vector")
    return embeddings.select("paper_id", "vector", vectors.truncated(v, short).alias("short_vector"), vectors.packed(v, dims).alias("bits"))
