"""Latency of the nearest-neighbour search over date ranges."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.operators.candidates import DAYS, candidates
from paperlode.operators.knn import knn
from paperlode.sources.corpus import Corpus


def sampled(corpus: Corpus, n: int, seed: int) -> DataFrame:
    """n papers with an embedding, in an order that the seed gives."""
    own = corpus.papers.join(corpus.embeddings.select("paper_id"), "paper_id", "left_semi")
    return own.orderBy(F.md5(F.concat(F.col("paper_id").cast("string"), F.lit(f":{seed}"))), "paper_id").limit(n).select("paper_id")


def trials(corpus: Corpus, as_of: datetime, paper_id: int | None = None, n_trials: int = 20, k: int = 100, seed: int = 0) -> DataFrame:
    """(date_filter, eligible, ms) of each trial."""
    spark = corpus.papers.sparkSession
    ids = [paper_id] if paper_id is not None else [r[0] for r in sampled(corpus, n_trials, seed).collect()]
    rows = []
    for key in ["all", *DAYS]:
        cand = candidates(corpus.papers, as_of, key)
        eligible = cand.join(corpus.embeddings.select("paper_id"), "paper_id", "left_semi").count()
        for i in range(n_trials if ids else 0):
            began = time.perf_counter()
            knn(corpus.embeddings, cand, ids[i % len(ids)], k).collect()
            rows.append((key, eligible, (time.perf_counter() - began) * 1000))
    return spark.createDataFrame(rows, "date_filter string, eligible long, ms double")


def statistics(measured: DataFrame, key: str = "date_filter", value: str = "ms") -> DataFrame:
    """Mean, median, least, greatest, and sample deviation (0 for one trial) of each key."""
    v = F.col(value)
    return measured.groupBy(key).agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("deviation"))
