"""Backfills: the tasks' shares of the texts are bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlode.operators import ingest


@pytest.mark.parametrize(("rows", "tasks"), [(3, 4), (400, 10)])
def test_tasks_follow_the_texts(spark, rows, tasks):
    """There were always four, so each one's share grew with the table."""
    papers = spark.range(rows).select(F.col("id").alias("paper_id"), F.repeat(F.lit("é"), 500).alias("abstract"))
    none = spark.createDataFrame([], "paper_id long, vector array<float>")
    made = ingest.embedded(papers, none, ingest.stub_model(4), calls_per_second=1e6, task_bytes=40_000)
    assert made.rdd.getNumPartitions() == tasks
    assert sorted(r.paper_id for r in made.collect()) == [*range(rows)]


def test_nothing_to_do(spark):
    papers, none = spark.createDataFrame([], "paper_id long, abstract string"), spark.createDataFrame([], "paper_id long, vector array<float>")
    assert ingest.embedded(papers, none, ingest.stub_model(4), calls_per_second=1e6).count() == 0


def test_texts_with_a_vector_do_not_count(spark):
    papers = spark.createDataFrame([(1, "a" * 1000), (2, None), (3, "b")], "paper_id long, abstract string")
    some = spark.createDataFrame([(1, [1.0])], "paper_id long, vector array<float>")
    made = ingest.embedded(papers, some, ingest.stub_model(4), calls_per_second=1e6, task_bytes=10)
    assert made.rdd.getNumPartitions() == 4
    model = ingest.stub_model(4)
    assert {r.paper_id: r.vector for r in made.collect()} == {2: model([""])[0].tolist(), 3: model(["b"])[0].tolist()}


@pytest.mark.parametrize(("at_once", "least"), [(None, 3.2), (2, 0.8)])
def test_the_tasks_share_the_rate(spark, at_once, least):
    """4 tasks of 3 calls each at 2.5 calls a second: pauses of 1.6 s if all run at once, of 0.8 s for shares of two."""
    import time

    papers = spark.range(12).select(F.col("id").alias("paper_id"), F.lit("a").alias("abstract")).coalesce(1)
    none = spark.createDataFrame([], "paper_id long, vector array<float>")
    made = ingest.embedded(papers, none, lambda texts: np.full((len(texts), 1), time.time()), batch=1, calls_per_second=2.5, at_once=at_once)
    began = time.monotonic()
    assert made.count() == 12
    assert time.monotonic() - began >= 2 * (4 if at_once is None else at_once) / 2.5 >= least
