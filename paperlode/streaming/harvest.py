"""Continuous ingestion: landed pages are a file stream, and each micro-batch is one repeatable harvest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paperlode.operators.ingest import harvested
from paperlode.sources.corpus import Corpus
from paperlode.sources.harvest import RECORD, shaped


def record_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of records as pages land; the checkpoint of the stream takes the place of a high-water mark."""
    raw = spark.readStream.schema(RECORD).option("rowTag", "record").format("xml").load(folder)
    return shaped(raw.select("metadata.arXiv.*"))


def harvest(records: DataFrame, load: Callable[[], Corpus], store: Callable[[Corpus], None], checkpoint: str) -> StreamingQuery:
    """Runs what has landed and stops. A batch that runs again after a failure inserts nothing twice."""

    def batch(rows: DataFrame, _: int) -> None:
        store(harvested(rows, load()))

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
