"""Labelled rows to learn from: a bounded sample of the rows outside the held-out fold.

Defined results: null ids and labels other than 0 and 1, nulls too, are no labels; an id labelled both ways has label 1;
of equal hashes the smaller id comes first; all rows of a chosen id are taken, with their whole texts; empty tables give
an empty sample and the share 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.llm.common import cut


def in_fold(id_: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves `fold`; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int) -> tuple[DataFrame, float]:
    """((doc_id, text, y) of at most `most` rows of each class, by hash order; the share of class 1 among all rows).

    Held-out rows are never read for their labels. The chosen ids are few enough to be broadcast: 2 * most.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(~in_fold(F.col("doc_id"), folds, fold) & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = usable.agg(F.avg("y")).first()[0] or 0.0
    by_hash = usable.withColumn("u", F.xxhash64(F.lit(label), "doc_id"))
    some = [by_hash.filter(F.col("y") == y).orderBy("u", "doc_id").limit(most).select("doc_id", "y") for y in (0, 1)]
    chosen = some[0].union(some[1])
    return cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")), float(share)
