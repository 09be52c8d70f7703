"""The shared filter of all searches: excluded ids, a date cutoff, a category. Always lazy."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAYS = {"1day": 1, "3day": 3, "1week": 7, "1month": 30, "3months": 90, "6months": 180, "1year": 365, "2years": 730}
DEFAULT = "1week"
#: Ids of a request (its pages so far) up to this many are literals of the filter; more are a table to join.
LITERAL_IDS = 1000


def date_cutoff(key: str, as_of: datetime) -> datetime | None:
    """None for "all" and for a key that isn't known."""
    return as_of - timedelta(days=DAYS[key]) if key in DAYS else None


def ids_table(spark: SparkSession, ids: set[int]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in sorted(ids)], "paper_id long")


def excluded(papers: DataFrame, ids: set[int] | frozenset[int]) -> DataFrame:
    if not ids:
        return papers
    if len(ids) <= LITERAL_IDS:
        return papers.filter(~F.col("paper_id").isin(*sorted(ids)))
    return papers.join(ids_table(papers.sparkSession, set(ids)), "paper_id", "left_anti")


def candidates(papers: DataFrame, as_of: datetime, date_filter: str = DEFAULT, category: str = "", exclude: set[int] | frozenset[int] = frozenset(), drawer: DataFrame | None = None, current: int | None = None) -> DataFrame:
    """Papers that a search may return. drawer: the open tag's tagged papers, which go as well as the current paper."""
    out = excluded(papers, set(exclude) | ({current} if current is not None else set()))
    if drawer is not None:
        out = out.join(drawer.select("paper_id"), "paper_id", "left_anti")
    if cutoff := date_cutoff(date_filter or DEFAULT, as_of):
        out = out.filter(F.col("created") >= F.lit(cutoff).cast("timestamp_ntz"))
    if category:
        out = out.filter(F.array_contains("categories", category))
    return out
