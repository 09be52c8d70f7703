"""Sources of records: OAI-PMH pages (XML) with resumption tokens, citation responses (JSON), a rate limiter.

A fetcher, any function from URL to text, lands the pages in a folder; Spark reads the folder. So the loop that has to
follow tokens one by one holds no records, and a rerun reads what has landed.
"""

from __future__ import annotations

import os
import re
import threading
import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from paperlode.functions import text

RESTART_DAYS = 7
RECORD = """metadata struct<arXiv: struct<id: string, created: string, updated: string, title: string, abstract: string,
categories: string, authors: struct<author: array<struct<keyname: string, forenames: string>>>>>"""
RECORDS = "arxiv_id string, created timestamp_ntz, updated timestamp_ntz, title string, abstract string, categories array<string>, authors array<struct<keyname:string,forenames:string>>"
CITATIONS = "data array<struct<citingPaper: struct<paperId: string, externalIds: struct<ArXiv: string>>>>"


class RateLimiter:
    """At most so many calls a second, over all threads of a process."""

    def __init__(self, calls_per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep = 1.0 / calls_per_second, clock, sleep
        self.free_at, self.lock = float("-inf"), threading.Lock()

    def acquire(self) -> None:
        with self.lock:
            if (wait := self.free_at - self.clock()) > 0:
                self.sleep(wait)
            self.free_at = self.clock() + self.interval


def token_of(page: str) -> str | None:
    m = re.search(r"<resumptionToken[^>]*>\s*([^<]*?)\s*</resumptionToken>", page)
    return m[1] or None if m else None


def last_day(page: str) -> date | None:
    """The latest `updated`, or else `created`, of a page's records."""
    days = []
    for record in re.findall(r"<record>.*?</record>", page, re.S):
        found = dict(re.findall(r"<(created|updated)>\s*(\d{4}-\d\d-\d\d)\s*</", record))
        if found:
            days.append(date.fromisoformat(found.get("updated") or found["created"]))
    return max(days, default=None)


def pages(fetch: Callable[[str], str], base: str, today: date, since: date | None = None) -> Iterator[str]:
    """The pages of a harvest. When a list ends more than RESTART_DAYS ago, another one starts from its last day."""
    url = lambda day: f"{base}?verb=ListRecords&metadataPrefix=arXiv" + (f"&from={day:%Y-%m-%d}" if day else "")
    at, latest, started = url(since), since, since
    while True:
        page = fetch(at)
        yield page
        latest = max(filter(None, (latest, last_day(page))), default=None)
        if token := token_of(page):
            at = f"{base}?verb=ListRecords&resumptionToken={token}"
        elif latest and latest < today - timedelta(days=RESTART_DAYS) and latest != started:
            at, started = url(latest), latest
        else:
            return


def land(found: Iterator[str], folder: str) -> int:
    """Writes each page as a file that appears whole; returns how many."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for n, page in enumerate(found, 1):  # noqa: B007
        name = f"{folder}/{time.time_ns()}-{n}.xml"
        with open(name + ".part", "w", encoding="utf-8") as out:
            out.write(page.strip())
        os.replace(name + ".part", name)
    return n


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of landed pages; those without an id or a creation day (deleted ones, say) are skipped."""
    raw = spark.read.schema(RECORD).option("rowTag", "record").option("mode", "PERMISSIVE").format("xml").load(folder)
    return shaped(raw.select("metadata.arXiv.*"))


def shaped(raw: DataFrame) -> DataFrame:
    """Rows of RECORDS from the strings of a page."""
    authors = F.coalesce(F.filter("authors.author", lambda a: a["keyname"].isNotNull()), F.array().cast("array<struct<keyname:string,forenames:string>>"))
    out = raw.select(
        text.filled(F.col("id")).alias("arxiv_id"),
        text.iso_day(F.trim("created")).alias("created"),
        text.iso_day(F.trim("updated")).alias("updated"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
        F.split(F.trim("categories"), " ").alias("categories"),
        authors.alias("authors"),
    )
    return out.filter("arxiv_id IS NOT NULL AND created IS NOT NULL")


def citing_ids(spark: SparkSession, path: str) -> DataFrame:
    """(cited_arxiv_id, arxiv_id): of landed responses, one file or row for each cited paper, the citing papers' ids."""
    raw = spark.read.schema(f"arxiv_id string, status int, {CITATIONS}").json(path)
    return cited_by(raw)


def cited_by(raw: DataFrame) -> DataFrame:
    """Only responses of status 200 count; a citing paper without an arXiv id is skipped."""
    each = raw.filter("status = 200").select(F.col("arxiv_id").alias("cited_arxiv_id"), F.explode("data").alias("x"))
    return each.select("cited_arxiv_id", F.col("x.citingPaper.externalIds.ArXiv").alias("arxiv_id")).filter("arxiv_id IS NOT NULL AND arxiv_id <> ''")


class LandedPages(DataSource):
    """spark.read.format("oai_pages").load(folder): (file, body), a partition for each landed page."""

    @classmethod
    def name(cls) -> str:
        return "oai_pages"

    def schema(self) -> str:
        return "file string, body string"

    def reader(self, schema) -> DataSourceReader:
        return LandedPagesReader(self.options["path"])


class LandedPagesReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f"{self.folder}/{f}") for f in sorted(os.listdir(self.folder)) if f.endswith(".xml")]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        with open(partition.value, encoding="utf-8") as page:
            yield partition.value, page.read()
