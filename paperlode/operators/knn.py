"""Exact nearest neighbours among candidates, for one source and for many.

Distances are computed on packed bits or on the vectors, for narrow rows (id, vector); papers and authors are joined to
the page only. Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlode.functions import vectors

PAGE = 20
#: Sources that meet the candidates in one pass.
CHUNK = 32


def keyed(embeddings: DataFrame, metric: str, dims: int) -> DataFrame:
    """(paper_id, v): v is what the metric compares. Stored bits are read as they are; vectors are packed otherwise."""
    if metric == "hamming":
        v = F.col("bits") if "bits" in embeddings.columns else vectors.packed(F.col("vector"), dims)
    else:
        v = F.col("vector")
    return embeddings.select("paper_id", v.alias("v"))


def distance(metric: str, dims: int):
    return vectors.hamming(F.col("v"), F.col("q"), dims) if metric == "hamming" else vectors.l2(F.col("v"), F.col("q"))


def knn(embeddings: DataFrame, candidates: DataFrame, paper_id: int, k: int, metric: str = "hamming", dims: int = 64) -> DataFrame:
    """(paper_id, distance), nearest first; no rows if the paper has no embedding.

    The source is one row by its key, so broadcasting it is bounded by a vector's size.
    """
    table = keyed(embeddings, metric, dims)
    source = table.filter(F.col("paper_id") == paper_id).orderBy("paper_id").limit(1).select(F.col("v").alias("q"))
    near = table.join(candidates.select("paper_id"), "paper_id", "left_semi").crossJoin(F.broadcast(source))
    return near.select("paper_id", distance(metric, dims).alias("distance")).orderBy("distance", "paper_id").limit(k)


def per_source(embeddings: DataFrame, candidates: DataFrame, sources: DataFrame, k: int, metric: str = "hamming", dims: int = 64) -> DataFrame:
    """(src_ord, rk, paper_id, distance): each source's k nearest. sources: (src_ord, paper_id), the papers of one tag.

    The sources are broadcast: CHUNK at most, which first_found() sees to. Each partition keeps the best k of each source
    before anything is shuffled (Spark's window group limit), so what meets is bounded by partitions * sources * k.
    """
    table = keyed(embeddings, metric, dims)
    query = sources.join(table, "paper_id").select("src_ord", F.col("v").alias("q"))
    pairs = table.join(candidates.select("paper_id"), "paper_id", "left_semi").crossJoin(F.broadcast(query))
    best = Window.partitionBy("src_ord").orderBy("distance", "paper_id")
    ranked = pairs.select("src_ord", "paper_id", distance(metric, dims).alias("distance")).withColumn("rk", F.row_number().over(best))
    return ranked.filter(F.col("rk") <= k)


def first_found(embeddings: DataFrame, candidates: DataFrame, sources: DataFrame, n: int, k: int, metric: str = "hamming", dims: int = 64, page: int = PAGE) -> DataFrame:
    """per_source() for the first of n sources, CHUNK at a time, until they have found a page of papers: what comes after
    that would be dropped. At most CHUNK * k rows of a pass reach the driver."""
    rows: list = []
    for start in range(0, n, CHUNK):
        some = sources.filter((F.col("src_ord") > start) & (F.col("src_ord") <= start + CHUNK))
        rows += per_source(embeddings, candidates, some, k, metric, dims).select("src_ord", F.col("rk").cast("int").alias("rk"), "paper_id", "distance").collect()
        if len({r.paper_id for r in rows}) >= page:
            break
    kind = "double" if metric == "l2" else "long"
    return embeddings.sparkSession.createDataFrame(rows, f"src_ord int, rk int, paper_id long, distance {kind}")


def share(n_sources: int, page: int = PAGE) -> int:
    """How many neighbours each of n sources gives."""
    return max(1, page // max(1, n_sources)) + 1


def interleaved(found: DataFrame, page: int = PAGE) -> DataFrame:
    """(place, paper_id, src_ord, distance) of rows (src_ord, rk, paper_id, distance).

    A paper counts for the first source that found it; sources after the one that fills the page are dropped; then each
    source gives one paper in turn. The windows hold a few rows for each source of one request.
    """
    first = Window.partitionBy("paper_id").orderBy("src_ord")
    new = found.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    counts = new.groupBy("src_ord").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("src_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = counts.withColumn("before", before).filter(F.col("before") < page).select("src_ord")
    turn = F.row_number().over(Window.partitionBy("src_ord").orderBy("rk"))
    dealt = new.join(used, "src_ord").withColumn("turn", turn)
    place = F.row_number().over(Window.orderBy("turn", "src_ord")).cast("long")
    return dealt.select(place.alias("place"), "paper_id", "src_ord", "distance")
