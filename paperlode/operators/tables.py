"""Changes to stored tables. Parquet has no MERGE, so each change is an anti-join and an append or a rewrite: functions
take and return DataFrames, and the caller writes them."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.shared import checkpointed
from paperlode.sources.corpus import KEYS, Corpus


class Refused(ValueError):
    """A change that breaks a rule: an empty or taken name, a tag that isn't the user's."""


def same(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    """Equal keys, NULL being equal to NULL."""
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def absent(incoming: DataFrame, target: DataFrame, keys: tuple[str, ...], first: tuple[str, ...] = ()) -> DataFrame:
    """The incoming rows whose key the target doesn't have; of equal keys the first by `first`. What is there stays."""
    order = Window.partitionBy(*keys).orderBy(*(first or keys))
    once = incoming.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")
    return once.join(target, same(once, target, keys), "left_anti")


def inserted(incoming: DataFrame, target: DataFrame, table: str, first: tuple[str, ...] = ()) -> DataFrame:
    """The target with the rows of incoming that it lacks by the table's key."""
    return target.unionByName(absent(incoming, target, KEYS[table], first))


def upserted(incoming: DataFrame, target: DataFrame, table: str) -> DataFrame:
    """The target with incoming rows in place of those of the same key."""
    keys = KEYS[table]
    return target.join(incoming, same(target, incoming, keys), "left_anti").unionByName(incoming.dropDuplicates(list(keys)))


def with_ids(new: DataFrame, target: DataFrame, id_col: str, order: tuple[str, ...]) -> DataFrame:
    """New rows with ids that follow the target's greatest."""
    top = target.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    return numbered(new, id_col, order).withColumn(id_col, F.col(id_col) + top + 1)


def numbered(df: DataFrame, name: str, order: tuple[str, ...]) -> DataFrame:
    """df with the rows' numbers in that order, from 0.

    Rows are numbered within range partitions, which follow one another; a table of the partitions' sizes (a row for
    each, so it is broadcast) has what comes before. No partition holds all rows.
    """
    part, before, own = f"{name}_part", f"{name}_before", f"{name}_own"
    dealt = checkpointed(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count("*").alias(own))
    earlier = F.sum(own).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(part, F.coalesce(earlier, F.lit(0)).alias(before))
    at = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.withColumn(own, at).join(F.broadcast(offsets), part).withColumn(name, (F.col(before) + F.col(own) - 1).cast("long")).drop(part, before, own)


def inserted_count(incoming: DataFrame, target: DataFrame, table: str) -> DataFrame:
    """(n): how many rows inserted() would add."""
    return absent(incoming, target, KEYS[table]).agg(F.count("*").alias("n"))


def without_value(table: DataFrame, column: str) -> DataFrame:
    """The rows whose column is still to be filled."""
    return table.filter(F.col(column).isNull())


def backfilled(table: DataFrame, column: str, value: Column) -> DataFrame:
    """The table with `value` where the column is null; running it again changes nothing."""
    return table.withColumn(column, F.coalesce(F.col(column), value))


def violations(table: DataFrame, name: str) -> DataFrame:
    """Keys that stand more than once, with their number; no rows if the table is sound."""
    return table.groupBy(*KEYS[name]).agg(F.count("*").alias("n")).filter("n > 1")


def missing(parents: DataFrame, children: DataFrame, child_key: str) -> DataFrame:
    """Papers without a child row, by id."""
    return parents.join(children.select(F.col(child_key).alias("paper_id")), "paper_id", "left_anti")


def owned(tags: DataFrame, user_id: int) -> DataFrame:
    return tags.filter(F.col("user_id") == user_id)


def own_tag(corpus: Corpus, user_id: int, tag_id: int):
    row = owned(corpus.tags, user_id).filter(F.col("tag_id") == tag_id).first()
    if row is None:
        raise Refused(f"no tag {tag_id} of this user")
    return row


def add_to_tag(corpus: Corpus, user_id: int, paper_id: int, as_of: datetime, tag_id: int | None = None, tag_name: str = "") -> tuple[DataFrame, DataFrame]:
    """(tags, tagged_papers) with the paper in the tag; an id wins over a name, and a new name makes a tag."""
    spark, tags = corpus.tags.sparkSession, corpus.tags
    tag_name = tag_name.strip()
    if tag_id is None:
        if not tag_name:
            raise Refused("a tag's id or name is needed")
        found = owned(tags, user_id).filter(F.col("name") == tag_name).first()
        tag_id = found.tag_id if found else tags.agg(F.coalesce(F.max("tag_id"), F.lit(0)) + 1).first()[0]
        made = spark.createDataFrame([(tag_id, user_id, tag_name, as_of, as_of)], "tag_id long, user_id long, name string, created_at timestamp_ntz, updated_at timestamp_ntz")
        tags = inserted(made, tags, "tags")
    else:
        own_tag(corpus, user_id, tag_id)
    row = spark.createDataFrame([(tag_id, paper_id, as_of)], "tag_id long, paper_id long, added_at timestamp_ntz")
    return tags, inserted(row, corpus.tagged_papers, "tagged_papers")


def remove_from_tag(corpus: Corpus, user_id: int, tag_id: int, paper_id: int) -> DataFrame:
    """tagged_papers without that row; nothing happens if there is none."""
    own_tag(corpus, user_id, tag_id)
    return corpus.tagged_papers.filter(~((F.col("tag_id") == tag_id) & (F.col("paper_id") == paper_id)))


def rename_tag(corpus: Corpus, user_id: int, tag_id: int, new_name: str, as_of: datetime) -> DataFrame:
    own_tag(corpus, user_id, tag_id)
    new_name = new_name.strip()
    if not new_name:
        raise Refused("a name is needed")
    if not owned(corpus.tags, user_id).filter((F.col("name") == new_name) & (F.col("tag_id") != tag_id)).isEmpty():
        raise Refused(f"there is a tag {new_name} already")
    return renamed(corpus.tags, tag_id, new_name, as_of)


def renamed(tags: DataFrame, tag_id: int, new_name: str, as_of: datetime) -> DataFrame:
    hit = F.col("tag_id") == tag_id
    return tags.withColumns({"name": F.when(hit, F.lit(new_name)).otherwise(F.col("name")), "updated_at": F.when(hit, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("updated_at"))})


def delete_tag(corpus: Corpus, user_id: int, tag_id: int) -> tuple[DataFrame, DataFrame]:
    """(tags, tagged_papers) without the tag and what it holds."""
    own_tag(corpus, user_id, tag_id)
    return without_tag(corpus, tag_id)


def without_tag(corpus: Corpus, tag_id: int) -> tuple[DataFrame, DataFrame]:
    return corpus.tags.filter(F.col("tag_id") != tag_id), corpus.tagged_papers.filter(F.col("tag_id") != tag_id)


def without_paper(corpus: Corpus, paper_id: int) -> Corpus:
    """The corpus after a paper's deletion has reached every table that refers to it."""
    gone = lambda df, *columns: df.filter(reduce(lambda a, b: a & b, (F.col(c) != paper_id for c in columns)))
    return Corpus(gone(corpus.papers, "paper_id"), corpus.authors, gone(corpus.paper_author, "paper_id"), gone(corpus.citations, "citing_id", "cited_id"), corpus.tags, gone(corpus.tagged_papers, "paper_id"), gone(corpus.embeddings, "paper_id"))


def user_of(users: DataFrame, email: str) -> DataFrame:
    """users with a user of that address, its name being the address in lower case."""
    name = email.strip().lower()
    row = users.sparkSession.createDataFrame([(name, name)], "username string, email string")
    new = absent(row, users, ("username",))
    return users.unionByName(with_ids(new, users, "user_id", ("username",)).select(*users.columns))
