"""Mixing sources to target weights.

Words are summed by source (partial sums before the shuffle), each source's target follows from the weights, and each
document is emitted floor(rate) times plus once more with a probability equal to the rate's fraction, decided by a hash
of the seed and the document's id. Reruns, and other partitionings, agree.

Sources by code point, null last, weigh 1, 2, 3, repeating. They share the sum of all sizes; no target exceeds MOST
times its source's size, and the excess is shared anew by weight until none does. In order of cap / weight the capped
sources are a prefix, so two running sums over the table of sources find the level instead of a loop.

Defined results: a null or empty text has size 0 and takes 0 words; a very long text is one row, taken or not as a
whole; sources that reach their caps at the same level come in order of their names, which doesn't change the level; an
empty table has no sources and gives an empty table; null sources are a source of their own; a source
without words has target 0, and its documents stay once each; rows that repeat an id share its decision; a null id is
replaced by a digest of the text; further columns, whatever their names, are kept by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.llm.common import WORD, fresh, written

MOST = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, id_: Column, text: Column) -> Column:
    """A number from [0, 1) by the id's hash; 52 bits, so that it is exact."""
    key = F.coalesce(id_.cast("string"), F.concat(F.lit("null:"), F.coalesce(F.md5(text), F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, source_col: str, size_col: str) -> DataFrame:
    """(source, source_size, target), a row for each source; the windows run over that table only."""
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    common = 1
    for w in WEIGHTS:
        common *= w
    table = (
        sizes.groupBy(F.col(source_col).alias("source"))
        .agg(F.sum(size_col).alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * MOST)
        .withColumn("level", F.col("cap") * F.expr(f"{common} div weight"))
        .withColumn("left", F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products exceed a long
    table = table.withColumn("free", wide("cap") * wide("weights") > wide("left") * wide("weight"))
    first = F.min_by(F.struct("left", "weights"), F.when(F.col("free"), F.struct("level", F.col("source").isNull(), F.col("source")))).over(everywhere)
    table = table.withColumn("at", first)
    shared = (F.col("weight") * F.col("at.left")).cast("double") / F.col("at.weights").cast("double")
    return table.select("source", "source_size", F.when(F.col("free"), shared).otherwise(F.col("cap").cast("double")).alias("target"))


def with_copies(df: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, list[str]]:
    """df's rows with size, source_size, target and copies under the names that come second.

    The table of sources is written first, so that its size is measured and not estimated: it is broadcast if that size
    is below the session's threshold, and the documents stay where they are; else both sides are shuffled and a hot
    source's partition is split at run time.
    """
    size, source, source_size, target, copies, drawn = fresh(df, "size", "source_of", "source_size", "target", "copies", "drawn")
    sized = df.withColumns({size: n_words(F.col(text_col)), drawn: draw(seed, F.col(id_col), F.col(text_col))})
    table = targets(sized.select(F.col(source_col).alias("source"), F.col(size).alias("size")), "source", "size")
    table = written(table).toDF(source, source_size, target)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(1.0))
    whole = F.floor(rate)
    n = whole + F.when(F.col(drawn) < rate - whole, 1).otherwise(0)
    out = sized.join(table, F.col(source_col).eqNullSafe(F.col(source)), "left").withColumn(copies, n.cast("long")).drop(source, drawn)
    return out, [size, source_size, target, copies]


def mix(df: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df's rows and columns, each row as often as the mix takes it."""
    out, (*_, copies) = with_copies(df, seed, id_col, text_col, source_col)
    return out.withColumn(copies, F.explode(F.when(F.col(copies) > 0, F.sequence(F.lit(1).cast("long"), F.col(copies))))).select(*df.columns)


def taken(df: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of each row."""
    out, (size, source_size, target, copies) = with_copies(df.select(id_col, text_col, source_col), seed, id_col, text_col, source_col)
    return out.select(id_col, F.col(size).alias("size"), F.col(source_size).alias("source_size"), F.col(target).alias("target"), (F.col(size) * F.col(copies)).alias("taken"))


#: DuckDB's form of taken(). The level is found by trying each source's, not by the order that targets() uses.
SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
named AS (
  SELECT source, sum(size)::HUGEINT AS total, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS w
  FROM sized GROUP BY source),
tried AS (
  SELECT a.source, a.total, a.w,
    (SELECT sum(total) FROM named) - (SELECT coalesce(sum(3 * b.total), 0) FROM named b WHERE 3 * b.total * a.w < 3 * a.total * b.w OR (3 * b.total * a.w = 3 * a.total * b.w AND (b.source IS NULL, b.source) < (a.source IS NULL, a.source))) AS rest,
    (SELECT sum(b.w) FROM named b WHERE NOT (3 * b.total * a.w < 3 * a.total * b.w OR (3 * b.total * a.w = 3 * a.total * b.w AND (b.source IS NULL, b.source) < (a.source IS NULL, a.source)))) AS ws
  FROM named a),
free AS (SELECT *, 3 * total * ws > rest * w AS free FROM tried),
level AS (SELECT rest, ws FROM free WHERE free ORDER BY 3.0 * total / w, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, total::BIGINT AS source_size,
    CASE WHEN free THEN (w * (SELECT rest FROM level))::DOUBLE / (SELECT ws FROM level)::DOUBLE ELSE (3 * total)::DOUBLE END AS target
  FROM free),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate,
    ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
