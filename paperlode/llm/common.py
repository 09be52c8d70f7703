"""What several operators share: batches of bounded size, fresh column names, tables cut from their lineage."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.batches import ARROW_BYTES, ARROW_DEFAULT, BATCH_BYTES, mapped, release, slices  # noqa: F401
from paperlode.shared import checkpointed, shared_folder

#: White space between words in the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A table whose values take at most so many bytes, as counted on the written table, is broadcast.
BROADCAST_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def per_text(df: DataFrame, id_col: str, text_col: str, row: Callable[[bytes | None], tuple], fields: list[pa.Field]) -> DataFrame:
    """(id, *row(text as UTF-8)) for each row of df; `fields` are row()'s columns. Only the two columns reach Python."""
    names = [id_col, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            columns = list(zip(*map(row, texts), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, fields, strict=True))], names=names)

    schema = pa.schema([pa.field("x", pa.int64()), *fields])
    return mapped(df.select(F.col(id_col), F.col(text_col).cast("string")), run, spark_schema(df, id_col, schema))


def spark_schema(df: DataFrame, id_col: str, schema: pa.Schema):
    """Spark's type of `schema`, its first column being df's column of ids."""
    from pyspark.sql.pandas.types import from_arrow_schema
    from pyspark.sql.types import StructField, StructType

    rest = from_arrow_schema(schema).fields[1:]
    return StructType([StructField(id_col, df.schema[id_col].dataType, True), *rest])


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the folder in spark.checkpoint.dir, so that lost executors cost no recomputation."""
    return checkpointed(df)


def written(df: DataFrame) -> DataFrame:
    """df, written as a table to the folder of checkpoints.

    Unlike a checkpoint, which keeps its plan's estimated size, a table has its measured size.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df as a written table, marked for broadcast if its values take at most `most` bytes; else joins shuffle it."""

    def width(c: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        return F.greatest(F.size(c), F.lit(0)) * 24 + 16 if kind.startswith("array") else F.lit(64 if kind.startswith("struct") else 16)

    out = written(df)
    size = out.agg(F.sum(sum((width(*c) for c in out.dtypes), F.lit(0)))).first()[0] or 0
    return F.broadcast(out) if size <= most else out


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once, though the body's lambdas use it often."""
    return F.transform(F.array(value), body)[0]
