"""Arrow batches of bounded bytes, and Python functions over them."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from paperlode.packaging import ship

#: Bytes of text that a Python worker handles at once; a longer text makes a batch of its own.
BATCH_BYTES = 4 << 20
#: Spark's limit of an Arrow batch on its way to Python, and its default, which fills direct memory in each task.
ARROW_BYTES, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose values of that column hold about `most` bytes."""
    for batch in batches:
        n, start, held = batch.num_rows, 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, size in enumerate(sizes):
            if held + size > most and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < n:
            yield batch.slice(start, n - start)


def mapped(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow, with this package sent to the executors first, in batches of bounded bytes; a task gives its
    memory back when it ends, as Python workers are used again."""
    ship(df.sparkSession)
    if df.sparkSession.conf.get(ARROW_BYTES) == ARROW_DEFAULT:
        df.sparkSession.conf.set(ARROW_BYTES, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
