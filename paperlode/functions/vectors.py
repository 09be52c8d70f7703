"""Vector functions as plain columns.

Sign bits are packed into words of 32 bits, so that the Hamming distance is bit counts of exclusive ors, within
whole-stage code generation; the packing itself runs once per vector, when operators.ingest.derived() stores it.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 32


def sign_bits(vector: Column) -> Column:
    """A string of 1 where a component is above 0, else 0."""
    return F.array_join(F.transform(vector, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def packed(vector: Column, dims: int) -> Column:
    """The sign bits as an array of longs with WORD_BITS bits each, the first component highest."""
    word = lambda start: F.aggregate(F.slice(vector, start, WORD_BITS), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0))
    return F.array(*(word(i + 1) for i in range(0, dims, WORD_BITS)))


def hamming(a: Column, b: Column, dims: int) -> Column:
    """Of two packed vectors: how many bits differ."""
    return reduce(add, (F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(-(-dims // WORD_BITS)))).cast("long")


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def truncated(vector: Column, dims: int) -> Column:
    """The first `dims` components, at unit length; a zero vector stays as it is."""
    part = F.slice(vector, 1, dims)
    scaled = F.transform(F.array(F.struct(part.alias("v"), norm(part).alias("n"))), lambda x: F.when(x["n"] > 0, F.transform(x["v"], lambda y: (y / x["n"]).cast("float"))).otherwise(x["v"].cast("array<float>")))
    return scaled[0]


def parsed(text: Column) -> Column:
    """A vector from its text form, such as [0.5,-1]; null if it isn't one."""
    return F.from_json(text, "array<float>")
