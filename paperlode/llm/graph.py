"""Connected components by contraction, on tables that never leave the executors.

Defined results: an edge with a null end, or with two equal ends, joins nothing; repeated edges count once; a node
without edges isn't in the result; without edges the result is empty.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.llm.common import cut, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b): the label is a node, the same one for all nodes of a component.

    Each round orders the nodes by a hash that is another one in each round, points every node at its first neighbour or
    itself, follows the pointers twice, and maps the edges along. In such an order paths of pointers are short however
    the graph's nodes are numbered, so that the nodes that still have edges are at most about half as many after each
    round, chains included. Rounds are cut from their lineage; the edges and the result are tables, since the estimated
    sizes of checkpoints multiply through the joins from round to round until planning hangs over their digits.
    """
    edges, labels = written(edges.select("a", "b").filter("a != b").distinct()), None
    for turn in itertools.count():
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        ranked = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("n"))
        first = ends.groupBy(F.col("a").alias("node")).agg(F.min(ranked("b")).alias("b"))
        nearest = cut(first.select("node", F.least(ranked("node"), "b")["n"].alias("to")))
        to = nearest
        for _ in range(2):
            step = nearest.select(F.col("node").alias("to"), F.col("to").alias("next"))
            to = to.join(step, "to").select("node", F.col("next").alias("to"))
        to = cut(to)
        if labels is None:
            labels = to.select("node", F.col("to").alias("label"))
        else:
            moved = to.select(F.col("node").alias("label"), "to")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        a, b = to.select(F.col("node").alias("a"), F.col("to").alias("x")), to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        mapped = edges.join(a, "a").join(b, "b").filter("x != y")
        edges = written(mapped.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if edges.isEmpty():
            return written(labels)
