"""MinHash near-dedup by an LSH forest; links are confirmed on full shingle sets.

1. Equal shingle sets are one class from here on, so copies never make pairs.
2. Forest: TREES sorted orders of the signature, each beginning at other MinHash values. In each order a class's
   candidates are its next NEAR neighbours that share a prefix of DEPTH values or more: neighbours in sorted order have
   the longest common prefixes. The orders are made by range partitioning, which splits any region between tasks. A row
   carries four bits of each MinHash value, so candidates are judged where they meet and no pair is ever shuffled: those
   whose signatures agree by ALIKE or more are edges, of which each batch returns a spanning forest.
3. The depth follows the region. Where more than NEAR neighbours share all KEY values of an order, the region is crowded:
   its rows alone are sorted anew by DEEP values. A class that is crowded in CROWDED orders or more, mostly by strangers
   (classes that aren't alike), is sorted in EXTRA further orders, as at a greater depth each order finds a link more
   rarely. So the work grows with the number of classes, however many share a page's template.
4. The components of these edges are families. Linked classes are in one family though they are no neighbours, if a chain
   of edges joins them.
5. Within a family of at most MANY blocks every two classes are compared on full sets: sets meet in blocks of bounded
   size, a task for each two blocks, and each task returns no more edges than it has classes (a spanning forest of the
   links it found). A larger family is first dealt at random into blocks TURNS times, and each block is compared in
   itself. What that joins fills solid blocks, which needn't meet each other; only blocks of different components meet.
6. Components of those edges are the groups.

A link's similarity is `percent` hundredths or more: 85 in op10_near_dedup, 80 in the pipeline. The chance that two
classes share no prefix in any tree is (1 - 0.85 ** 3) ** 24 < 2e-10 at similarity 0.85, (1 - 0.80 ** 3) ** 24 < 4e-8 at
0.80; that their signatures agree by less than ALIKE is below 1e-7 and 2e-4. Among n strangers of similarity t a pair
must share about d = log(n / NEAR) / log(1 / t) values to be neighbours, so that an order misses it with 1 - 0.85 ** d:
for a million strangers of 0.42 all 24 + 96 orders miss it with less than 2e-5. tests/llm/test_near_dedup.py measures it.

Defined results: a null text or one without words has an empty set, and is linked with nothing; a very long text is one
set, in a block of its own if need be; ties (equal signatures) are ordered by the set's digest; rows that repeat an id
and text share a result; a null id never is a component's id, unless all of its documents have none (then null), and
such a row is kept if its component has no id; an empty table gives an empty table; further columns are ignored by
groups(), and kept by deduped(), whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.llm import shingles as S
from paperlode.llm.common import bounded, cut, fresh, mapped, slices, spark_schema
from paperlode.llm.graph import components

PERCENT = 85
TREES, DEPTH, KEY = 24, 3, 8  # KEY: values that an order sorts by
NEAR = 4
DEEP, EXTRA, CROWDED = 24, 96, 6
ALIKE = 0.65  # a similarity; values of four bits agree by chance in one case of 16
#: A block has about so many classes, or about so many shingles, at most; a longer text is a block of its own.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 19
MANY, TURNS = 8, 2
HASHES = 120
#: Of the filter that keeps texts without family from being shuffled: bits, and places of each key.
BITS, PLACES = 1 << 25, 3


def row_key(id_col: str, text_col: str) -> Column:
    """Of a row: its id and a digest of its text, as rows may share an id."""
    return F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def low_bits(sig: bytes) -> bytes:
    x = np.frombuffer(sig, np.uint8)[3::4] & 15
    return (x[::2] << 4 | x[1::2]).tobytes()


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n_shingles, set_key, sig, low): sig holds HASHES big-endian 32-bit values, low the lowest four bits of
    each; null without shingles."""
    fields = [("key", pa.string()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary()), ("low", pa.binary())]
    schema = pa.schema([pa.field("x", pa.int64()), *(pa.field(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            sets = [S.shingles(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
            keys = [S.set_key(x) if len(x) else None for x in sets]
            sigs = [S.minhash(x, HASHES).astype(">u4").tobytes() if len(x) else None for x in sets]
            low = [x and low_bits(x) for x in sigs]
            columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(c, pa.binary()) for c in (keys, sigs, low))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *(n for n, _ in fields)])

    own = df.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string"))
    return mapped(own, run, spark_schema(own, "id", schema))


def forest_of(pairs: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """The pairs that join what earlier ones haven't joined."""
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for a, b in pairs:
        if (x := top(a)) != (y := top(b)):
            up[y] = x
            out.append((a, b))
    return out


def neighbours(batches: Iterator[pa.RecordBatch], depth: int = DEPTH) -> Iterator[pa.RecordBatch]:
    """Of rows (tree, prefix, set_key, low) in sorted order: edges (null, a, b, null) between alike ones of each row and the
    next NEAR that share `depth` values or more; (tree, a, null, strange) for the rows of a bucket, equal in the whole
    prefix, of more than NEAR rows: whether most of its neighbours aren't alike."""
    least = HASHES * (ALIKE + (1 - ALIKE) / 16)
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        begin = held.num_rows if held else 0
        rows = pa.Table.from_batches([held, batch] if held else [batch]).combine_chunks().to_batches()[0]
        held = rows.slice(max(0, rows.num_rows - NEAR))
        trees, prefixes, keys, lows = (c.to_pylist() for c in rows.columns)
        part, whole = (np.array([bytes([t]) + p[:n] for t, p in zip(trees, prefixes, strict=True)], f"V{1 + n}") for n in (4 * depth, len(prefixes[0])))
        low = np.frombuffer(b"".join(lows), np.uint8).reshape(len(keys), -1)
        near, alike, pairs, crowded = np.zeros(len(keys), int), np.zeros(len(keys), int), [], np.zeros(0, int)
        for d in range(1, min(NEAR, len(keys) - 1) + 1):
            same = np.flatnonzero(part[d:] == part[:-d])
            differ = low[same] ^ low[same + d]
            close = HASHES - (differ & 15 != 0).sum(axis=1) - (differ >> 4 != 0).sum(axis=1) >= least
            for i, j, n in ((same, near, 1), (same + d, near, 1), (same[close], alike, 1), (same[close] + d, alike, 1)):
                np.add.at(j, i, n)
            some = same[close & (same + d >= begin)]
            pairs.extend((keys[i], keys[i + d]) for i in some.tolist())
            if d == NEAR:
                full = np.flatnonzero(whole[d:] == whole[:-d])
                full = full[full + d >= begin]
                crowded = np.union1d(full, full + d)
        found = forest_of(pairs)
        strange = (2 * alike < near)[crowded].tolist()
        columns = [
            pa.array([None] * len(found) + [trees[i] for i in crowded.tolist()], pa.int32()),
            pa.array([a for a, _ in found] + [keys[i] for i in crowded.tolist()], pa.binary()),
            pa.array([b for _, b in found] + [None] * len(crowded), pa.binary()),
            pa.array([None] * len(found) + strange, pa.bool_()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["tree", "a", "b", "strange"])


@functools.cache
def further() -> np.ndarray:
    """The values that each further order sorts by."""
    rng = np.random.default_rng(20_240_102)
    return np.array([rng.permutation(HASHES)[:DEEP] for _ in range(EXTRA)])


def reordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (set_key, sig, low): (tree, prefix, set_key, low) for each further order."""
    for batch in slices(batches, 1, 1 << 18):
        sigs = [np.frombuffer(x, ">u4")[further()] for x in batch.column(1).to_pylist()]
        prefix = pa.array([row.tobytes() for x in sigs for row in x], pa.binary())
        tree = pa.array(np.tile(np.arange(TREES, TREES + EXTRA), len(sigs)).astype(np.int32))
        own = pa.array(np.repeat(np.arange(len(sigs)), EXTRA))
        yield pa.RecordBatch.from_arrays([tree, prefix, batch.column(0).take(own), batch.column(2).take(own)], names=["tree", "prefix", "set_key", "low"])


def linked(sets: list[np.ndarray], percent: int = PERCENT, columns: int = 1024) -> np.ndarray:
    """The matrix of links between sets (sorted, without repeats), by the exact sizes of intersections."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    if n == 2:
        both = np.full((2, 2), len(np.intersect1d(*sets, assume_unique=True)), np.int64)
    else:
        _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = times[at] > 1  # what one set alone has is in no intersection
        row, at = np.repeat(np.arange(n, dtype=np.int32), sizes)[common], (np.cumsum(times > 1) - 1)[at[common]]
        order, both = np.argsort(at, kind="stable"), np.zeros((n, n), np.int32)
        at, row = at[order], row[order]
        for start in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
            lo, hi = np.searchsorted(at, (start, start + columns))
            part = np.zeros((n, columns), np.float32)
            part[row[lo:hi], at[lo:hi] - start] = 1
            both += (part @ part.T).astype(np.int32)
    out = np.empty((n, n), bool)
    for i in range(n):
        own = both[i].astype(np.int64)
        out[i] = 100 * own >= percent * (sizes[i] + sizes - own)
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph: (first of its part, other)."""
    left, out = np.ones(len(links), bool), []
    for root in range(len(links)):
        if left[root]:
            left[root], todo = False, np.array([root])
            while len(todo):
                todo = np.flatnonzero(links[todo].any(axis=0) & left)
                left[todo] = False
                out.extend((root, int(i)) for i in todo)
    return out


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def confirmed(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Of rows (family, i, j, set_key, hashes), sorted by the first four: edges (a, b) of linked classes."""
    a, b = [], []
    for _, group in groupby(rows(batches), key=lambda r: r[:3]):
        own = {r[3]: np.frombuffer(r[4], S.U) for r in group}
        keys = [*own]
        if len(keys) > 1:
            for x, y in forest(linked([*own.values()], percent)):
                a.append(keys[x])
                b.append(keys[y])
        if len(a) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def places_of(key: Column) -> Column:
    h = F.xxhash64(key)
    return F.array(*(F.pmod(F.shiftrightunsigned(h, 11 * i), F.lit(BITS)) for i in range(PLACES)))


def filter_of(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column `key`: BITS bits, however many keys there are."""
    bits = keys.select(F.explode(places_of(F.col("key"))).alias("x")).groupBy(F.shiftright("x", 6).alias("word"))
    rows = bits.agg(F.bit_or(F.expr("shiftleft(1L, CAST(x % 64 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out


def sets_of(df: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, set_key, hashes) of the rows whose key may be a member's: most other texts end here, before any shuffle."""
    held = df.sparkSession.sparkContext.broadcast(filter_of(members.select("key")))
    key = row_key(id_col, text_col)
    own = df.select(key.alias("key"), places_of(key).alias("places"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            at = batch.column(1).flatten().to_numpy().reshape(-1, PLACES)
            inside = batch.filter(pa.array(((held.value[at >> 6] >> (at & 63)) & 1).all(axis=1)))
            for part in slices([inside], 2, 1 << 20):
                sets = [S.shingles(t or b"") for t in part.column(2).cast(pa.binary()).to_pylist()]
                keys, hashes = [S.set_key(x) for x in sets], [x.tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(hashes, pa.binary())], names=["key", "set_key", "hashes"])

    return mapped(own, run, "key string, set_key binary, hashes binary")


def candidates_of(rows: DataFrame) -> DataFrame:
    """Of rows (tree, prefix, set_key, low) what neighbours() finds, cut from its lineage."""
    ordered = rows.select("tree", "prefix", "set_key", "low").repartitionByRange("tree", "prefix", "set_key").sortWithinPartitions("tree", "prefix", "set_key")
    return cut(mapped(ordered, neighbours, "tree int, a binary, b binary, strange boolean"))


def families(classes: DataFrame) -> DataFrame:
    """(node, label): the families of two classes and more among rows (set_key, sig, low)."""
    step, width = HASHES // TREES, lambda n: 4 * n
    ring = classes.select("set_key", "low", F.concat("sig", F.substring("sig", 1, width(DEEP))).alias("ring"))
    order = F.explode(F.array(*(F.struct(F.lit(t).cast("int").alias("tree"), F.substring("ring", 1 + width(step * t), width(KEY)).alias("prefix")) for t in range(TREES))))
    found = candidates_of(ring.select(order.alias("o"), "set_key", "low").select("o.*", "set_key", "low"))
    edges = found.filter("b IS NOT NULL").select("a", "b")
    crowded = found.filter("b IS NULL").select(F.col("a").alias("set_key"), "tree", "strange").distinct()
    if not crowded.isEmpty():
        share = F.avg(F.col("strange").cast("int"))
        often = crowded.groupBy("set_key").agg(F.count_distinct("tree").alias("n"), share.alias("share")).filter((F.col("n") >= CROWDED) & (F.col("share") > 0.5))
        strangers = classes.select("set_key", "sig", "low").join(often.select("set_key"), "set_key", "left_semi")
        prefix = F.expr(f"substring(ring, 1 + {width(step)} * tree, {width(DEEP)})").alias("prefix")
        deeper = crowded.select("set_key", "tree").distinct().join(ring, "set_key").select("tree", prefix, "set_key", "low")
        again = candidates_of(deeper.union(mapped(strangers, reordered, "tree int, prefix binary, set_key binary, low binary")))
        edges = edges.union(again.filter("b IS NOT NULL").select("a", "b"))
    return components(edges)


def blocks_for(sets: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(sets / BLOCK_SETS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def compared(dealt: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of links between the sets that share (family, i, j)."""
    met = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "set_key")
    return mapped(met, lambda batches: confirmed(batches, percent), "a binary, b binary")


def links(df: DataFrame, classes: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) that join each group's classes, all of them confirmed on full sets."""
    named = families(classes.select("set_key", "sig", "low")).withColumnRenamed("node", "set_key").withColumnRenamed("label", "family")
    member = cut(named.join(classes.select("set_key", "key", "n_shingles"), "set_key"))
    size = cut(member.groupBy("family").agg(blocks_for(F.count("*"), F.sum("n_shingles")).alias("blocks")))
    texts = cut(sets_of(df, member, id_col, text_col).join(member.select("key", "set_key", "family"), ["key", "set_key"]).select("set_key", "family", "hashes"))
    edges, solid = [], None
    large = size.filter(F.col("blocks") > MANY)
    if not large.isEmpty():
        own = texts.join(large, "family")
        turn = F.explode(F.sequence(F.lit(1), F.lit(TURNS))).alias("turn")
        dealt = own.select("family", "set_key", "hashes", "blocks", turn).select("family", F.col("turn").alias("i"), F.pmod(F.xxhash64("turn", "set_key"), F.col("blocks")).cast("int").alias("j"), "set_key", "hashes")
        edges.append(cut(compared(dealt, percent)))
        joined = components(edges[0]).withColumnRenamed("node", "set_key")
        solid = cut(member.join(large.select("family"), "family").join(joined, "set_key").select("family", "label", "set_key", "n_shingles"))
    edges.append(compared(dealt_pairs(texts, member, solid), percent))
    return functools.reduce(DataFrame.union, edges)


def dealt_pairs(texts: DataFrame, member: DataFrame, joined: DataFrame | None) -> DataFrame:
    """(family, i, j, set_key, hashes): each set in every pair of blocks that has to be compared.

    A family's sets lie in mixed blocks, then in the solid blocks of each label of `joined` (family, label, set_key,
    n_shingles) that fills half a block or more. Blocks of the same label don't meet.
    """
    from pyspark.sql import Window

    spread = lambda n: F.pmod(F.xxhash64("set_key"), F.greatest(n, F.lit(1))).cast("int")
    none = F.lit(None).cast("binary")
    if joined is None:
        labelled = member.select("family", "set_key", "n_shingles", none.alias("label"), F.lit(0).alias("lo"), F.lit(0).alias("own"))
    else:
        wide = joined.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
        wide = wide.filter((F.col("n") * 2 >= BLOCK_SETS) | (F.col("shingles") * 2 >= BLOCK_SHINGLES)).select("family", "label", blocks_for(F.col("n"), F.col("shingles")).alias("own"))
        wide = wide.withColumn("lo", (F.sum("own").over(Window.partitionBy("family").orderBy("label")) - F.col("own")).cast("int"))
        solid = joined.select("family", "label", "set_key").join(wide, ["family", "label"]).drop("family")
        labelled = member.select("family", "set_key", "n_shingles").join(solid, "set_key", "left").select("family", "set_key", "n_shingles", "label", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("own", F.lit(0)).alias("own"))
    loose = F.col("label").isNull()
    of_label = labelled.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), F.max("own").alias("own"))
    sizes = of_label.groupBy("family").agg(F.coalesce(blocks_for(F.sum(F.when(loose, F.col("n"))), F.sum(F.when(loose, F.col("shingles")))), F.lit(0)).alias("mixed"), F.coalesce(F.sum("own"), F.lit(0)).cast("int").alias("solid"))
    placed = labelled.join(sizes, "family").select(
        "set_key",
        F.when(loose, spread(F.col("mixed"))).otherwise(F.col("mixed") + F.col("lo") + spread(F.col("own"))).alias("block"),
        (F.col("mixed") + F.col("solid")).alias("blocks"),
        (F.col("mixed") + F.col("lo")).alias("first"),
        (F.col("mixed") + F.col("lo") + F.col("own")).alias("end"),
    )
    at = texts.join(placed, "set_key")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = at.select("family", "block", "blocks", "first", "end", "set_key", "hashes", other).filter("(blocks = 1 OR block != other) AND NOT (other >= first AND other < end)")
    return met.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set_key", "hashes")


def grouped(df: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """(id, key, n_shingles, component_id)."""
    signed = cut(signatures(df, id_col, text_col))
    classes = cut(signed.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("key").alias("key"), F.min("id").alias("first"), F.min("sig").alias("sig"), F.min("low").alias("low"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("copies")))
    label = components(links(df, classes, id_col, text_col, percent)).withColumnRenamed("node", "set_key")
    marked = classes.select("set_key", "first", "copies").join(label, "set_key", "left").filter("copies > 1 OR label IS NOT NULL")
    marked = cut(marked.select("set_key", "first", F.coalesce("label", "set_key").alias("label")))
    smallest = cut(marked.groupBy("label").agg(F.min("first").alias("component_id")))
    known = cut(marked.join(smallest, "label").select("set_key", "component_id", F.lit(True).alias("known")))
    own = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    return signed.join(known, "set_key", "left").select("id", "key", "n_shingles", own)


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept)."""
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    return grouped(df, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", kept)


def deduped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """df's rows and columns, without those that another document of their group stands for."""
    (key,) = fresh(df, "key")
    gone = bounded(grouped(df, id_col, text_col, percent).filter(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("key").alias(key)).distinct())
    return df.withColumn(key, row_key(id_col, text_col)).join(gone, key, "left_anti").select(*df.columns)
