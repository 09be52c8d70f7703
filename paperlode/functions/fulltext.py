"""Weighted full-text search: postings, a query parser, matching and ranking.

Postings are rows (paper_id, lexeme, pos, weight): the title's words have weight A, the abstract's B, at positions that
follow the title's. Mode "simple" takes lower-case runs of ASCII letters and digits; mode "english" drops stop words and
stems each different word of a batch once.

For searches the postings are stored inverted: inverted() makes, in one pass over the texts, a row of all places for each
lexeme of a few MB of text, and by_lexeme() orders these rows within each task; nothing is shuffled, so a frequent lexeme
burdens no single task. flat() gives the postings back. write_postings() stores them bucketed by lexeme instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.batches import BATCH_BYTES, mapped, slices
from paperlode.functions.stemmer import stem

#: The weights of the four classes of places, the greatest position and the most places of a lexeme.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
MOST_POSITION, MOST_PLACES = 16383, 256
#: A row of inverted postings holds at most so many places; more make further rows.
MOST_HELD = 1 << 16
#: Fixed value: the public list of English stop words of the Snowball stemmer's authors.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
    its itself they them their theirs themselves what which who whom this that these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so
    than too very s t can will just don should now""".split()
)


class QueryError(ValueError):
    """A query with operators that aren't supported."""


@dataclass(frozen=True)
class Query:
    terms: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]

    def text(self) -> str:
        """Terms, then phrases, as alternatives."""
        return " | ".join([*self.terms, *(f"({' <-> '.join(p)})" for p in self.phrases)])


def parse(query: str) -> Query:
    """Quoted phrases and the words between them; a quote that isn't closed stays part of its word. The pattern of a
    phrase is a fixed value."""
    phrases = tuple(tuple(p.split()) for p in re.findall(r'"([^"]+)"', query))
    terms = tuple(re.sub(r'"[^"]+"', "", query).split())
    return Query(terms, tuple(p for p in phrases if p))


def lexemes(query: Query, mode: str) -> tuple[list[tuple[str, bool]], list[list[str]]]:
    """(word, is a prefix) of each term, and each phrase's words; rejects the other operators."""
    form = (lambda w: w) if mode == "simple" else (lambda w: stem(w))
    kept = lambda w: mode == "simple" or w not in STOP_WORDS

    def word(raw: str) -> tuple[str, bool]:
        prefix = raw.endswith(":*")
        bare = raw.removesuffix(":*").lower()
        if re.search(r"[&|!():*<>\\']", bare):
            raise QueryError(f"operators aren't supported: {raw}")
        return bare, prefix

    terms = [(p if prefix else form(p), prefix) for raw in query.terms for p, prefix in [word(raw)] if re.search("[a-z0-9]", p) and kept(p)]
    phrases = [[form(w) for raw in phrase for w, _ in [word(raw)] if kept(w)] for phrase in query.phrases]
    return terms, [p for p in phrases if p]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def postings(papers: DataFrame, mode: str = "simple") -> DataFrame:
    """(paper_id, lexeme, pos, weight)."""
    if mode == "english":
        return flat(inverted(papers, mode))

    def placed(found: Column, name: str, after: Column) -> Column:
        return F.transform(found, lambda w, i: F.struct(w.alias("w"), F.least(i + 1 + after, F.lit(MOST_POSITION)).cast("int").alias("p"), F.lit(name).alias("f")))

    # bound as a lambda's variable, the words are found once; in a lambda's body they would be found for each element
    found = F.array(F.struct(words(F.col("title")).alias("t"), words(F.col("abstract")).alias("b")))
    both = F.transform(found, lambda r: F.concat(placed(r["t"], "A", F.lit(0)), placed(r["b"], "B", F.size(r["t"]))))[0]
    # the expression itself is exploded: over a column of an earlier projection the optimizer would add a filter that
    # isn't empty, and the texts would be tokenised twice
    each = papers.select("paper_id", F.explode(both).alias("x"))
    return each.select("paper_id", F.col("x.w").alias("lexeme"), F.col("x.p").alias("pos"), F.col("x.f").alias("weight"))


#: A byte's lower-case form, and which of these belong to words.
LOWER = np.array([*bytes(range(256)).lower()], np.uint8)
OF_WORDS = np.isin(np.arange(256), [*b"abcdefghijklmnopqrstuvwxyz0123456789"])
#: The characters beyond ASCII whose lower-case form has an ASCII letter.
TO_ASCII = {"\u0130": "i\u0307", "\u212a": "k"}


def found_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts; of each the number of its text, and its own in that text from 1."""
    texts = texts.cast(pa.string())
    for c, form in TO_ASCII.items():
        if pc.any(pc.match_substring(texts, c)).as_py():
            texts = pc.replace_substring(texts, c, form)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    data = LOWER[data]
    bounds = bounds - bounds[0]
    inside = OF_WORDS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = bounds[:-1][bounds[:-1] < len(data)]
    begins[firsts] = inside[firsts]  # a text's first word doesn't go on from the text before
    begins = np.flatnonzero(begins)
    ends = np.cumsum(inside, dtype=np.int32)
    offsets = np.append(ends[begins] - 1, ends[-1:] if len(data) else 0).astype(np.int32)
    before = np.searchsorted(begins, bounds)
    n = np.diff(before)
    own = np.arange(1, len(begins) + 1) - np.repeat(before[:-1], n)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data[inside])), np.repeat(np.arange(len(texts)), n), own


def inverted_rows(mode: str, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2, most):
        (title, of_title, in_title), (body, of_body, in_body) = found_in(batch.column(1)), found_in(batch.column(2))
        before = np.bincount(of_title, minlength=batch.num_rows)
        places = np.concatenate([-np.minimum(in_title, MOST_POSITION), np.minimum(in_body + before[of_body], MOST_POSITION)]).astype(np.int32)
        coded = pa.concat_arrays([title, body]).dictionary_encode()
        forms = coded.dictionary
        if mode == "english":
            forms = pa.array([None if w in STOP_WORDS else stem(w) for w in forms.to_pylist()], pa.string())
        names = forms.drop_null().unique()
        names = names.take(pc.sort_indices(names))
        number = pc.fill_null(pc.index_in(forms, names, skip_nulls=True), len(names)).to_numpy()
        numbers = number.astype(np.uint16 if len(names) < 1 << 16 else np.int32)[coded.indices.to_numpy()]
        order = np.argsort(numbers, kind="stable")
        numbers = numbers[order]
        kept = int(np.searchsorted(numbers, len(names)))  # stop words come last
        if kept == 0:
            continue
        order, numbers = order[:kept], numbers[:kept]
        starts = np.union1d(np.flatnonzero(np.diff(numbers)) + 1, np.arange(0, kept, MOST_HELD))
        held = lambda values: pa.ListArray.from_arrays(pa.array(np.append(starts, kept), pa.int32()), values)
        papers = batch.column(0).take(pa.array(np.concatenate([of_title, of_body])[order]))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(numbers[starts])), held(papers), held(pa.array(places[order]))], names=["lexeme", "papers", "places"])


def inverted(papers: DataFrame, mode: str = "simple", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(lexeme, papers, places): a lexeme's places in a few MB of text; a place in a title is negative."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    texts = papers.select(F.col("paper_id").cast("long").alias("paper_id"), text("title"), text("abstract"))
    return mapped(texts, partial(inverted_rows, mode, batch_bytes), "lexeme string, papers array<long>, places array<int>")


def flat(index: DataFrame) -> DataFrame:
    """(paper_id, lexeme, pos, weight) of inverted postings; a filter on lexemes reaches their scan."""
    each = index.select("lexeme", F.explode(F.arrays_zip("papers", "places")).alias("x"))
    return each.select(F.col("x.papers").alias("paper_id"), "lexeme", F.abs("x.places").alias("pos"), F.when(F.col("x.places") < 0, "A").otherwise("B").alias("weight"))


def write_postings(table: DataFrame, name: str, buckets: int = 256) -> None:
    """As a table bucketed and sorted by lexeme: filters on lexemes prune buckets, and phrase joins don't shuffle."""
    table.write.bucketBy(buckets, "lexeme").sortBy("lexeme", "paper_id").mode("overwrite").saveAsTable(name)


def by_lexeme(index: DataFrame) -> DataFrame:
    """In order of lexemes in each file: of the files a query's filter then reads only the pages that hold its words."""
    return index.sortWithinPartitions("lexeme")


def refreshed(old: DataFrame, changed: DataFrame, mode: str = "simple") -> DataFrame:
    """Postings after papers have changed: those papers' postings are made anew, the others stay."""
    return old.join(changed.select("paper_id").distinct(), "paper_id", "left_anti").unionByName(postings(changed, mode))


def any_of(terms: list[tuple[str, bool]]) -> Column:
    """A filter on lexemes that reaches the scan."""
    whole = [t for t, prefix in terms if not prefix]
    parts = ([F.col("lexeme").isin(*whole)] if whole else []) + [F.col("lexeme").startswith(t) for t, prefix in terms if prefix]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def phrase_places(table: DataFrame, phrase: list[str]) -> DataFrame:
    """(paper_id, pos) where the words stand one after another: counts of shifted positions, in one pass."""
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(phrase)))).alias("x")
    own = table.filter(F.col("lexeme").isin(*set(phrase))).select("paper_id", "lexeme", "pos", wanted).filter("lexeme = x.w")
    starts = own.groupBy("paper_id", (F.col("pos") - F.col("x.i")).alias("pos")).agg(F.count_distinct("x.i").alias("n"))
    return starts.filter(F.col("n") == len(phrase)).select("paper_id", "pos")


def matching(table: DataFrame, terms: list[tuple[str, bool]], phrases: list[list[str]]) -> DataFrame:
    """(paper_id) of the papers with any of the terms or phrases."""
    parts = [table.filter(any_of(terms)).select("paper_id")] if terms else []
    parts += [phrase_places(table, p).select("paper_id") for p in phrases]
    return reduce(DataFrame.unionAll, parts).distinct() if parts else table.select("paper_id").limit(0)


def weight_of() -> Column:
    return reduce(lambda c, kv: c.when(F.col("weight") == kv[0], kv[1]), WEIGHTS.items(), F.when(F.lit(False), 0.0))


def rank(table: DataFrame, terms: list[tuple[str, bool]], phrases: list[list[str]]) -> DataFrame:
    """(paper_id, rank) of the papers that have a lexeme of the query.

    Of each lexeme of the query the weights, in the order of places, count 1 / place squared, the greatest in full. A query
    that is one phrase of several words is ranked by how near its words stand to each other.
    """
    flat = [*dict.fromkeys([*terms, *((w, False) for p in phrases for w in p)])]
    own = table.filter(any_of(flat))
    if not terms and len(phrases) == 1 and len(set(phrases[0])) > 1:
        return nearness(own)
    places = Window.partitionBy("paper_id", "lexeme").orderBy("pos", "weight")  # at the greatest position the title's first
    numbered = own.withColumn("j", F.row_number().over(places)).filter(F.col("j") <= MOST_PLACES).withColumn("w", weight_of())
    each = numbered.groupBy("paper_id", "lexeme").agg(
        F.sum(F.col("w") / (F.col("j") * F.col("j"))).alias("all"),
        F.max("w").alias("top"),
        F.min_by("j", F.struct(-F.col("w"), F.col("j"))).alias("at"),
    )
    term = (F.col("top") + F.col("all") - F.col("top") / (F.col("at") * F.col("at"))) / 1.64493406685
    # in the order of their values: as rows arrive, equal terms would give sums that differ in their last bits, and the
    # page would follow these instead of the dates
    terms_of = each.groupBy("paper_id").agg(F.sort_array(F.collect_list(term)).alias("x"))
    return terms_of.select("paper_id", (F.aggregate("x", F.lit(0.0), lambda a, b: a + b) / len(flat)).alias("rank"))


def nearness(own: DataFrame) -> DataFrame:
    """1 - the product, over pairs of places of two lexemes, of 1 - sqrt(weights * closeness); pairs within a paper only,
    of a query's words, MOST_PLACES places each."""
    places = Window.partitionBy("paper_id", "lexeme").orderBy("pos", "weight")
    numbered = own.withColumn("w", weight_of()).withColumn("j", F.row_number().over(places)).filter(F.col("j") <= MOST_PLACES)
    listed = numbered.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("lexeme", "pos", "w"))).alias("x"))  # a product's last bits follow its order

    def factor(a: Column, b: Column) -> Column:
        d = F.abs(a["pos"] - b["pos"]).cast("double")
        close = F.when(d > 100, 1e-30).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
        return F.when((a["lexeme"] < b["lexeme"]) & (d > 0), 1 - F.sqrt(a["w"] * b["w"] * close)).otherwise(1.0)

    inner = lambda a, xs: F.aggregate(xs, F.lit(1.0), lambda p, b: p * factor(a, b))
    product = F.aggregate("x", F.lit(1.0), lambda p, a: p * inner(a, F.col("x")))
    return listed.select("paper_id", (1 - product).alias("rank"))
