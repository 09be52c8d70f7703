"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A run is a stretch of consecutive lines with MIN_WORDS words or more (lines without words don't count as lines of a
run, and go with the run around them). Each occurrence of a run but the first goes; the first is the one with the
smallest id, then place.

1. Winnowing. From each line a window reaches forward until it has MIN_WORDS words, another one backward. The line with a
   window's smallest hash is its fingerprint, and each such line is a position, however many windows chose it. Two
   documents that share a run share whole windows of it, and so their fingerprints: none is missed.
2. Positions are joined by their hash: what stands at one position only ends here, and so does a document without others.
3. Matches are extended both ways: around the matched positions the windows that chose them, forward and backward, meet
   by a 128-bit hash of their lines. Within a shared run every line lies in a forward or a backward window of the run, so
   the union of a document's windows found elsewhere before is the match extended as far as it goes. Each window is held
   against the first of its kind only; no pairs are made.
4. Later repeated runs go.

Only hashes of lines move in steps 1 to 3. Join sides are tables of measured size, which are broadcast below a bound;
above it both sides are shuffled, and a hot passage's partition can be split at run time. The removals are broadcast
below the same bound, so that texts stay where they are.

Defined results: a null text stays null, an empty text empty; a very long text is one row as any other; rows with equal id and text are one document and are
treated alike; a null id comes after all others; a text that repeats its own lines keeps the first run whole; an empty
table gives an empty table; removed() returns its own columns, deduped() keeps all of the table's, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.llm.common import WORD, bounded, cut, fresh, let

MIN_WORDS = 50


def lines_of(text: Column) -> Column:
    """The lines with words: place, words, two hashes."""
    each = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("p"), F.regexp_count(x, F.lit(WORD)).alias("n"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit("second"), x).alias("g")))
    return F.filter(each, lambda x: x["n"] > 0)


def windows_of(lines: Column, least: int, keys: bool = True) -> Column:
    """The windows over the lines: the fingerprint's hash and place, and with `keys` each window's ends and two hashes."""

    def reach(part: Column) -> Column:
        """How many lines from the start of `part` have `least` words, and how many words they have."""
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"))
        return F.aggregate(part, zero, lambda a, x: F.when(a["w"] >= least, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["w"] + x["n"]).alias("w"))))

    def window(start: Column, n: Column) -> Column:
        part = F.slice(lines, start + 1, n)
        low = F.array_min(F.transform(part, lambda x: F.struct(x["h"].alias("m"), x["p"].alias("at"))))
        if not keys:
            return low
        first, last = F.xxhash64(F.transform(part, lambda y: y["h"])), F.xxhash64(F.transform(part, lambda y: y["g"]))
        return F.struct(part[0]["p"].alias("s"), F.element_at(part, -1)["p"].alias("e"), first.alias("k1"), last.alias("k2"), low["m"].alias("m"))

    def forward(_: Column, j: Column) -> Column:
        return let(reach(F.slice(lines, j + 1, F.lit(least))), lambda r: F.when(r["w"] >= least, window(j, r["n"])))

    def backward(x: Column, j: Column) -> Column:
        first = F.greatest(j + 1 - least, F.lit(0))
        part = F.reverse(F.slice(lines, first + 1, j + 1 - first))
        # a backward window that needs its last line is a forward one too
        return let(reach(part), lambda r: F.when((r["w"] >= least) & (r["w"] - x["n"] >= least), window(j + 1 - r["n"], r["n"])))

    return F.array_compact(F.concat(F.transform(lines, forward), F.transform(lines, backward)))


def removals(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, h, runs): of each document that loses lines its id, its text's hash and the lost runs of lines, in order."""
    document = (F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("h").alias("h"))
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), lines_of(F.col(text_col)).alias("lines")).filter(F.size("lines") > 0)
    docs = cut(docs)
    marks = docs.select("id", "h", F.explode(F.array_distinct(let(F.col("lines"), lambda x: windows_of(x, least, keys=False)))).alias("x")).select("id", "h", "x.m", "x.at")
    marks = cut(marks)
    place = F.struct(*document, F.col("at").alias("at"))
    repeated = bounded(marks.groupBy("m").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a != b").select("m"))
    touched = bounded(marks.join(repeated, "m", "left_semi").select(F.col("id").alias("id_"), F.col("h").alias("h_")).distinct())
    chosen = docs.join(touched, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left_semi")
    found = chosen.select("id", "h", F.explode(let(F.col("lines"), lambda x: windows_of(x, least))).alias("x")).select("id", "h", "x.*")
    likely = cut(found.join(repeated, "m", "left_semi").select("id", "h", "s", "e", "k1", "k2"))
    here = F.struct(*document, F.col("s").alias("s"), F.col("e").alias("e"))
    first = likely.groupBy("k1", "k2").agg(F.min(here).alias("f"), F.max(here).alias("l")).filter("f != l").select("k1", "k2", "f")
    later = likely.join(bounded(first), ["k1", "k2"]).filter(here != F.col("f"))
    own = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("h") == F.col("f.h"))
    start = F.when(own, F.greatest("s", F.col("f.e") + 1)).otherwise(F.col("s"))
    gone = later.select("id", "h", start.alias("s"), "e").filter("s <= e").distinct()
    by_place = Window.partitionBy("id", "h").orderBy("s", "e")
    reached = F.max("e").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("s") <= F.col("reached") + 1, 0).otherwise(1)).over(by_place)
    runs = gone.withColumn("reached", reached).withColumn("island", island).groupBy("id", "h", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs"))


def without(lines: Column, runs: Column) -> Column:
    """The lines outside the runs: slices between one run's end and the next one's start."""

    def between(i: Column) -> Column:
        start = F.coalesce(F.get(runs, i - 1)["e"] + 1, F.lit(0))
        return F.slice(lines, start + 1, F.coalesce(F.get(runs, i)["s"], F.size(lines)) - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), between))


def applied(df: DataFrame, id_col: str, text_col: str, least: int) -> tuple[DataFrame, str, str, str]:
    """df with the lines, the runs and the lines that stay, under the names that follow it."""
    h, lines, runs, stay, id_, h_ = fresh(df, "h", "lines", "runs", "stay", "id_of", "h_of")
    lost = bounded(removals(df, id_col, text_col, least)).toDF(id_, h_, runs)
    out = df.withColumn(h, F.xxhash64(text_col)).join(lost, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(h) == F.col(h_)), "left").drop(id_, h_, h)
    out = out.withColumn(lines, F.split(text_col, "\n", -1))
    out = out.withColumn(stay, F.when(F.col(runs).isNull(), F.col(lines)).otherwise(let(F.col(lines), lambda x: without(x, F.col(runs)))))
    return out, lines, runs, stay


def removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(id, n_lines, n_removed, removed, text): the runs that go as first-last, comma-joined, lines from 0, and the rest."""
    out, lines, runs, stay = applied(df.select(id_col, text_col), id_col, text_col, least)
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    listed = F.array_join(F.transform(runs, lambda r: F.concat_ws("-", r["s"].cast("string"), r["e"].cast("string"))), ",")
    return out.select(id_col, n(lines).alias("n_lines"), (n(lines) - n(stay)).alias("n_removed"), F.coalesce(listed, F.lit("")).alias("removed"), F.array_join(stay, "\n").alias(text_col))


def deduped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """df's rows and columns with later repeated runs cut from the text; a document that loses all its words goes."""
    out, _, runs, stay = applied(df, id_col, text_col, least)
    emptied = F.col(runs).isNotNull() & ~F.exists(stay, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = out.filter(~emptied).withColumn(text_col, F.array_join(stay, "\n"))
    return kept.select(*df.columns)


#: DuckDB's form of removed(): every window's lines are compared as text, without fingerprints or hashes.
SQL = rf"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
every AS (
  SELECT doc_id, p - 1 AS p, ls[p] AS line, len(regexp_extract_all(ls[p], '{WORD}')) AS n
  FROM split, unnest(range(1, len(ls) + 1)) AS r(p)),
l AS (
  SELECT *, row_number() OVER d AS j, sum(n) OVER d AS total FROM every WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
bounds AS (
  SELECT a.doc_id, a.j AS s, min(b.j) AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.total - a.total + a.n >= {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT a.doc_id, max(b.j), a.j FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.j <= a.j AND a.total - b.total + b.n >= {MIN_WORDS} GROUP BY a.doc_id, a.j),
windows AS (
  SELECT w.doc_id, w.s, w.e, min(p) AS first, max(p) AS last, string_agg(line, chr(10) ORDER BY j) AS content
  FROM bounds w JOIN l ON l.doc_id = w.doc_id AND l.j BETWEEN w.s AND w.e GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER c AS nth, first_value(doc_id) OVER c AS d0, first_value(last) OVER c AS e0
  FROM windows WINDOW c AS (PARTITION BY content ORDER BY doc_id, first, last)),
gone AS (
  SELECT DISTINCT every.doc_id, p FROM ranked r JOIN every ON every.doc_id = r.doc_id AND p BETWEEN r.first AND r.last
  WHERE nth > 1 AND NOT (d0 = r.doc_id AND p <= e0)),
islands AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM gone),
runs AS (SELECT doc_id, min(p) AS a, max(p) AS b FROM islands GROUP BY doc_id, k),
listed AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM runs GROUP BY doc_id),
rest AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text, count(*) AS n FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(rest.n, 0))::BIGINT AS n_removed, coalesce(removed, '') AS removed,
  CASE WHEN split.text IS NOT NULL THEN coalesce(rest.text, '') END AS text
FROM split LEFT JOIN listed USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
