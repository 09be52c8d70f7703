"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Each rule compares `share * denominator` with `100 * numerator` in whole numbers, so that no division is needed. The
metrics are array and string functions over the whole text; where a metric needs the words again and again they are
bound once (common.let).

Defined results: a null or empty text has no words, so every count is 0 and the row fails (fewer than 10 words); a very
long text is one row whose arrays follow its words; the floor of stop words knows four languages, so that a text of 60
words or more in another language fails unless a caller gives other rules; rows are independent, so ties, repeated rows and null ids don't matter; an empty table gives an empty table; verdicts()
returns the id and its own columns, accepted() keeps all of the table's columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.llm.common import WORD, fresh, let

N = 5
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    *("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are", "by", "this", "be", "at", "from", "or", "an", "have"),
    *("der", "die", "das", "und", "ist", "nicht", "mit", "von", "den", "zu", "ein", "eine", "im", "auf", "für", "sich", "dem", "des", "auch", "als"),
    *("le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "qui", "dans", "en", "du", "pour", "pas", "au", "sur", "par", "plus"),
    *("el", "los", "las", "y", "del", "una", "por", "con", "para", "se", "no", "su", "al", "lo", "como", "más", "es"),
)


@dataclass(frozen=True)
class Rule:
    """Rejects if 100 * numerator is above (or below, for a floor) share * denominator and the text has min_words."""

    name: str
    numerator: str
    denominator: str
    share: int
    floor: bool = False
    min_words: int = 0

    def sql(self) -> str:
        return f"(n_words >= {self.min_words} AND 100 * {self.numerator} {'<' if self.floor else '>'} {self.share} * {self.denominator})"


BASE = (
    Rule("few_words", "n_words", "10", 100, floor=True),
    Rule("repeated_words", "n_repeat_words", "n_words", 20),
)
RULES = (
    Rule("symbols", "n_symbols", "n_words", 25),
    Rule("capitals", "n_upper", "word_chars", 50),
    Rule("long_words", "word_chars", "n_words", 2500),
    Rule("short_words", "word_chars", "n_words", 150, floor=True),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 40),
    Rule("stop_words", "n_stop_words", "n_words", 1, floor=True, min_words=60),
)


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of N words that the text has twice or more."""

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (N - 1), F.lit(0))), lambda _, i: F.xxhash64(*(F.get(h, i + k) for k in range(N))))

    def covered(s: Column) -> Column:
        same = lambda x, j, d: F.coalesce(x["g"] == F.get(s, j + d)["g"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j, -1) | same(x, j, 1)), lambda x: x["i"]))
        zero = F.struct(F.lit(-N).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, zero, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(N), p - a["last"])).alias("n")), lambda a: a["n"])

    def count(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(ordered, covered))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count))


def metrics(text: Column) -> Column:
    """A struct of whole numbers."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_upper"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), 0), of)


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def compiled(rules: tuple[Rule, ...]) -> str:
    return " OR ".join(r.sql() for r in rules)


def verdicts(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the base metrics, base_failed, kept, failed): `failed` lists the rules that reject the text."""
    measured, m = df.select(F.col(id_col).alias("id"), metrics(F.col(text_col)).alias("m")), F.col("m")
    failed = F.array_compact(F.array(*(F.when(rejects(m, (r,)), F.lit(r.name)) for r in (*BASE, *rules))))
    return measured.select(F.col("id").alias(id_col), *(m[x].alias(x) for x in METRICS), rejects(m, BASE).alias("base_failed"), (~rejects(m, (*BASE, *rules))).alias("kept"), F.array_join(failed, ",").alias("failed"))


def accepted(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of df that no rule rejects, with df's columns."""
    (m,) = fresh(df, "m")
    measured = df.withColumn(m, metrics(F.col(text_col)))
    return measured.filter(~rejects(F.col(m), (*BASE, *rules))).select(*df.columns)


def rejects(m: Column, rules: tuple[Rule, ...]) -> Column:
    """The threshold table as one expression over the struct of metrics."""
    out = F.lit(False)
    for r in rules:
        denominator = F.lit(int(r.denominator)) if r.denominator.isdigit() else m[r.denominator]
        left, right = 100 * m[r.numerator], r.share * denominator
        out = out | ((m["n_words"] >= r.min_words) & (left < right if r.floor else left > right))
    return out


STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
#: DuckDB's form of verdicts(); its windows are compared as strings.
SQL = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(words[i:i + {N - 1}], ' ') AS g FROM split, unnest(range(1, len(words) - {N - 2})) AS r(i)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
covered AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM twice, unnest(range({N})) AS r(k) GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
    len(list_filter(words, lambda w: lower(w) IN ({STOP_SQL})))::BIGINT AS n_stop_words
  FROM split LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({compiled(BASE)}) AS base_failed, NOT ({compiled((*BASE, *RULES))}) AS kept,
  array_to_string(list_filter([{", ".join(f"CASE WHEN {r.sql()} THEN '{r.name}' END" for r in (*BASE, *RULES))}], lambda x: x IS NOT NULL), ',') AS failed
FROM measured
"""
